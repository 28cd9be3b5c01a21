"""Queries that read whole tables, against brute force on small fixtures."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import logic, rust_strings, search
from tessera.plans.registry import registered
from tessera.plans.text_queries import COMBOS, CONVERSATION_WORDS

QUERIES = registered()


def test_closure_of_every_line(spark, tmp_path):
    """Edges of all line numbers, quantities and keys, a cycle through 10 and 24 included."""
    rows = [(1, 10, 1, 5.0), (10, 3, 2, 50.0), (24, 1, 7, 1.0), (10, 4, 7, 50.0), (31, 10_000, 3, 2.0), (1, 10, 4, 7.0), (73, 4, 1, 9.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    reach = {(s, p * 7 + 3) for s, p, _, _ in rows}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    assert (24, 24) in reach
    assert (1, 70_003) in reach
    found = [(r.a0, r.a1) for r in QUERIES["jn04_lg05_closure_whole"].run(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted((f"n{a}", f"n{b}") for a, b in reach)


def test_closure_of_cycles_and_hubs(spark, monkeypatch):
    """Against brute force; what passes write stays small where all pairs lead over a few inner nodes."""
    rng, written, cut = random.Random(4), [], logic._cut
    monkeypatch.setattr(logic, "_cut", lambda df: written.append(cut(df)) or written[-1])
    for nodes, count in ((12, 10), (30, 25), (30, 45), (8, 40)):
        edges = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(count)}
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        found = logic.closure(spark.createDataFrame(list(edges), "a0 string, a1 string")).collect()
        assert sorted((r.a0, r.a1) for r in found) == sorted(reach)
    written.clear()
    hub = spark.createDataFrame([(f"a{k}", "m") for k in range(200)] + [("m", f"b{k}") for k in range(200)], "a0 string, a1 string")
    assert logic.closure(hub).count() == 200 * 200 + 400
    assert max(df.count() for df in written) == 400
    written.clear()
    lines = spark.createDataFrame([(k, 1) for k in range(200)] + [(10, 2 + k) for k in range(200)], "l_suppkey long, l_partkey long")
    monkeypatch.setattr("tessera.plans.relations.table", lambda *_: lines)
    assert QUERIES["jn04_lg05_closure_whole"].run(spark, "").count() > 200 * 200
    assert max(df.count() for df in written) < 1_000


def test_closure_of_many_profiles(spark, monkeypatch):
    """Many nodes that reach nearly the same: no table is larger than the edges, though each node has a profile of its own. Nulls are nodes that nothing joins."""
    rng, written, cut = random.Random(6), [], logic._cut
    monkeypatch.setattr(logic, "_cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(logic, "SIDE", 7)
    edges = {(f"a{k}", "m") for k in range(36)} | {(f"a{k}", f"o{x}") for k in range(40) for x in rng.sample(range(10), 3)}
    edges |= {("m", f"b{k}") for k in range(300)} | {(f"o{k}", f"b{x}") for k in range(10) for x in rng.sample(range(310), 30)}
    edges |= {(None, "x"), ("x", "y"), ("y", None), (None, "y"), (None, None), ("x", None)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c and b is not None} - reach:
        reach |= more
    table = spark.createDataFrame(list(edges), "a0 string, a1 string")
    for most in (logic.NODES, 0):
        monkeypatch.setattr(logic, "NODES", most)
        found = [(r.a0, r.a1) for r in logic.closure(table).collect()]
        assert len(found) == len(reach)
        assert set(found) == reach
    assert max(df.count() for df in written) <= len(edges)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_grep_of_conversations(spark, tmp_path):
    rows = [(1, 0, "all fine\nPermision denied\nwarning: memory leek\n"), (1, 1, "fatal eror"), (2, 0, ""), (3, 0, None), (3, 1, "a qestion")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {(r.conv_id, r.turn, r.line_no, r.pattern, r.distance) for r in QUERIES["st13_agrep_conversations"].run(spark, str(tmp_path)).collect()}
    want = set()
    for conv, turn, text in rows:
        for k, line in enumerate((text or "").lower().split("\n"), 1):
            for word in CONVERSATION_WORDS:
                pieces = [line[i : i + n] for n in range(len(word) - 2, len(word) + 3) for i in range(max(len(line) - n, 0) + 1)]
                least = min(_edits(x, word) for x in [*pieces, *line.split()])
                want |= {(conv, turn, k, word, least)} if least <= 2 else set()
    assert found == want
    assert {(1, 0, 2, "permission denied", 1), (1, 0, 3, "memory leak", 1), (1, 1, 1, "error", 1), (3, 1, 1, "question", 1)} <= found


def _documents(spark, folder, texts):
    rows = [(k, text, "en", "s") for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_every_document_is_stripped(spark, tmp_path):
    texts = ['let s = "unsafe { x }"; unsafe { y }', 'r#"transmute("x")"# + b"y\\"z" + \'q\'', "// \"comment\" it's x", 'br##"a"# b"## end', "'a' 'static '\\n'", "plain", "", None]
    strip = rust_strings.stripper()
    found = {r.id: r.stripped for r in QUERIES["st06_rust_strings"].run(spark, _documents(spark, tmp_path, texts)).collect()}
    assert found == {k: None if t is None else strip(t) for k, t in enumerate(texts)}
    assert found[0] == 'let s = ""; unsafe { y }'


def test_every_document_is_mutated(spark, tmp_path):
    texts = ["let a = true;\nif a == b { allow() }\ndeny(); eval(x)", "guard x\nreturn >= 2", "plain"]
    found = {(r.file, r.combo): r.mutated for r in QUERIES["st20_st21_mutations"].run(spark, _documents(spark, tmp_path, texts)).collect()}
    assert sorted(c for f, c in found if f.endswith("doc_0.rs")) == sorted(COMBOS)
    assert found[("s/en/doc_1.rs", "comparison-flip")] == "guard x\nreturn <= 2"
    assert {c for f, c in found if f.endswith("doc_2.rs")} == {"mutation-marker"}


def test_rules_of_every_document(spark, tmp_path):
    texts = ["see http://example.com", 'password = "hunter2hunter2"', " ".join(["TODO"] * 11), "std::mem::forget(x)", "nothing"]
    found = {(r.file, r.rule) for r in QUERIES["fd79_document_findings"].run(spark, _documents(spark, tmp_path, texts)).collect() if r.file}
    assert {("s/en/doc_0.rs", "W77"), ("s/en/doc_1.rs", "W78"), ("s/en/doc_2.rs", "W79")} <= found
    assert any(f == "s/en/doc_3.rs" for f, _ in found)
    assert not any(f == "s/en/doc_4.rs" for f, _ in found)


def test_fuzzy_grep_is_one_pass(spark):
    """Distances against brute force over all pieces; no edit distance is made for each piece."""
    rng, patterns = random.Random(3), ["error", "ab", "é😀x", "memory leak"]
    lines = ["", "memory leek", "eror", "é😀x", "é x", None, *["".join(rng.choice("aberomy lkx😀é") for _ in range(rng.randint(1, 30))) for _ in range(200)], "z" * 40_000 + "errr"]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    for most in (0, 1, 2, 3):
        found = rows.select("k", text.fuzzy_distances(patterns, most)(F.col("line")).alias("d"))
        for r in found.collect():
            line = lines[r.k]
            if line is None:
                assert r.d is None
                continue
            short = line[-60:]
            pieces = {short[i:j] for i in range(len(short) + 1) for j in range(i, min(len(short), i + 15) + 1)}
            least = [min(_edits(x, p) for x in pieces) if len(p) <= 5 else None for p in patterns]
            assert [x for x, p in zip(r.d, patterns, strict=True) if len(p) <= 5] == [x if x <= most else None for x in least if x is not None]
    plan = search.agrep(spark.createDataFrame([("x", "fatal eror")], "id string, content string"), patterns, 2)._jdf.queryExecution().toString()
    assert "levenshtein" not in plan.lower()
