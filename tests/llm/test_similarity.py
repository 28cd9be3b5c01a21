"""Near duplicates of documents, lines and embeddings, components and the pipeline against brute force."""

from __future__ import annotations

import random
from math import comb
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import hot, line_dedup, linking, near_dedup, scratch
from tessera.llm.components import components
from tessera.llm.decontamination import find_leaks
from tessera.llm.embedding_dedup import near_embeddings
from tessera.llm.line_dedup import dedup_lines, line_classes, line_set, signatures
from tessera.llm.near_dedup import drop_near_duplicates, joint_estimate, near_duplicates, registers, shingle_set
from tessera.llm.queries import op4_line_dedup
from tessera.llm.scratch import Table, shared_dir, sweep
from tessera.llm.shipping import ship
from tests.llm.helpers import Union, jaccard_components, word_shingles


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _noisy(rng, words, share):
    return [w if rng.random() > share else f"new{rng.random():.9f}" for w in words]


@pytest.fixture(scope="module")
def groups(spark):
    """Copies, chains and near copies of many strengths, hot passages, and odd rows."""
    ship(spark)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    base = [word() for _ in range(120)]
    texts += [" ".join(base)] * 60
    texts += [" ".join(_noisy(rng, base, rng.choice([0.01, 0.03, 0.06]))) for _ in range(150)]
    chain = [word() for _ in range(100)]
    for _ in range(30):
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(150)]
    texts += [None, "", " \n", "one", "One", "two words", "two  WORDS", "x " * 20_000, "x " * 19_000]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[70], (None, texts[0]), (None, texts[0])], "doc_id long, text string").repartition(5).withColumns(
        {c: F.lit("clash") for c in ("node", "key", "sig", "kept", "n", "id")}
    )


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(groups, words):
    texts = {r.doc_id: r.text for r in groups.collect()}
    sets = {k: word_shingles(t, words) for k, t in texts.items() if k is not None}
    want = {k: k for k in sets} | jaccard_components({k: s for k, s in sets.items() if s}, 80, 100)
    result = near_duplicates(groups, words=words).collect()
    assert len(result) == groups.count()
    for r in result:
        if r.doc_id is None:
            assert r.component_id is None
            assert r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)


def test_near_duplicates_in_small_chunks(groups, monkeypatch):
    """Groups of two chunks, joined instead of broadcast buckets and ids, and salted keys give the same rows."""
    size = 1
    want = sorted(map(str, near_duplicates(groups, words=2).collect()))
    monkeypatch.setattr(linking, "CHUNK", 40)
    monkeypatch.setattr(linking, "MOST_BUCKETS", size)
    monkeypatch.setattr(linking, "MOST_IDS", size)
    monkeypatch.setattr(near_dedup, "MOST_IDS", size)
    monkeypatch.setattr(hot, "HOT_ROWS", max(size, 1))
    assert sorted(map(str, near_duplicates(groups, words=2).collect())) == want


@pytest.mark.parametrize("parts", [[400, 1], [30, 5], [90, 60, 60, 1], [50] * 6], ids=str)
def test_members_of_mixed_buckets_meet(spark, monkeypatch, parts):
    """Each pair of two components is compared in one group; few foreign members make few rows."""
    monkeypatch.setattr(linking, "CHUNK", 40)
    rows, node = [], 0
    for component, size in enumerate(parts):
        rows += [(0, 7, node + k, component) for k in range(size)]
        node += size
    alone = [(1, 8, k, 0) for k in range(parts[0])]
    dealt = linking._dealt(spark.createDataFrame([*rows, *alone], "no int, band long, node long, component long")).collect()
    assert {r.band for r in dealt} == {7}
    groups = {}
    for r in dealt:
        groups.setdefault((r.i, r.j), []).append(r)
    met = [
        frozenset((a.node, b.node))
        for (i, j), own in groups.items()
        for k, a in enumerate(own)
        for b in own[k + 1 :]
        if a.component != b.component and (i == j or a.chunk != b.chunk)
    ]
    assert len(met) == len(set(met)) == sum(x * y for k, x in enumerate(parts) for y in parts[k + 1 :])
    if parts == [400, 1]:
        assert len(dealt) == 400 + 11


def test_near_duplicates_of_ids_with_several_texts(spark):
    ship(spark)
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    table = spark.createDataFrame([(5, a), (5, b), (9, b), (11, b + " more"), (12, "other"), (5, a), (13, ""), (13, None)], "doc_id long, text string")
    assert sorted({(r.doc_id, r.component_id) for r in near_duplicates(table, words=2).collect()}) == [(5, 5), (9, 5), (11, 5), (12, 12), (13, 13)]
    kept = sorted((r.doc_id, r.text) for r in drop_near_duplicates(table, words=2).collect() if r.text)
    assert kept == sorted([(5, a), (5, b), (12, "other")])


def test_near_duplicates_of_documents(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {k: word_shingles(t, 2) for k, t in texts.items()}
    want = {k: k for k in sets} | jaccard_components({k: s for k, s in sets.items() if s}, 80, 100)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, words=2).collect()} == want


def test_drop_near_duplicates(groups):
    kept = drop_near_duplicates(groups)
    assert kept.columns == groups.columns
    ids = [r.doc_id for r in kept.collect()]
    firsts = {r.doc_id for r in near_duplicates(groups).collect() if r.kept and r.doc_id is not None}
    assert sorted(x for x in ids if x is not None) == sorted(firsts)
    assert ids.count(None) == 2


def test_near_duplicates_of_nothing(groups):
    assert near_duplicates(groups.limit(0)).count() == 0
    assert drop_near_duplicates(groups.limit(0)).count() == 0


def test_joint_estimate():
    rng = np.random.default_rng(4)
    for similarity in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            both = int(1000 * similarity)
            items = rng.integers(0, 2**63, size=2000 - both, dtype=np.uint64)
            a, b = np.unique(items[:1000]), np.unique(items[1000 - both :])
            got = joint_estimate(np.array([len(a)]), registers(a)[None], np.array([len(b)]), registers(b)[None])[0]
            errors.append(got - both / (2000 - both))
        assert abs(np.mean(errors)) < 0.03
        assert np.std(errors) < 0.07


@pytest.mark.parametrize(("count", "margin"), [(near_dedup.REGISTERS, near_dedup.MARGIN), (line_dedup.MINIMA, line_dedup.MARGIN)], ids=["documents", "lines"])
def test_estimates_lose_few_pairs(count, margin):
    """The exact binomial probability that the estimate of a pair at 0.8 falls below the margin."""
    assert sum(comb(count, k) * 0.8**k * 0.2 ** (count - k) for k in range(count + 1) if k / count < 0.8 - margin) < 1e-5


def test_registers_are_mergeable():
    a, b = shingle_set(b"a b c d e f", 2), shingle_set(b"d e f g h", 2)
    assert (registers(np.union1d(a, b)) == np.maximum(registers(a), registers(b))).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000, 1000 + k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2100)]
    parts = Union({x for e in edges for x in e})
    for u, v in edges:
        parts.join(u, v)
    want = {x: parts.root(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, (None, 1), (5, None)], "u long, v long")
    got = components(df).collect()
    assert len(got) == len(want)
    assert {r.node: r.component for r in got} == want
    assert components(df.limit(0)).count() == 0


def test_a_cluster_must_name_a_shared_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://elsewhere:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_sweep_deletes_intermediate_tables(spark):
    own = Table(spark.range(5).toDF("n"), "numbers")
    assert own.path.startswith(shared_dir(spark))
    assert own.df.count() == 5
    sweep(spark)
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        spark.read.parquet(own.path)


def test_line_signatures_agree_with_sets():
    rng = random.Random(6)
    lines = ["", "a", "abcdefg", "abcdefgh", "x" * 40_000, *["".join(rng.choice("abc ") for _ in range(rng.randint(1, 300))) for _ in range(50)]]
    lines = [x for x in lines if x]
    assert signatures(lines) == [signatures([x])[0] for x in lines]
    assert len(line_set("abcdefgh")) == len(line_set("abc")) == 1


def _line_rows(docs):
    found = {}
    for r in docs.collect():
        if r.doc_id is not None:
            for k, line in enumerate((r.text or "").split("\n")):
                if line.strip():
                    found[(r.doc_id, k)] = line.strip()
    return found


@pytest.fixture(scope="module")
def line_docs(spark):
    ship(spark)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(150)).strip() for _ in range(40)]
    rows = []
    for k in range(80):
        own = []
        for _ in range(6):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            own.append("".join(line))
        rows.append((k, "\n".join([*own, "", "shared line of all", "ab"])))
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, "shared line of all"), (5, rows[5][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("line_no", F.lit("clash"))


@pytest.mark.parametrize("which", ["documents", "fixture"])
def test_line_classes(docs, line_docs, which):
    table = docs if which == "documents" else line_docs
    lines = _line_rows(table)
    first = {}
    for place, line in sorted(lines.items()):
        first.setdefault(line, place)
    want = jaccard_components({p: frozenset(line_set(x).tolist()) for x, p in first.items()}, 80, 100)
    result = line_classes(table).collect()
    assert len(result) == len(lines)
    for r in result:
        place = want[first[lines[(r.doc_id, r.line_no)]]]
        assert (r.first_id, r.first_line_no, r.kept) == (*place, place == (r.doc_id, r.line_no))


def test_dedup_lines(line_docs):
    gone = {(r.doc_id, r.line_no) for r in line_classes(line_docs).collect() if not r.kept}
    texts = {r.doc_id: r.text for r in line_docs.collect()}
    result = dedup_lines(line_docs)
    assert result.columns == line_docs.columns
    for r in result.collect():
        old = texts[r.doc_id]
        if old is None:
            assert r.text is None
        else:
            assert r.text == "\n".join(x for k, x in enumerate(old.split("\n")) if (r.doc_id, k) not in gone)
    assert line_classes(line_docs.limit(0)).count() == 0


def test_lines_take_little_disk(spark, tmp_path, monkeypatch):
    """Tables of op4 hold the lines and no signatures; its packs of bands stay under 400 bytes a line."""
    rng = random.Random(12)
    count = 4_000
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(60)).strip() for _ in range(count)]
    spark.createDataFrame([(k, "\n".join(lines[k::40])) for k in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert op4_line_dedup(spark, str(tmp_path)).where("kept").count() == len(set(lines))
    assert sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*.parquet")) < 150 * count
    batch = pa.RecordBatch.from_arrays([pa.array(range(count), pa.int64()), pa.array([x.encode() for x in lines])], names=["node", "text"])
    packs = list(line_dedup._packed_bands(list(range(8)), 4)(iter([batch])))
    assert sum(len(x) for p in packs for x in p.column(1).to_pylist()) < 400 * count


def test_lines_travel_in_packs(monkeypatch):
    """Distinct lines are rows, all lines are in packs; the lines of a node in several packs know its first one."""
    monkeypatch.setattr(line_dedup, "PACK", 3)
    monkeypatch.setattr(line_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    rows = [(k, f"own {k}\nshared by all\n\nab\n shared by all ") for k in range(19, -1, -1)] + [(30, None), (31, "\n"), (3, "own 3")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["id", "text"])
    made = pa.Table.from_batches(list(line_dedup._numbered(line_dedup._packed_lines([5])(iter([batch]))))).to_pylist()
    texts = {r["node"]: r["text"].decode() for r in made if r["text"] is not None}
    lines = {(k, n): own for k, text in rows for n, line in enumerate((text or "").split("\n")) if (own := line.strip())}
    first = {own: min(p for p, x in lines.items() if x == own) for own in lines.values()}
    assert sorted(texts.values()) == sorted(first)
    packs = [(r["block"], r["data"]) for r in made if r["data"] is not None]
    found = {}
    for block, data in packs:
        own = list(zip(*[x.tolist() for x in line_dedup._unpacked(data)], strict=True))
        assert len(own) <= 3
        for place, id_, number, *least in own:
            assert (id_, number) not in found
            found[(id_, number)] = texts[(block << line_dedup.BLOCK_BITS) + place]
            assert tuple(least) == first[lines[(id_, number)]]
    assert found == lines
    node = next(n for n, text in texts.items() if text == "ab")
    won = pa.array([[{"node": node, "first_id": -1, "first_line_no": 7}]] * len(packs), pa.list_(pa.struct([("node", pa.int64()), ("first_id", pa.int64()), ("first_line_no", pa.int32())])))
    judged = pa.Table.from_batches(list(line_dedup._judged(iter([pa.RecordBatch.from_arrays([pa.array([d for _, d in packs]), won], names=["data", "own"])])))).to_pylist()
    for r in judged:
        place, line = (r["id"], r["line_no"]), lines[(r["id"], r["line_no"])]
        want = (-1, 7) if line == "ab" else first[line]
        assert ((r["first_id"], r["first_line_no"]), r["kept"]) == (want, want == place)


def test_a_line_of_more_documents_than_a_pack_holds(spark, tmp_path):
    count = line_dedup.PACK + 5_000
    spark.range(count).select(F.col("id").alias("doc_id"), F.lit("a line that all documents share").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    found = op4_line_dedup(spark, str(tmp_path)).groupBy("first_id", "first_line_no", "kept").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 0, False, count - 1), (0, 0, True, 1)]


def test_members_of_buckets_are_joined_once(spark, monkeypatch):
    """One join by bucket makes one row a member, and a group of twice the size gives twice the rows."""
    tables = []
    monkeypatch.setattr(linking, "CHUNK", 50)
    monkeypatch.setattr(linking, "written", lambda df, name: tables.append(name) or scratch.written(df, name))
    rows = {}
    for n in (200, 400):
        # a group of near copies and a foreign line in one bucket, and a bucket that is not mixed
        labelled = spark.range(n + 1).selectExpr("0 AS no", "7L AS band", "id AS node", f"IF(id = {n}, id, 0L) AS component")
        labelled = labelled.union(spark.range(n).selectExpr("1", "8L", "id", "0L"))
        dealt = linking._dealt(labelled)
        assert dealt._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
        found = dealt.collect()
        assert {r.band for r in found} == {7}
        groups = {r.node: {(x.i, x.j) for x in found if x.node == r.node} for r in found if r.node == n}
        assert all({(r.i, r.j)} <= groups[n] for r in found)
        rows[n] = len(found)
    assert not tables
    assert 200 < rows[200] and rows[400] <= 2 * rows[200]


def test_one_changed_character_in_short_lines(spark, tmp_path):
    """op4 against brute force over 4-character shingles made without the operator's code."""
    ship(spark)
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in range(20, 81) for _ in range(3)]
    edited = []
    for line in base:
        at = rng.randrange(len(line))
        edited.append(line[:at] + rng.choice("XYZ") + line[at + 1 :])
    spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(edited))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    grams = lambda line: {line[k : k + 4] for k in range(len(line) - 3)}
    found = {r.line_no: (r.first_id, r.first_line_no) for r in op4_line_dedup(spark, str(tmp_path)).where("doc_id = 2").collect()}
    assert found == {k: (1, k) if near(grams(a), grams(b)) else (2, k) for k, (a, b) in enumerate(zip(base, edited, strict=True))}
    assert all(found[k] == (1, k) for k, line in enumerate(base) if len(line) >= 40)


def _near_vectors(rows, least):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None for x in r[1]) and np.isfinite(r[1]).all() and np.any(r[1])]
    ids = sorted({r[0] for r in rows if r[0] is not None})
    links, parts = {k: set() for k in ids}, Union(ids)
    for a in ok:
        for b in ok:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= least:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
                    parts.join(a[0], b[0])
    return {k: (len(links[k]), parts.root(k)) for k in ids}


@pytest.mark.parametrize("least", [0.93, 0.6])
def test_embeddings(spark, least):
    ship(spark)
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for size in (20, 20, 3):
        for _ in range(12):
            center = rng.normal(size=size)
            for _ in range(rng.integers(1, 9)):
                rows.append((k, (center + rng.normal(size=size) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
                k += 1
    hot = rows[0][1]
    rows += [(k + i, hot, 0) for i in range(40)]
    k += 40
    rows += [(k, None, 0), (k + 1, [0.0] * 20, 0), (k + 2, [float("nan")] * 20, 0), (k + 3, [None] * 20, 0), (k + 4, hot, None), (k + 5, [], 0), (k + 6, [x * 7 for x in hot], 0), rows[0], (None, hot, 0), (k + 7, [float("inf")] * 20, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumn("node", F.lit("clash")).withColumn("id", F.lit("clash"))
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = _near_vectors(exact, least)
    result = near_embeddings(df, least).collect()
    assert len(result) == len(rows)
    for r in result:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id]
            assert r.kept == (r.component_id == r.vec_id)
    assert near_embeddings(df.limit(0)).count() == 0


def test_embeddings_of_ids_with_several_vectors(spark):
    ship(spark)
    a, near, far, other = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    table = spark.createDataFrame([(1, a, 0), (1, near, 0), (2, far, 0), (2, a, 0), (3, other, 0), (1, a, 0)], "vec_id long, embedding array<float>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in near_embeddings(table).collect())
    assert found == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1)]


def test_pipeline(spark, sf_dir, docs, tmp_path):
    found, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = found
        stage(spark, found, sf_dir).write.parquet(str(tmp_path / str(k)))
        found = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (before, found)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
    before, after = kept["near_dedup"]
    sets = {r.doc_id: word_shingles(r.text, 5) for r in before.collect()}
    groups = jaccard_components({k: s for k, s in sets.items() if s}, 80, 100)
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k in sets if groups.get(k, k) == k)
    before, after = kept["decontamination"]
    gone = {r.doc_id for r in find_leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert gone
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.drop("slot").collect())) == sorted(map(str, found.drop("slot").collect()))
    assert found.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the words and the words", "en", None, 1), (3, "the words and more of them", "en", "a", 1), (3, "the words and more of them", "en", "a", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for own in (table, table.limit(0)):
        result = stage[1](spark, own, sf_dir)
        assert set(own.columns) <= set(result.columns)
        assert result.count() <= 2 * len(rows)
