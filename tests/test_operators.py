"""Operators on small fixtures with known results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import dims, text
from tessera.operators import image, logic, mutations, rust_strings, scoring, signatures
from tessera.operators.findings import find
from tessera.sources import readers, sinks
from tessera.streaming import events as streaming


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("content", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("\n", 1)])
def test_line_count(spark, content, lines):
    assert one(spark, text.line_count(F.col("c")), c=content) == lines
    if content:
        assert one(spark, F.size(text.lines(F.col("c"))), c=content) == lines


def test_overlapping_needles_count_independently(spark):
    assert one(spark, text.literal_sum(F.col("c"), ["go func", "go "]), c="go func() {}\ngo x\ngo y") == 4


@pytest.mark.parametrize(
    ("source", "left"),
    [('let s = "unsafe {";', 'let s = "";'), ('r#"a"b"#x', 'r#" "#x'), ("'a' 'static", "'a' 'static"), ('"a\\"b" c', '"" c'), ('// "x" y', '// "" y')],
)
def test_rust_literals(source, left):
    assert rust_strings.stripper()(source) == left


def test_file_score(spark):
    row = dict.fromkeys(("panic_sites", "unwrap_calls", "allocation_sites", "io_operations", "threading_constructs"), 0)
    df = spark.createDataFrame([{"lines": 100, **row, "unsafe_blocks": 3, "panic_sites": 2}, {"lines": 0, **row, "unsafe_blocks": 0}])
    assert sorted(r[0] for r in df.select(scoring.file_score()).collect()) == [0.0, 14.0]


def test_risk_of_repositories(spark):
    df = spark.createDataFrame([("a", 10, 2000, 5, 1, 2), ("b", 3, 500, 0, 0, 0)], "repo string, total_files long, total_lines long, weak_points long, critical long, high long")
    found = {r["repo"]: round(r["risk"], 6) for r in scoring.with_risk(df).collect()}
    assert found == {"a": 0.437823, "b": 0.075858}


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "a0 string, a1 string")
    assert logic.forward_chain({"data_flow": edges}, logic.TAINT_RULES[:1])["data_flow"].count() == 10


def test_empty_relations_derive_nothing(spark):
    empty = spark.createDataFrame([], "a0 string, a1 string")
    assert logic.forward_chain({"data_flow": empty}, logic.TAINT_RULES)["data_flow"].count() == 0


def test_taint_rules(spark):
    facts = {
        "taint_source": spark.createDataFrame([("handler.ex", "NetworkRead")], "a0 string, a1 string"),
        "data_flow": spark.createDataFrame([("handler.ex", "query.ex")], "a0 string, a1 string"),
        "taint_sink": spark.createDataFrame([("query.ex", "SqlQuery")], "a0 string, a1 string"),
    }
    derived = logic.forward_chain(facts, logic.TAINT_RULES)
    assert derived["tainted_file"].count() == derived["exploitable"].count() == derived["tainted_path"].count() == 1


def test_language_boundaries(spark):
    families = spark.createDataFrame([("beam",), ("systems",), ("ml",)], "f string")
    pairs = families.select(F.col("f").alias("a0")).join(families.select(F.col("f").alias("a1")), F.col("a0") < F.col("a1"))
    calls = spark.createDataFrame([("x", "foreign", "CFfi")], "a0 string, a1 string, a2 string")
    weak = spark.createDataFrame([("UnsafeCode", "x")], "a0 string, a1 string")
    derived = logic.forward_chain({"language_boundary": pairs, "cross_lang_call": calls, "weak_point": weak}, logic.CROSS_RULES)
    assert derived["active_boundary"].count() == 3
    assert derived["ffi_risk"].count() == 1


@pytest.mark.parametrize(
    ("stderr", "signal", "expected"),
    [("ERROR: use-after-free detected", None, "UseAfterFree"), ("double free or corruption", None, "DoubleFree"), ("segmentation fault", "SIGSEGV", "NullPointerDeref"),
     ("LeakSanitizer: detected memory leaks", None, "MemoryLeak"), ("thread write store read load concurrent", None, "DataRace")],
)
def test_signatures(spark, stderr, signal, expected):
    crashes = spark.createDataFrame([("x", stderr, signal)], "id string, stderr string, signal string")
    assert expected in {r["signature"] for r in signatures.signatures(crashes).collect()}
    quiet = spark.createDataFrame([("x", "program exited normally", None), ("y", None, None)], "id string, stderr string, signal string")
    assert signatures.signatures(quiet).count() == 0


def test_snapshot_diff(spark):
    cols = "id string, health double, risk double, weak_points long"
    older = spark.createDataFrame([("a", 0.5, 0.5, 1), ("b", 0.9, 0.1, 0), ("c", 0.5, 0.5, 3)], cols)
    newer = spark.createDataFrame([("a", 0.8, 0.2, 0), ("c", 0.505, 0.495, 3), ("d", 1.0, 0.0, 0)], cols)
    assert {r["id"]: r["status"] for r in image.diff(older, newer).collect()} == {"a": "improved", "b": "removed", "c": "unchanged", "d": "new"}


def test_swap_and_delete(spark):
    own, n = mutations.apply(F.col("c"), mutations.Operation("swap", "allow", "deny"))
    assert one(spark, own, c="allow deny allow") == "deny allow deny"
    assert one(spark, n, c="allow deny allow") == 3
    own, n = mutations.apply(F.col("c"), mutations.Operation("duplicate_lines", "x", times=2))
    assert one(spark, own, c="x\ny") == "x\nx\nx\ny"


def test_source_tree_and_pack(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.rs").write_text("unsafe { x }\n")
    (tmp_path / "src" / "b.py").write_bytes("caf\xe9 \x80".encode("latin-1"))
    (tmp_path / "target" / "c.rs").write_text("unsafe {}")
    (tmp_path / "readme.xyz").write_text("none")
    tree = {r["path"].rsplit("/", 1)[1]: r for r in readers.source_tree(spark, str(tmp_path)).collect()}
    assert set(tree) == {"a.rs", "b.py"}
    assert tree["b.py"]["content"] == "café €"
    pack = tmp_path / "pack.json"
    pack.write_text(json.dumps([{"id": "X1", "languages": ["rust"], "test": {"any_of": ["unsafe {"]}, "category": "UnsafeCode", "severity": "High", "axes": ["memory"], "says": "unsafe"}]))
    files = readers.source_tree(spark, str(tmp_path)).withColumn("repo", F.lit("r"))
    assert [r["rule"] for r in find(files, readers.rule_pack(str(pack))).collect()] == ["X1"]


def test_reports_and_sarif(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"program_path": "x", "weak_points": [{"category": "UnsafeCode", "severity": "High"}]}))
    (tmp_path / "empty.json").write_text(json.dumps({"program_path": "y"}))
    found = {r["program_path"]: len(r["weak_points"]) for r in readers.reports(spark, str(tmp_path)).collect()}
    assert found == {"x": 1, "y": 0}
    findings = spark.createDataFrame([("r", "a.rs", "W01", "UnsafeCode", "High", ["memory"], 'x "y"')], "repo string, file string, rule string, category string, severity string, axes array<string>, description string")
    sinks.write_sarif(findings, str(tmp_path / "out"))
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "results")).collect()]
    assert json.loads(line)["ruleId"] == "PA004"


def test_latest_reports(spark):
    listing = spark.createDataFrame([("b.json",), ("a.json",), ("c.yaml",)], "path string")
    assert [r["path"] for r in readers.latest(listing, 1).collect()] == ["b.json"]
    with pytest.raises(ValueError, match="fewer"):
        readers.latest(listing, 3)


def test_bundles():
    assert readers.parse_bundle('(bundle (kind "a \\"b\\"") (version 1))') == [["bundle", ["kind", 'a "b"'], ["version", "1"]]]
    with pytest.raises(ValueError, match="unbalanced"):
        readers.parse_bundle("(a")


def test_extensions_are_unique():
    exts = [r[0] for r in dims.language_rows()]
    assert len(exts) == len(set(exts))
    assert len(dims.EXTENSIONS) == 47
    assert len(dims.CATEGORIES) == 20


def test_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed(streaming.event_stream(spark, str(tmp_path / "in"), batch.schema))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in streaming.windowed(batch).select("event_type", "start", "n").collect()}
    assert {tuple(r) for r in spark.table("windows").select("event_type", "start", "n").collect()} == want
