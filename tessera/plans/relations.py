"""Queries: joins, logic, images, diffs, runs and dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dims, text
from tessera.operators import bridge, image, logic, scoring, signatures
from tessera.operators import findings as FD
from tessera.operators.contexts import contexts, contexts_sql
from tessera.operators.packs import CORPUS_RULES
from tessera.plans.common import BASE, counted, found, scored
from tessera.plans.registry import register
from tessera.sources import bindings, sinks
from tessera.sources.bindings import table

# --- taint and logic -------------------------------------------------------

_SOURCES = dims.values_sql("category, source", list(dims.TAINT_SOURCES.items()))
_SINKS = dims.values_sql("category, sink", list(dims.TAINT_SINKS.items()))
_FACTS = f"""
tsource AS (SELECT DISTINCT file AS a0, source AS a1 FROM findings JOIN (SELECT * FROM {_SOURCES}) USING (category)),
tsink AS (SELECT DISTINCT file AS a0, sink AS a1 FROM findings JOIN (SELECT * FROM {_SINKS}) USING (category)),
flow0 AS (
  SELECT DISTINCT s.a0 AS a0, k.a0 AS a1 FROM tsource s JOIN tsink k ON regexp_extract(s.a0, '^(.*)/[^/]*$', 1) = regexp_extract(k.a0, '^(.*)/[^/]*$', 1)
)"""


def taint_facts(findings: DataFrame) -> dict[str, DataFrame]:
    """taint_source, taint_sink and data_flow: findings that imply a source or a sink, and flows within a folder.

    The same file lies in the same folder, so one equi-join on the folder
    covers both; facts are made distinct before they meet.
    """
    spark = findings.sparkSession
    of = lambda rows, name: findings.join(F.broadcast(dims.values(spark, f"category, {name}", list(rows.items()))), "category").select(F.col("file").alias("a0"), F.col(name).alias("a1")).distinct()
    source, sink = of(dims.TAINT_SOURCES, "source"), of(dims.TAINT_SINKS, "sink")
    place = lambda df, name: df.select(F.col("a0").alias(name), text.directory(F.col("a0")).alias("dir")).distinct()
    flow = place(source, "a0").join(place(sink, "a1"), "dir").select("a0", "a1").distinct()
    return {"taint_source": source, "taint_sink": sink, "data_flow": flow}


@register(BASE + f", {_FACTS} SELECT 'source' AS kind, a0 AS file, a1 AS value FROM tsource UNION ALL SELECT 'sink', a0, a1 FROM tsink")
def prj11_taint_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = taint_facts(found(spark, sf_dir))
    part = lambda name, kind: facts[name].select(F.lit(kind).alias("kind"), F.col("a0").alias("file"), F.col("a1").alias("value"))
    return part("taint_source", "source").union(part("taint_sink", "sink"))


@register(BASE + f", {_FACTS} SELECT a0, a1 FROM flow0")
def jn11_data_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint_facts(found(spark, sf_dir))["data_flow"]


@register(
    BASE
    + f""", {_FACTS},
    tainted AS (SELECT DISTINCT f.a1 AS a0, s.a1 AS a1 FROM tsource s JOIN flow0 f ON s.a0 = f.a0),
    exploitable AS (SELECT DISTINCT t.a0, t.a1, k.a1 AS a2 FROM tainted t JOIN tsink k USING (a0)),
    path AS (SELECT DISTINCT s.a0, s.a1, f.a1 AS a2, k.a1 AS a3 FROM tsource s JOIN flow0 f ON s.a0 = f.a0 JOIN tsink k ON f.a1 = k.a0)
    SELECT a0 AS source_file, a0 AS sink_file, a1 AS source, a2 AS sink, 0.8::DOUBLE AS confidence FROM exploitable
    UNION ALL SELECT a0, a2, a1, a3, 0.85::DOUBLE FROM path"""
)
def lg11_se05_taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that the taint rules derive, but for the closure: folders already are complete graphs."""
    facts = taint_facts(found(spark, sf_dir))
    derived = logic.forward_chain(facts, logic.TAINT_RULES[1:])
    reached = derived["exploitable"].select(F.col("a0").alias("source_file"), F.col("a0").alias("sink_file"), F.col("a1").alias("source"), F.col("a2").alias("sink"), F.lit(0.8).alias("confidence"))
    paths = derived["tainted_path"].select(F.col("a0").alias("source_file"), F.col("a2").alias("sink_file"), F.col("a1").alias("source"), F.col("a3").alias("sink"), F.lit(0.85).alias("confidence"))
    return reached.unionByName(paths)


_WHOLE_EDGES_SQL = "whole_edges AS (SELECT DISTINCT 'n' || l_suppkey AS a0, 'n' || (l_partkey * 7 + 3) AS a1 FROM lineitem)"


@register(f"WITH RECURSIVE {_WHOLE_EDGES_SQL}, reach AS (SELECT a0, a1 FROM whole_edges UNION SELECT r.a0, e.a1 FROM reach r JOIN whole_edges e ON r.a1 = e.a0) SELECT a0, a1 FROM reach")
def jn04_lg05_closure_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure over every row of lineitem: the semi-naive fixpoint on inner nodes, the rest by classes of them; on numbers, which get names last."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_suppkey").cast("long").alias("a0"), (F.col("l_partkey") * 7 + 3).cast("long").alias("a1"))
    return logic.closure(edges, lambda node: F.concat(F.lit("n"), node.cast("string")))


_PARENTS = [("ida", "kurt"), ("ida", "vera"), ("kurt", "otto"), ("kurt", "emil"), ("emil", "nora"), ("vera", "hugo")]


@register(
    f"""WITH p AS (SELECT * FROM {dims.values_sql('a0, a1', _PARENTS)})
    SELECT 'grandparent' AS relation, a.a0 AS x, b.a1 AS y FROM p a JOIN p b ON a.a1 = b.a0 UNION ALL SELECT 'child_of_ida', 'ida', a1 FROM p WHERE a0 = 'ida'
    UNION ALL SELECT 'sibling', a.a1, b.a1 FROM p a JOIN p b ON a.a0 = b.a0"""
)
def jn01_lg02_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants, shared variables and several rules through the compiler."""
    rules = logic.parse_program("""
        grandparent(X, Z) :- parent(X, Y), parent(Y, Z).
        child_of_ida('ida', X) :- parent(ida, X).
        sibling(A, B) :- parent(P, A), parent(P, B).
    """)
    derived = logic.forward_chain({"parent": dims.values(spark, "a0, a1", _PARENTS)}, rules)
    parts = [derived[n].select(F.lit(n).alias("relation"), F.col("a0").alias("x"), F.col("a1").alias("y")) for n in ("grandparent", "child_of_ida", "sibling")]
    return parts[0].union(parts[1]).union(parts[2])


_MECHANISMS = dims.values_sql("language, mechanism", list(dims.FFI_MECHANISMS.items()))
_CALLS = f"""
calls AS (
  SELECT DISTINCT f.path AS a0, 'foreign' AS a1, coalesce(m.mechanism, 'Subprocess') AS a2
  FROM files f JOIN findings g ON g.file = f.path LEFT JOIN (SELECT * FROM {_MECHANISMS}) m USING (language) WHERE g.category = 'UnsafeCode'
)"""


def cross_calls(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, foreign, mechanism) of files with unsafe code."""
    known = F.broadcast(dims.values(files.sparkSession, "language, mechanism", list(dims.FFI_MECHANISMS.items())))
    unsafe = findings.where("category = 'UnsafeCode'").select(F.col("file").alias("path")).distinct()
    return files.join(unsafe, "path", "left_semi").join(known, "language", "left").select(F.col("path").alias("a0"), F.lit("foreign").alias("a1"), F.coalesce("mechanism", F.lit("Subprocess")).alias("a2"))


@register(
    BASE
    + f""", {_FACTS}, {_CALLS}, fam AS (SELECT DISTINCT family FROM files WHERE family <> 'unknown')
    SELECT DISTINCT 'ffi_risk' AS relation, c.a0 AS x, c.a2 AS y FROM calls c JOIN findings f ON f.file = c.a0 AND f.category = 'UnsafeCode' UNION ALL
    SELECT DISTINCT 'serialization_risk', c.a0, c.a0 FROM calls c JOIN tsource s USING (a0) WHERE c.a2 = 'SharedFile' UNION ALL
    SELECT DISTINCT 'cross_lang_vuln', c.a0, c.a1 FROM calls c JOIN tsource s ON s.a0 = c.a0 JOIN tsink k ON k.a0 = c.a1 UNION ALL
    SELECT 'active_boundary', a.family, b.family FROM fam a JOIN fam b ON a.family < b.family WHERE EXISTS (SELECT 1 FROM calls)"""
)
def lg12_jn07_jn08_jn18_cross_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, findings = bindings.files(spark, sf_dir), found(spark, sf_dir)
    families = files.where("family <> 'unknown'").select("family").distinct()
    # at most 19 families
    pairs = families.select(F.col("family").alias("a0")).join(families.select(F.col("family").alias("a1")), F.col("a0") < F.col("a1"))
    weak = findings.select(F.col("category").alias("a0"), F.col("file").alias("a1")).distinct()
    facts = {"cross_lang_call": cross_calls(files, findings), "language_boundary": pairs, "weak_point": weak}
    facts |= {name: df for name, df in taint_facts(findings).items() if name != "data_flow"}
    derived = logic.forward_chain(facts, logic.CROSS_RULES)
    part = lambda n, y: derived[n].select(F.lit(n).alias("relation"), F.col("a0").alias("x"), F.col(y).alias("y"))
    parts = [part(n, y) for n, y in (("ffi_risk", "a1"), ("active_boundary", "a1"), ("serialization_risk", "a0"), ("cross_lang_vuln", "a1")) if n in derived]
    return reduce(DataFrame.union, parts)


_CONTEXT = contexts_sql()


@register(
    BASE
    + f""", {_CONTEXT}, s AS (SELECT * FROM {dims.values_sql('category, ctx, confidence', dims.SUPPRESSIONS)})
    SELECT f.file, f.category, max(s.confidence) AS confidence FROM (SELECT DISTINCT file, category FROM findings) f JOIN context c USING (file)
    JOIN s ON s.ctx = c.ctx AND (s.category = f.category OR s.category = '*') GROUP BY ALL"""
)
def jn10_lg09_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a context of their file suppresses; ``*`` rules are spread over the categories so that the join stays an equi-join."""
    rows = [(c, ctx, p) for cat, ctx, p in dims.SUPPRESSIONS for c in (dims.CATEGORIES if cat == "*" else [cat])]
    rules = F.broadcast(dims.values(spark, "category, ctx, confidence", rows))
    weak = found(spark, sf_dir).select("file", "category").distinct()
    return weak.join(contexts(counted(spark, sf_dir), found(spark, sf_dir)), "file").join(rules, ["category", "ctx"]).groupBy("file", "category").agg(F.max("confidence").alias("confidence"))


@register(
    BASE
    + f""", {_FACTS}, {_CONTEXT} SELECT 'taint_source' AS relation, count(*) AS n FROM tsource UNION ALL SELECT 'taint_sink', count(*) FROM tsink
    UNION ALL SELECT 'data_flow', count(*) FROM flow0 UNION ALL SELECT 'context', count(*) FROM context"""
)
def ag23_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = taint_facts(found(spark, sf_dir)) | {"context": contexts(counted(spark, sf_dir), found(spark, sf_dir))}
    return logic.cardinalities(spark, tables)


@register(BASE + f""", {_FACTS} SELECT 'taint_sink' AS relation, 'taint_sink(''' || replace(a0, '''', '''''') || ''', ''' || a1 || ''').' AS line FROM tsink""")
def snk04_logtalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.logtalk({"taint_sink": taint_facts(found(spark, sf_dir))["taint_sink"]})


# --- images and diffs ------------------------------------------------------

def _image(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Image of the documents with odd or even ids: two snapshots of one corpus."""
    number = F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("long")
    files = counted(spark, sf_dir).where(number % 2 == odd)
    return scoring.with_risk(scoring.repo_results(files, FD.find(files, CORPUS_RULES))).withColumnRenamed("repo", "id")


def _image_sql(name: str, odd: int) -> str:
    return f"""
{name}_files AS (SELECT * FROM counted WHERE regexp_extract(path, 'doc_([0-9]+)', 1)::BIGINT % 2 = {odd}),
{name}_raw AS (
  SELECT f.repo AS id, f.total_lines, coalesce(weak_points, 0) AS weak_points, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high
  FROM (SELECT repo, sum(lines)::BIGINT AS total_lines FROM {name}_files GROUP BY repo) f LEFT JOIN (
    SELECT g.repo, count(*) AS weak_points, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high
    FROM findings g WHERE regexp_extract(g.file, 'doc_([0-9]+)', 1)::BIGINT % 2 = {odd} GROUP BY g.repo) USING (repo)
),
{name} AS (
  SELECT *, 1 - risk AS health FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-((3 * critical + 2 * high + weak_points - critical - high) / (greatest(total_lines, 1) / 1000.0::DOUBLE) - 5.0::DOUBLE) * 0.5::DOUBLE)) AS risk FROM {name}_raw)
)"""


_BOTH = BASE + ", " + _image_sql("older", 0) + ", " + _image_sql("newer", 1)


@register(
    _BOTH
    + """ SELECT id, round(o.health, 6) AS health_before, round(n.health, 6) AS health_after, o.weak_points AS weak_points_before, n.weak_points AS weak_points_after,
    CASE WHEN o.health IS NULL THEN 'new' WHEN n.health IS NULL THEN 'removed' WHEN abs(n.health - o.health) < 0.01 THEN 'unchanged' WHEN n.health > o.health THEN 'improved' ELSE 'degraded' END AS status
    FROM older o FULL JOIN newer n USING (id)"""
)
def jn14_jn15_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = image.diff(_image(spark, sf_dir, 0), _image(spark, sf_dir, 1))
    return both.select("id", F.round("health_before", 6).alias("health_before"), F.round("health_after", 6).alias("health_after"), "weak_points_before", "weak_points_after", "status")


@register(
    _BOTH
    + """, t AS (SELECT (SELECT avg(health) FROM newer) - (SELECT avg(health) FROM older) AS h, (SELECT sum(weak_points) FROM newer) - (SELECT sum(weak_points) FROM older) AS w,
      (SELECT count(*) FROM older o JOIN newer n USING (id) WHERE n.health - o.health >= 0.01) AS improved, (SELECT count(*) FROM older o JOIN newer n USING (id) WHERE n.health - o.health <= -0.01) AS degraded)
    SELECT round(h, 6) + 0.0 AS health_delta, w::BIGINT AS weak_points_delta, improved, degraded,
      CASE WHEN h > 0.02 AND degraded = 0 THEN 'improving' WHEN h < -0.02 AND improved = 0 THEN 'degrading' WHEN abs(h) < 0.01 THEN 'stable' ELSE 'mixed' END AS trend FROM t"""
)
def prj15_prj16_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = image.trend_of(_image(spark, sf_dir, 0), _image(spark, sf_dir, 1))
    return one.select(
        (F.round("global_health_delta", 6) + 0.0).alias("health_delta"), F.col("weak_points_delta"), F.col("n_improved").alias("improved"), F.col("n_degraded").alias("degraded"), "trend"
    )


@register(
    BASE
    + """ SELECT round(avg(health), 6) AS global_health, round(avg(risk), 6) AS global_risk, sum(weak_points)::BIGINT AS weak_points, count(*) FILTER (bucket = 'healthy') AS n_healthy,
    count(*) FILTER (bucket = 'low') AS n_low, count(*) FILTER (bucket = 'moderate') AS n_moderate, count(*) FILTER (bucket = 'high') AS n_high, count(*) FILTER (bucket = 'critical') AS n_critical FROM scored"""
)
def ag10_ag11_image_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = image.image_totals(scored(spark, sf_dir))
    return total.withColumns({c: F.round(c, 6) for c in ("global_health", "global_risk")}).drop("critical", "total_lines")


_NODES = "numbered AS (SELECT repo AS id, *, row_number() OVER (ORDER BY weak_points DESC, repo) AS ix FROM scored)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.numbered(scored(spark, sf_dir).withColumnRenamed("repo", "id"))


@register(
    BASE
    + f""", {_NODES} SELECT a.id AS a, b.id AS b, round(1 - abs(a.risk - b.risk) / 0.15, 6) AS weight FROM numbered a JOIN numbered b ON a.ix < b.ix AND abs(a.risk - b.risk) < 0.15 AND a.risk > 0.3"""
)
def jn12_proximity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.proximity_edges(_nodes(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@register(
    BASE
    + f""", {_NODES}, counts AS (SELECT repo AS id, category, count(*) AS n FROM findings GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, category) AS k FROM counts QUALIFY k = 1)
    SELECT a.id AS a, b.id AS b, 0.8::DOUBLE AS weight FROM best JOIN numbered a ON a.id = best.id AND best.n >= 3 JOIN counts c ON c.category = best.category AND c.n >= 3 JOIN numbered b ON b.id = c.id AND a.ix < b.ix"""
)
def jn13_pattern_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = found(spark, sf_dir).groupBy(F.col("repo").alias("id"), "category").agg(F.count("*").alias("n"))
    return image.pattern_edges(counts, _nodes(spark, sf_dir).select("id", "ix"))


@register(
    BASE
    + """, p AS (SELECT DISTINCT category, regexp_extract(file, 'doc_([0-9]+)', 1)::BIGINT % 2 AS odd, repo FROM findings)
    SELECT 'removed' AS change, category, repo FROM p a WHERE odd = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.odd = 1 AND b.category = a.category AND b.repo = a.repo)
    UNION ALL SELECT 'added', category, repo FROM p a WHERE odd = 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.odd = 0 AND b.category = a.category AND b.repo = a.repo)"""
)
def jn16_se03_changed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.regexp_extract("file", r"doc_([0-9]+)", 1).cast("long") % 2
    p = found(spark, sf_dir).select("category", "repo", odd.alias("odd")).distinct()
    before, after = (p.where(F.col("odd") == k).drop("odd") for k in (0, 1))
    side = lambda a, b, name: a.join(b, ["category", "repo"], "left_anti").select(F.lit(name).alias("change"), "category", "repo")
    return side(before, after, "removed").union(side(after, before, "added"))


_GRAPH = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "f"), ("b", "g"), ("h", "h")]


@register(
    f"""WITH e AS (SELECT * FROM {dims.values_sql('x, y', _GRAPH)}), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    one AS (SELECT x AS node, y AS near FROM u WHERE x <> y), two AS (SELECT node, near FROM one UNION SELECT o.node, u.y FROM one o JOIN u ON o.near = u.x)
    SELECT node, near FROM two WHERE node <> near"""
)
def se06_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps, edges taken both ways."""
    e = dims.values(spark, "x, y", _GRAPH)
    both = e.union(e.select("y", "x")).distinct()
    one = both.where("x <> y").select(F.col("x").alias("node"), F.col("y").alias("near"))
    two = one.join(both, one["near"] == both["x"]).select("node", F.col("y").alias("near"))
    return one.union(two).distinct().where("node <> near")


# --- runs, signals and signatures -----------------------------------------

_RUN = "runs AS (SELECT event_id, event_type AS axis, user_id, value, event_type = 'error' AS failed, value < 5 AS skipped, epoch_us(ts) // 1000 AS start_ms FROM events)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("axis"), "user_id", "value", (F.col("event_type") == "error").alias("failed"), (F.col("value") < 5).alias("skipped"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("start_ms"))


_STATUS = "CASE WHEN skipped THEN 'skipped' WHEN failed THEN 'failed' ELSE 'passed' END"


def _status():
    return F.when(F.col("skipped"), "skipped").when(F.col("failed"), "failed").otherwise("passed")


@register(f"WITH {_RUN} SELECT axis, count(*) FILTER ({_STATUS} = 'passed') AS passed, count(*) FILTER ({_STATUS} = 'failed') AS failed, count(*) FILTER ({_STATUS} = 'skipped') AS skipped FROM runs GROUP BY axis")
def ag08_prj13_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumn("status", _status())
    return runs.groupBy("axis").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")])


@register(f"WITH {_RUN} SELECT user_id, CASE WHEN bool_or(NOT skipped AND failed) THEN 'failed' WHEN bool_or(skipped) THEN 'skipped' ELSE 'passed' END AS status FROM runs GROUP BY user_id")
def ag09_axis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.bool_or(~F.col("skipped") & F.col("failed"))
    return _runs(spark, sf_dir).groupBy("user_id").agg(F.when(failed, "failed").when(F.bool_or("skipped"), "skipped").otherwise("passed").alias("status"))


@register(
    f"""WITH {_RUN}, a AS (SELECT user_id, count(*) AS n FROM runs WHERE axis = 'click' AND skipped GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM runs WHERE axis = 'view' AND skipped GROUP BY 1)
    SELECT user_id, coalesce(a.n::VARCHAR, '-') AS base, coalesce(b.n::VARCHAR, '-') AS compare FROM a FULL JOIN b USING (user_id)"""
)
def jn23_compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).where("skipped")
    of = lambda axis, name: runs.where(F.col("axis") == axis).groupBy("user_id").agg(F.count("*").cast("string").alias(name))
    return of("click", "base").join(of("view", "compare"), "user_id", "full_outer").select("user_id", F.coalesce("base", F.lit("-")).alias("base"), F.coalesce("compare", F.lit("-")).alias("compare"))


@register(f"WITH {_RUN} SELECT user_id, max(start_ms + (value * 1000)::BIGINT)::BIGINT AS ends_ms, max(value) AS peak, count(*) AS events FROM runs GROUP BY user_id")
def ag22_timeline_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("start_ms") + F.round(F.col("value") * 1000).cast("long")
    return _runs(spark, sf_dir).groupBy("user_id").agg(F.max(end).alias("ends_ms"), F.max("value").alias("peak"), F.count("*").alias("events"))


@register(
    f"""WITH {_RUN}, o AS (SELECT user_id, event_id, start_ms, max(start_ms + (value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM runs)
    SELECT user_id, event_id, busy - start_ms AS overlap_ms FROM o WHERE busy > start_ms"""
)
def stm2_so08_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that begin while an earlier one of the same program still runs."""
    runs = _runs(spark, sf_dir).withColumn("end", F.col("start_ms") + F.round(F.col("value") * 1000).cast("long"))
    before = Window.partitionBy("user_id").orderBy("start_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("busy", F.max("end").over(before)).where("busy > start_ms").select("user_id", "event_id", (F.col("busy") - F.col("start_ms")).alias("overlap_ms"))


@register(f"WITH {_RUN} SELECT axis || '-' || row_number() OVER (PARTITION BY axis, user_id ORDER BY event_id) AS id, event_id, (row_number() OVER (PARTITION BY axis, user_id ORDER BY event_id)) % 5 = 0 AS checkpoint FROM runs")
def wn03_wn05_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("axis", "user_id").orderBy("event_id"))
    runs = _runs(spark, sf_dir).withColumn("n", number)
    return runs.select(F.concat("axis", F.lit("-"), F.col("n").cast("string")).alias("id"), "event_id", (F.col("n") % 5 == 0).alias("checkpoint"))


CRASHES = [
    ("c1", "buffer from malloc: free was called, next use is an access", None), ("c2", "report: heap use-after-free at frame 3", None), ("c3", "abort: double free found by the allocator", None),
    ("c4", "worker A waiting for lock of B: deadlock, mutex held twice", None), ("c5", "thread 1 did write (store) while thread 2 did read (load): concurrent", None), ("c6", "a segmentation fault stopped the run", "SIGSEGV"),
    ("c7", "AddressSanitizer says heap-buffer-overflow here", None), ("c8", "LeakSanitizer: 3 objects, memory leaks", None), ("c9", "all jobs done", None), ("c10", "", None),
    ("c11", "page freed by the pool, accessed later; overflow when adding", "SIGABRT"),
]


def _any_sql(words, column: str = "stderr") -> str:
    one = lambda w: f"contains({column}, {dims.literal_sql(w)})" if isinstance(w, str) else "(" + " AND ".join(map(one, w)) + ")"
    return "(" + " OR ".join(map(one, words)) + ")"


def _signatures_sql(source: str, signal: bool) -> str:
    parts = []
    for name, (facts, confidence) in signatures.FACT_RULES.items():
        holds = " AND ".join(_any_sql(signatures.FACT_WORDS[f]) for f in facts)
        parts.append(f"SELECT id, '{name}' AS signature, {confidence}::DOUBLE AS confidence, 'rule' AS origin FROM {source} WHERE {holds}")
    for name, (words, confidence) in signatures.PATTERNS.items():
        holds = _any_sql(words) + (" OR signal = 'SIGSEGV'" if signal and name == "NullPointerDeref" else "")
        parts.append(f"SELECT id, '{name}', {confidence}::DOUBLE, 'pattern' FROM {source} WHERE {holds}")
    return " UNION ALL ".join(parts)


@register(f"WITH crashes AS (SELECT * FROM {dims.values_sql('id, stderr, signal', CRASHES)}) {_signatures_sql('crashes', True)}")
def lg14_lg15_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.signatures(dims.values(spark, "id, stderr, signal", CRASHES))


#: What the logs of an event type say, by event number.
_PHRASES = ("use after free in ", "double free of ", "mutex waiting on lock ", "ThreadSanitizer: data race in ", "malloc of ", "stack smashing at ", "done with ")
_PHRASES_SQL = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PHRASES))


@register(
    f"""WITH logs AS (SELECT event_id AS id, (CASE event_id % {len(_PHRASES)} {_PHRASES_SQL} END) || event_type AS stderr FROM events), s AS ({_signatures_sql('logs', False)})
    SELECT signature, origin, count(*) AS n, count(*) FILTER (confidence > 0.8) AS sure FROM s GROUP BY ALL"""
)
def se04_flt06_log_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("event_id") % len(_PHRASES) + 1).cast("int"))
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(phrase, "event_type").alias("stderr"))
    found_ = signatures.signatures(logs, signal=None)
    return found_.groupBy("signature", "origin").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("sure"))


_OUTPUTS = [
    ("a", "thread panicked: FATAL", False, 101), ("b", "SIGSEGV at 0x0", True, None), ("c", "ok", False, 0), ("d", "ok", False, 2),
    ("e", "unknown option --x; Permission denied", False, 1), ("f", "assertion failed", True, 134),
]


def _reactions_sql(source: str) -> str:
    parts = [f"SELECT id, 'timeout_signal' AS signal, 'high' AS severity FROM {source} WHERE timed_out"]
    parts += [f"SELECT id, '{n}', '{sev}' FROM {source} WHERE {_any_sql(words, 'lower(output)')}" for n, (sev, words) in signatures.SIGNALS.items()]
    some = " UNION ALL ".join(parts)
    return f"seen AS ({some}), every AS (SELECT * FROM seen UNION ALL SELECT id, 'nonzero_exit_signal', 'low' FROM {source} WHERE exit_code <> 0 AND id NOT IN (SELECT id FROM seen))"


@register(f"WITH o AS (SELECT * FROM {dims.values_sql('id, output, timed_out, exit_code', _OUTPUTS)}), {_reactions_sql('o')} SELECT * FROM every")
def st18_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = dims.values(spark, "id, output, timed_out, exit_code", _OUTPUTS)
    return signatures.reactions(runs, "id", F.col("output"), F.col("timed_out"), F.col("exit_code"))


@register(
    f"""WITH o AS (SELECT * FROM {dims.values_sql('id, output, timed_out, exit_code', _OUTPUTS)}), {_reactions_sql('o')}
    SELECT signal, count(*) AS n FROM every GROUP BY signal UNION ALL
    SELECT 'verdict:' || CASE WHEN bool_or(severity = 'high') THEN 'fail' WHEN bool_or(severity = 'medium') THEN 'warn' ELSE 'pass' END, count(*) FROM every"""
)
def ag18_lg13_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = st18_reactions(spark, sf_dir)
    verdict = F.when(F.bool_or(F.col("severity") == "high"), "fail").when(F.bool_or(F.col("severity") == "medium"), "warn").otherwise("pass")
    return seen.groupBy("signal").agg(F.count("*").alias("n")).union(seen.agg(F.concat(F.lit("verdict:"), verdict).alias("signal"), F.count("*").alias("n")))


_EVENTS = [
    ("k1", "free", "x", 1), ("k1", "use", "x", 2), ("k2", "use", "x", 1), ("k2", "free", "x", 2), ("k3", "free", "p", 1), ("k3", "free", "p", 5),
    ("k4", "lock", "a", 1), ("k4", "lock", "b", 2), ("k5", "lock", "a", 1), ("k6", "write", "v", 1), ("k6", "read", "v", 2),
]


@register(
    f"""WITH e AS (SELECT * FROM {dims.values_sql('crash, kind, name, pos', _EVENTS)})
    SELECT f.crash, 'UseAfterFree' AS signature FROM e f JOIN e u ON f.crash = u.crash AND f.name = u.name AND f.kind = 'free' AND u.kind = 'use' AND f.pos < u.pos
    UNION SELECT f.crash, 'DoubleFree' FROM e f JOIN e u ON f.crash = u.crash AND f.name = u.name AND f.kind = 'free' AND u.kind = 'free' AND f.pos <> u.pos
    UNION SELECT f.crash, 'Deadlock' FROM e f JOIN e u ON f.crash = u.crash AND f.kind = 'lock' AND u.kind = 'lock' AND f.name <> u.name
    UNION SELECT f.crash, 'DataRace' FROM e f JOIN e u ON f.crash = u.crash AND f.name = u.name AND f.kind = 'write' AND u.kind = 'read'"""
)
def jn24_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.event_pairs(dims.values(spark, "crash, kind, name, pos", _EVENTS))


# --- dependencies ----------------------------------------------------------

_DEPS = [("serde", "1.0.100"), ("serde-json", "1.0.1"), ("tokio", "0.2.5"), ("left-pad", "0.1.0")]
_SOURCES_ROWS = [
    ("a.rs", "use serde_json::Value;\n// use tokio::main;\nextern crate serde;\nlet x = serde_json::from_str(y);\n"),
    ("b.rs", "/* tokio */\n* use left_pad::x;\nuse serde::Deserialize;\nuse serde;\n  use serde::de::Error;"),
]


@register(
    f"""WITH d AS (SELECT name, replace(name, '-', '_') AS crate FROM {dims.values_sql('name, version', _DEPS)}),
    l AS (SELECT file, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {dims.values_sql('file, content', _SOURCES_ROWS)}),
    c AS (SELECT file, line, trim(raw) AS statement FROM l WHERE NOT regexp_matches(trim(raw), '^(//|/\\*|\\*)'))
    SELECT DISTINCT name, file, line::INT AS line, statement FROM c JOIN d ON contains(statement, 'use ' || crate) OR regexp_matches(statement, '(^|[^A-Za-z0-9_])' || crate || '::') OR contains(statement, 'extern crate ' || crate)"""
)
def jn21_import_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.import_sites(dims.values(spark, "file, content", _SOURCES_ROWS), dims.values(spark, "name, version", _DEPS))


@register(
    f"""WITH p AS (SELECT p_name AS package, 'reachable' AS status, p_partkey, (p_partkey % 3) AS k, (p_size % 2 = 0) AS semver_fix, p_retailprice / 200.0 AS score FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'informational' WHEN k = 0 THEN 'unmitigable' ELSE 'mitigable' END AS class,
      CASE WHEN p_partkey % 5 = 0 THEN 'remove ' || package WHEN k = 0 THEN 'replace ' || package WHEN semver_fix THEN 'update ' || package ELSE 'upgrade ' || package || ' to 1.' || k || ', 2.0' END AS action,
      CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS label FROM p"""
)
def prj07_prj14_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    fixed = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("1."), k.cast("string")), F.lit("2.0")))
    status = F.when(F.col("p_partkey") % 5 == 0, "phantom").otherwise("reachable")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("package"), status.alias("status"), fixed.alias("fixed_versions"), (F.col("p_size") % 2 == 0).alias("semver_fix"), (F.col("p_retailprice") / 200.0).alias("score"))
    return bridge.classify(parts).select("p_partkey", "class", "action", bridge.severity_label(F.col("score")).alias("label"))


@register(
    """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'informational' WHEN p_partkey % 3 = 0 THEN 'unmitigable' ELSE 'mitigable' END AS class FROM part)
    SELECT class, count(*) AS n FROM c GROUP BY class"""
)
def ag26_ag27_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj07_prj14_classified(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


_KNOWN = [("PB-0007", "ADV-1", "ring"), ("PB-0003", "ADV-2", "bolt")]


@register(
    f"""WITH k AS (SELECT * FROM {dims.values_sql('id, advisory, package', _KNOWN)}),
    a AS (SELECT DISTINCT 'ADV-' || (p_size % 4) AS advisory, string_split(p_name, ' ')[2] AS package FROM part),
    f AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.advisory = a.advisory AND k.package = a.package))
    SELECT printf('PB-%04d', row_number() OVER (ORDER BY advisory, package) + 7) AS id, advisory, package FROM f"""
)
def jn22_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = table(spark, sf_dir, "part").select(F.concat(F.lit("ADV-"), (F.col("p_size") % 4).cast("string")).alias("advisory"), F.get(F.split("p_name", " "), F.lit(1)).alias("package"))
    return bridge.register(dims.values(spark, "id, advisory, package", _KNOWN), assessed)


_LOCK = """version = 3

[[package]]
name = "serde"
version = "1.0.100"
source = "registry+https://example.org/index"

[[package]]
name = "local"
version = "0.1.0"

[[package]]
name = "tokio"
version = "0.2.5"
source = "registry+https://example.org/index"
"""
_LOCKS = [("Cargo.lock", _LOCK), ("empty.lock", "")]


@register(
    f"""WITH b AS (SELECT file, unnest(string_split(content, '[[package]]')[2:]) AS block FROM {dims.values_sql('file, content', _LOCKS)})
    SELECT file, regexp_extract(block, '(?m)^name\\s*=\\s*"([^"]*)"', 1) AS name, regexp_extract(block, '(?m)^version\\s*=\\s*"([^"]*)"', 1) AS version FROM b WHERE contains(regexp_extract(block, '(?m)^source\\s*=\\s*"([^"]*)"', 1), 'registry')"""
)
def src12_lockfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.parse_lock(dims.values(spark, "file, content", _LOCKS))


_VERSIONS = [("0.4.2", "0.4.9"), ("0.4.2", "0.5.0"), ("3.1.4", "3.1.5"), ("3.1.4", "3.2.0"), ("3.1.4", "4.0.0"), ("0.7.1", "0.9.8"), ("1", "1.1"), ("1.x.2", "1.3"), ("1.2.0", "1.2")]


@register(
    f"""WITH v AS (SELECT current, fixed, list_transform(list_filter(string_split(current, '.'), lambda p: regexp_matches(p, '^[0-9]+$')), lambda p: p::INT) AS a,
      list_transform(list_filter(string_split(fixed, '.'), lambda p: regexp_matches(p, '^[0-9]+$')), lambda p: p::INT) AS b FROM {dims.values_sql('current, fixed', _VERSIONS)})
    SELECT current, fixed, coalesce(len(a) >= 2 AND len(b) >= 2 AND CASE WHEN a[1] = 0 THEN b[1] = 0 AND a[2] = b[2] ELSE a[1] = b[1] END AND b > a, FALSE) AS compatible FROM v"""
)
def ma07_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.values(spark, "current, fixed", _VERSIONS).select("current", "fixed", text.semver_compatible(F.col("current"), F.col("fixed")).alias("compatible"))


@register(
    """SELECT o.o_orderkey, o_orderstatus AS before, CASE WHEN l.o_orderkey IS NULL THEN 'new' ELSE 'skipped (unchanged)' END AS state
    FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.o_orderkey"""
)
def flt04_stm1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental scan skips: keys whose fingerprint the cache knows."""
    cache = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("known", F.lit(True))
    orders = table(spark, sf_dir, "orders").join(cache, "o_orderkey", "left")
    return orders.select("o_orderkey", F.col("o_orderstatus").alias("before"), F.when(F.col("known"), "skipped (unchanged)").otherwise("new").alias("state"))

