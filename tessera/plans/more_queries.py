"""Queries: lookups and small relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dims, text
from tessera.plans.common import BASE, found
from tessera.plans.registry import register
from tessera.sources.bindings import table

_QUERIES = [("serde", "1.0"), ("tokio", "0.2"), ("rand", "0.8")]
_ANSWERS = [(0, "ADV-1"), (0, "ADV-2"), (2, "ADV-3")]


@register(
    f"""WITH q AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS pos FROM {dims.values_sql('name, version', _QUERIES)})
    SELECT name, version, advisory FROM q JOIN (SELECT * FROM {dims.values_sql('pos, advisory', _ANSWERS)}) a USING (pos)"""
)
def jn20_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers meet questions by their place in a chunk; a chunk is at most 1,000 long."""
    chunk = dims.values(spark, "name, version", _QUERIES).agg(F.array_sort(F.collect_list(F.struct("name", "version"))).alias("q"))
    asked = chunk.select(F.posexplode("q").alias("pos", "q")).select("pos", "q.name", "q.version")
    return asked.join(dims.values(spark, "pos, advisory", _ANSWERS), "pos").select("name", "version", "advisory")


@register(
    """WITH s AS (SELECT date_trunc('month', l_shipdate) AS month, count(*) AS n, row_number() OVER (ORDER BY date_trunc('month', l_shipdate)) AS seq FROM lineitem GROUP BY 1)
    SELECT a.seq AS from_seq, b.seq AS to_seq, b.n - a.n AS change FROM s a JOIN s b ON b.seq = a.seq + 1"""
)
def wn04_snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between neighbouring snapshots: one row a month, so one window."""
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("month")).agg(F.count("*").alias("n"))
    order = Window.orderBy("month")
    steps = months.select(F.row_number().over(order).alias("to_seq"), (F.col("n") - F.lag("n").over(order)).alias("change"))
    return steps.where("to_seq > 1").select((F.col("to_seq") - 1).alias("from_seq"), "to_seq", "change")


# fixed values: extensions that a fingerprint covers beside those of languages
EXTRA_EXTENSIONS = ("toml", "yaml", "yml", "json")
_NAMES = [("a.rs",), ("b.toml",), ("c.lock",), ("d/e.json",), ("Makefile",), (".env",), ("x\\y",), ("node",)]


@register(
    f"""WITH n AS (SELECT path, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM {dims.values_sql('path', _NAMES)})
    SELECT path, ext IN (SELECT ext FROM {dims.values_sql('ext, language, family', dims.language_rows())}) OR ext IN ('toml', 'yaml', 'yml', 'json') AS source,
    contains(path, '/') OR contains(path, chr(92)) OR ext <> '' OR starts_with(path, '.') AS file_like FROM n"""
)
def flt07_flt10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ext = F.col("path"), text.extension(F.col("path"))
    source = ext.isin(*[r[0] for r in dims.language_rows()], *EXTRA_EXTENSIONS)
    like = F.contains(path, F.lit("/")) | F.contains(path, F.lit("\\")) | (ext != "") | F.startswith(path, F.lit("."))
    return dims.values(spark, "path", _NAMES).select("path", source.alias("source"), like.alias("file_like"))


@register(BASE + "SELECT repo, count(*) FILTER (severity IN ('Critical', 'High')) AS severe, count(*) AS n, bool_or(contains(file, '/en/')) AS english FROM findings GROUP BY repo HAVING count(*) >= 3")
def flt02_flt03_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    severe = F.count_if(F.col("severity").isin("Critical", "High"))
    return found(spark, sf_dir).groupBy("repo").agg(severe.alias("severe"), F.count("*").alias("n"), F.bool_or(F.contains("file", F.lit("/en/"))).alias("english")).where("n >= 3")


@register(
    f"""WITH s AS (SELECT * FROM {dims.values_sql('raw', [('UserInput',), ('netread',), ('',)])})
    SELECT raw, CASE WHEN raw IN ('UserInput', 'Deserialization', 'ForeignReturn', 'NetworkRead', 'EnvVar') THEN raw ELSE 'UserInput' END AS source FROM s"""
)
def prj12_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of taint sources, and the default for those that are none."""
    known = F.col("raw").isin(*sorted(set(dims.TAINT_SOURCES.values())))
    return dims.values(spark, "raw", [("UserInput",), ("netread",), ("",)]).select("raw", F.when(known, F.col("raw")).otherwise("UserInput").alias("source"))
