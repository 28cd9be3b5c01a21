"""URL filters by a sorted sweep over reversed-host keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a rule list, without Python on the executors."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _host_key(labels: Column) -> Column:
    """Labels in reversed order, each closed by a space, which no other label begins with: ``com`` does not begin ``community``."""
    return F.array_join(F.transform(labels, lambda label: F.concat(label, F.lit(" "))), "")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule key with all rules that are open there: itself and those whose key begins it.

    Intervals of prefixes are nested or apart, so these are the rules whose key
    equals a prefix of this one: an equi-join on the prefixes of the rules.
    """
    prefixes = rules.select("key").distinct().select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    outer = rules.select(F.col("key").alias("prefix"), F.struct("size", "host_size", "blocks", "key", "rule", "verdict").alias("open"))
    return prefixes.join(outer, "prefix").groupBy("key").agg(F.collect_list("open").alias("stack"))


def _sweep(keys: DataFrame, stacks: DataFrame) -> DataFrame:
    """(key, best) of those ``keys`` that lie in an interval of a rule.

    Keys and interval starts are range-partitioned together and written with
    the number of their range. Within a range, sorted, the last start before a
    key brings the stack of nested rules open there; a range in which no start
    precedes the key takes the last one of the ranges before. Rules of the
    stack whose interval has ended are popped, and the longest one left wins.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = stacks.select("key", "stack").unionByName(keys.select("key", none.alias("stack")))
    ranged = written(events.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranges")
    last = ranged.groupBy("part").agg(F.max(F.when(F.col("stack").isNotNull(), F.col("key"))).alias("key"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.max("key").over(earlier).alias("key")).join(stacks, "key").select("part", F.col("stack").alias("carried"))
    order = Window.partitionBy("part").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("own", F.last("stack", ignorenulls=True).over(order)).where(F.col("stack").isNull())
    still = F.filter(F.coalesce("own", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    return seen.join(carried, "part", "left").select("key", F.array_max(still).alias("best")).where(F.col("best").isNotNull())


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    A rule (host, path, verdict) fits its host and all subdomains where the
    url's path starts with the rule's; the longest rule (host and path
    together, then host) wins, block before allow if the same rule says both;
    without any, ``default``. A key is the reversed host, cut to as many labels
    as some rule host has, with each label closed, an end mark and the path, so
    that each rule is one interval of keys, also one with an empty path. Hosts and paths are made distinct before anything is dealt out, and
    verdicts return to the pages by an equi-join that may split hot urls.

    Null urls and those without ``://`` have empty host and path and get the
    default. Repeated pages are judged one by one. Rules with null parts are
    ignored; without rules or pages nothing fits or nothing returns.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    rules = rules.select(
        F.concat(_host_key(_labels(F.col("host"))), F.lit("!"), "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        (F.col("verdict") == "block").cast("int").alias("blocks"),
        F.size(_labels(F.col("host"))).alias("labels"),
    )
    deepest = rules.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not deepest:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = _labels(F.col("host"))
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    suffixes = F.transform(depths, lambda n: F.concat(_host_key(F.slice(labels, F.lit(1), n)), F.lit("!"), F.col("path")))
    keyed = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("key"))
    best = _sweep(keyed.select("key").distinct(), _stacks(rules))
    fits = keyed.join(best, "key").groupBy("host", "path").agg(F.max("best").alias("best"))
    return urls.join(fits, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
