"""Risk scores of files and repositories, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dims, text

# fixed values: weights of a file's score, in report order; file size counts from 500 lines on
FILE_WEIGHTS = {"unsafe_blocks": 3.0, "panic_sites": 2.5, "unwrap_calls": 1.0, "threading_constructs": 2.0, "io_operations": 1.5, "allocation_sites": 1.0}
SIZE_WEIGHT, SIZE_LINES, SIZE_MOST = 0.5, 500.0, 5.0
#: Upper bounds of the risk buckets.
BUCKETS = ((0.2, "healthy"), (0.4, "low"), (0.6, "moderate"), (0.8, "high"))


def file_score() -> Column:
    """Weighted sum of a file's counters, and of its size beyond SIZE_LINES."""
    score = F.when(F.col("lines") > SIZE_LINES, SIZE_WEIGHT * F.least(F.col("lines") / SIZE_LINES, F.lit(SIZE_MOST))).otherwise(0.0)
    for counter, weight in FILE_WEIGHTS.items():
        score = score + F.col(counter) * F.lit(weight)
    return score


def risk_factors() -> Column:
    """Names of the factors that add to a file's score."""
    named = [F.when(F.col(c) > 0, F.lit(c)) for c in FILE_WEIGHTS]
    return F.filter(F.array(*named, F.when(F.col("lines") > SIZE_LINES, F.lit("file_size"))), lambda x: x.isNotNull())


def simple_risk() -> Column:
    return (3 * F.col("unsafe_blocks") + 2 * F.col("panic_sites") + F.col("unwrap_calls") + 2 * F.col("threading_constructs")).cast("long")


def bucket(risk: Column) -> Column:
    chain = F.when(risk < BUCKETS[0][0], F.lit(BUCKETS[0][1]))
    for most, name in BUCKETS[1:]:
        chain = chain.when(risk < most, F.lit(name))
    return chain.otherwise(F.lit("critical"))


def repo_results(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo, weak_points, critical, high, total_files, total_lines): both sides pre-aggregated by repository before they meet."""
    by_file = files.groupBy("repo").agg(F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"))
    severity = F.col("severity")
    by_finding = findings.groupBy("repo").agg(
        F.count("*").alias("weak_points"), F.count_if(severity == "Critical").alias("critical"), F.count_if(severity == "High").alias("high")
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("weak_points", "critical", "high")}
    return by_file.join(by_finding, "repo", "left").withColumns(counts)


def with_risk(repos: DataFrame) -> DataFrame:
    """``repos`` with risk, density, health and bucket."""
    kloc = F.greatest(F.col("total_lines"), F.lit(1)) / 1000.0
    others = F.greatest(F.col("weak_points") - F.col("critical") - F.col("high"), F.lit(0))
    raw = (3 * F.col("critical") + 2 * F.col("high") + others) / kloc
    scored = repos.withColumn("risk", text.sigmoid(raw)).withColumn("density", F.col("weak_points") / kloc)
    return scored.withColumn("health", 1 - F.col("risk")).withColumn("bucket", bucket(F.col("risk")))


def severity_values(findings: DataFrame) -> DataFrame:
    known = dims.values(findings.sparkSession, "severity, rank, value, level", dims.severity_rows())
    return findings.join(F.broadcast(known), "severity", "left")


def taint_matrix(findings: DataFrame) -> DataFrame:
    """(category, axis, severity_value, findings, files): strongest severity and distinct files of each cell."""
    cells = severity_values(findings).select("category", "value", "file", F.explode("axes").alias("axis"))
    return cells.groupBy("category", "axis").agg(F.max("value").alias("severity_value"), F.count("*").alias("findings"), F.count_distinct("file").alias("files"))


def pivot(findings: DataFrame) -> DataFrame:
    """(category, axis, total) of severity values, with its place by falling total."""
    cells = severity_values(findings).select("category", "value", F.explode("axes").alias("axis"))
    summed = cells.groupBy("category", "axis").agg(F.sum("value").alias("total"))
    # one row a category and axis, at most 20 x 6: a single window is bounded
    place = F.row_number().over(Window.orderBy(F.desc("total"), "category", "axis"))
    return summed.withColumn("place", place)


def category_breakdown(findings: DataFrame) -> DataFrame:
    """(repo, categories): (category, count) by falling count, then name."""
    counted = findings.groupBy("repo", "category").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category")))
    return counted.groupBy("repo").agg(F.transform(ordered, lambda c: F.struct(c["category"].alias("category"), (-c["m"]).alias("count"))).alias("categories"))


def recommended_axes(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, axes): axes of the findings, those that the counters ask for, and always cpu; sorted."""
    found = findings.select("repo", F.explode("axes").alias("axis")).distinct()
    sums = files.groupBy("repo").agg(*[F.sum(c).alias(c) for c in ("allocation_sites", "io_operations", "threading_constructs")])
    asked = F.array(
        F.lit("cpu"),
        F.when(F.col("allocation_sites") > 10, F.lit("memory")),
        F.when(F.col("io_operations") > 5, F.lit("disk")),
        F.when(F.col("threading_constructs") > 3, F.lit("concurrency")),
    )
    more = sums.select("repo", F.explode(F.filter(asked, lambda a: a.isNotNull())).alias("axis"))
    return found.union(more).groupBy("repo").agg(F.array_sort(F.collect_set("axis")).alias("axes"))


def robustness(crashes: Column, critical: Column, unsafe: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - 10.0 * crashes - 20.0 * critical - 5.0 * unsafe))
