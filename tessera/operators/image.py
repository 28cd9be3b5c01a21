"""System images: nodes, edges between similar nodes, and diffs of two images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distance of risks under which nodes are close, the least risk of the first, and the count from which a category is dominant.
CLOSE, RISKY, DOMINANT = 0.15, 0.3, 3
#: Health change below which a node is unchanged, and the changes that make a trend.
SAME, TREND, STABLE = 0.01, 0.02, 0.01


def proximity_edges(nodes: DataFrame) -> DataFrame:
    """(a, b, weight) of nodes (id, ix, risk) whose risks are closer than CLOSE, the first one's above RISKY.

    A band join: risks fall into bands of width CLOSE, and close ones are in
    equal or neighbouring bands, so the theta join becomes an equi-join on
    the band that AQE may split.
    """
    band = F.floor(F.col("risk") / CLOSE)
    first = nodes.where(F.col("risk") > RISKY).select(F.col("id").alias("a"), F.col("ix").alias("ia"), F.col("risk").alias("ra"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    second = nodes.select(F.col("id").alias("b"), F.col("ix").alias("ib"), F.col("risk").alias("rb"), band.alias("band"))
    apart = F.abs(F.col("ra") - F.col("rb"))
    return first.join(second, "band").where((F.col("ia") < F.col("ib")) & (apart < CLOSE)).select("a", "b", (1 - apart / CLOSE).alias("weight"))


def pattern_edges(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, weight): the first node's dominant category has DOMINANT findings or more in both."""
    best = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("d")).where(-F.col("d.m") >= DOMINANT)
    first = best.join(nodes, "id").select(F.col("id").alias("a"), F.col("ix").alias("ia"), F.col("d.category").alias("category"))
    second = counts.where(F.col("n") >= DOMINANT).join(nodes, "id").select(F.col("id").alias("b"), F.col("ix").alias("ib"), "category")
    return first.join(second, "category").where("ia < ib").select("a", "b", F.lit(0.8).alias("weight"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with ix by falling weak points, then id.

    One row a repository; the window over all of them is the reference order
    that edges are oriented by.
    """
    return nodes.withColumn("ix", F.row_number().over(Window.orderBy(F.desc("weak_points"), "id")))


def diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """(id, status, health and risk before and after) of two images: one full outer join."""
    sides = [side.select("id", *[F.col(c).alias(f"{c}_{when}") for c in ("health", "risk", "weak_points")]) for side, when in ((older, "before"), (newer, "after"))]
    both = sides[0].join(sides[1], "id", "full_outer")
    change = F.col("health_after") - F.col("health_before")
    status = (
        F.when(F.col("health_before").isNull(), "new")
        .when(F.col("health_after").isNull(), "removed")
        .when(F.abs(change) < SAME, "unchanged")
        .when(change > 0, "improved")
        .otherwise("degraded")
    )
    return both.withColumn("status", status)


def trend(change: Column, improved: Column, degraded: Column) -> Column:
    return (
        F.when((change > TREND) & (degraded == 0), "improving").when((change < -TREND) & (improved == 0), "degrading").when(F.abs(change) < STABLE, "stable").otherwise("mixed")
    )


def image_totals(nodes: DataFrame) -> DataFrame:
    """One row: mean health and risk of the measured nodes, sums, and the histogram of buckets."""
    bins = [F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("healthy", "low", "moderate", "high", "critical")]
    return nodes.agg(
        F.coalesce(F.avg("health"), F.lit(1.0)).alias("global_health"), F.coalesce(F.avg("risk"), F.lit(0.0)).alias("global_risk"),
        F.sum("weak_points").alias("weak_points"), F.sum("critical").alias("critical"), F.sum("total_lines").alias("total_lines"), *bins,
    )


def trend_of(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One row: changes of the image's totals and the verdict."""
    a, b = image_totals(older), image_totals(newer)
    counts = diff(older, newer).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "removed", "improved", "degraded", "unchanged")])
    deltas = [(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_delta") for c in ("global_health", "global_risk", "weak_points", "critical")]
    # three tables of one row each
    joined = a.alias("a").crossJoin(b.alias("b")).crossJoin(counts).select(*deltas, *counts.columns)
    return joined.withColumn("trend", trend(F.col("global_health_delta"), F.col("n_improved"), F.col("n_degraded")))
