"""Campaigns of several run reports: totals, signals, verdicts, priorities and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures of a campaign; each is a sum over its reports.
TOTALS = (
    "assault_reports", "amuck_reports", "abduct_reports", "total_crashes", "total_signatures", "critical_weak_points",
    "failed_attacks", "mutation_apply_errors", "mutation_exec_failures", "abduct_exec_failures", "abduct_timeouts",
)

# fixed values: priorities with their level and the measures that raise them
PRIORITIES = [
    ("high", ("total_crashes",), "{0} crashes detected across assault reports"), ("high", ("critical_weak_points",), "{0} critical weak points detected in assail results"),
    ("medium", ("failed_attacks",), "{0} failed attack executions need review"),
    ("medium", ("mutation_apply_errors", "mutation_exec_failures"), "amuck produced {0} apply errors and {1} execution failures"), ("high", ("abduct_timeouts",), "{0} abduct execution timeouts observed"),
]


def totals(reports: DataFrame) -> DataFrame:
    """One row of TOTALS over ``reports``: kind (assault, amuck, abduct), crashes, signatures, critical, failed,
    apply_errors, exec_failures, timed_out, success; measures of other kinds are left out."""
    is_ = lambda kind: F.col("kind") == kind
    sums = [F.count_if(is_(k)) for k in ("assault", "amuck", "abduct")]
    sums += [F.sum(F.when(is_("assault"), F.col(c)).otherwise(0)) for c in ("crashes", "signatures", "critical", "failed")]
    sums += [F.sum(F.when(is_("amuck"), F.col(c)).otherwise(0)) for c in ("apply_errors", "exec_failures")]
    sums += [F.count_if(is_("abduct") & ~F.col("success")), F.count_if(is_("abduct") & F.col("timed_out"))]
    return reports.agg(*[F.coalesce(s, F.lit(0)).cast("long").alias(name) for s, name in zip(sums, TOTALS, strict=True)])


def signals(reports: DataFrame) -> DataFrame:
    """(report, severity, signal, evidence): what each report tells; one pass."""
    kind = F.col("kind")
    text = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words))
    rules = [
        ((kind == "assault") & (F.col("crashes") > 0), "high", "crash_signal", F.concat(text("crashes", " crashes in "), "report")),
        ((kind == "assault") & (F.col("failed") > 0), "medium", "attack_failure_signal", F.lit("failed attack results in assault report")),
        ((kind == "amuck") & (F.col("apply_errors") > 0), "medium", "mutation_apply_error_signal", text("apply_errors", " amuck mutation apply errors")),
        ((kind == "amuck") & (F.col("exec_failures") > 0), "medium", "mutation_exec_failure_signal", text("exec_failures", " amuck execution failures")),
        ((kind == "abduct") & F.col("timed_out"), "high", "abduct_timeout_signal", F.lit("abduct execution timed out")),
        ((kind == "abduct") & ~F.col("timed_out") & ~F.col("success"), "medium", "abduct_exec_failure_signal", F.lit("abduct execution failed")),
    ]
    found = [F.when(holds, F.struct(F.lit(level).alias("severity"), F.lit(name).alias("signal"), says.alias("evidence"))) for holds, level, name, says in rules]
    return reports.select("report", F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s")).select("report", "s.*")


def verdict(reports: DataFrame) -> DataFrame:
    """One row: fail with a high signal (a critical weak point is one too), else warn with a medium one, else pass."""
    kind = F.col("kind")
    high = ((kind == "assault") & ((F.col("crashes") > 0) | (F.col("critical") > 0))) | ((kind == "abduct") & F.col("timed_out"))
    medium = ((kind == "assault") & (F.col("failed") > 0)) | ((kind == "amuck") & (F.col("apply_errors") + F.col("exec_failures") > 0)) | ((kind == "abduct") & ~F.col("success"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return reports.agg(F.when(some(high), "fail").when(some(medium), "warn").otherwise("pass").alias("verdict"))


def priorities(campaign: DataFrame) -> DataFrame:
    """(place, level, message) of a row of TOTALS with its verdict; without any, the verdict as information."""
    found = []
    for k, (level, measures, says) in enumerate(PRIORITIES):
        any_ = F.lit(False)
        for m in measures:
            any_ = any_ | (F.col(m) > 0)
        message = F.format_string(says.replace("{0}", "%d").replace("{1}", "%d"), *measures)
        found.append(F.when(any_, F.struct(F.lit(k).alias("place"), F.lit(level).alias("level"), message.alias("message"))))
    listed = F.filter(F.array(*found), lambda p: p.isNotNull())
    info = F.array(F.struct(F.lit(len(PRIORITIES)).alias("place"), F.lit("info").alias("level"), F.concat(F.lit("campaign verdict is "), "verdict").alias("message")))
    return campaign.select(F.explode(F.when(F.size(listed) > 0, listed).otherwise(info)).alias("p")).select("p.*")


def recommendations(counts: DataFrame) -> DataFrame:
    """(key) of the recommendations for (signal, n): for crashes, panics and timeouts, or that none is needed."""
    has = lambda s: F.coalesce(F.bool_or((F.col("signal") == f"{s}_signal") & (F.col("n") > 0)), F.lit(False))
    told = counts.agg(*[has(s).alias(s) for s in ("crash", "panic", "timeout")])
    keys = F.filter(F.array(*[F.when(F.col(s), F.lit(f"rec.{s}")) for s in ("crash", "panic", "timeout")]), lambda k: k.isNotNull())
    return told.select(F.explode(F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("rec.none")))).alias("key"))
