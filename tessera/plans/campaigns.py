"""Queries: campaigns of run reports. Each user's events are a report; the kind follows the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dims
from tessera.operators import campaigns
from tessera.plans.common import BASE, scored
from tessera.plans.registry import register
from tessera.sources.bindings import table

_REPORTS = """
reports AS (
  SELECT 'report-' || user_id AS report, CASE user_id % 3 WHEN 0 THEN 'assault' WHEN 1 THEN 'amuck' ELSE 'abduct' END AS kind,
    count(*) FILTER (event_type = 'error') AS crashes, count(*) FILTER (event_type = 'click') AS signatures, count(*) FILTER (value > 150) AS critical, count(*) FILTER (value < 5) AS failed,
    count(*) FILTER (event_type = 'error') AS apply_errors, count(*) FILTER (event_type = 'view') AS exec_failures, count(*) FILTER (value > 200) > 0 AS timed_out, count(*) FILTER (value < 2) = 0 AS success
  FROM events GROUP BY user_id
)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 0, "assault").when(F.col("user_id") % 3 == 1, "amuck").otherwise("abduct")
    type_ = lambda t: F.count_if(F.col("event_type") == t)
    measures = {
        "crashes": type_("error"), "signatures": type_("click"), "critical": F.count_if(F.col("value") > 150), "failed": F.count_if(F.col("value") < 5), "apply_errors": type_("error"),
        "exec_failures": type_("view"), "timed_out": F.count_if(F.col("value") > 200) > 0, "success": F.count_if(F.col("value") < 2) == 0,
    }
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.select(F.concat(F.lit("report-"), F.col("user_id").cast("string")).alias("report"), kind.alias("kind"), *measures)


_TOTALS = """
totals AS (
  SELECT count(*) FILTER (kind = 'assault') AS assault_reports, count(*) FILTER (kind = 'amuck') AS amuck_reports, count(*) FILTER (kind = 'abduct') AS abduct_reports,
    coalesce(sum(crashes) FILTER (kind = 'assault'), 0)::BIGINT AS total_crashes, coalesce(sum(signatures) FILTER (kind = 'assault'), 0)::BIGINT AS total_signatures,
    coalesce(sum(critical) FILTER (kind = 'assault'), 0)::BIGINT AS critical_weak_points, coalesce(sum(failed) FILTER (kind = 'assault'), 0)::BIGINT AS failed_attacks,
    coalesce(sum(apply_errors) FILTER (kind = 'amuck'), 0)::BIGINT AS mutation_apply_errors, coalesce(sum(exec_failures) FILTER (kind = 'amuck'), 0)::BIGINT AS mutation_exec_failures,
    count(*) FILTER (kind = 'abduct' AND NOT success) AS abduct_exec_failures, count(*) FILTER (kind = 'abduct' AND timed_out) AS abduct_timeouts FROM reports
)"""


@register(f"WITH {_REPORTS}, {_TOTALS} SELECT * FROM totals")
def ag20_campaign_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.totals(reports(spark, sf_dir))


_SIGNALS = """
signals AS (
  SELECT report, 'high' AS severity, 'crash_signal' AS signal, crashes || ' crashes in ' || report AS evidence FROM reports WHERE kind = 'assault' AND crashes > 0
  UNION ALL SELECT report, 'medium', 'attack_failure_signal', 'failed attack results in assault report' FROM reports WHERE kind = 'assault' AND failed > 0
  UNION ALL SELECT report, 'medium', 'mutation_apply_error_signal', apply_errors || ' amuck mutation apply errors' FROM reports WHERE kind = 'amuck' AND apply_errors > 0
  UNION ALL SELECT report, 'medium', 'mutation_exec_failure_signal', exec_failures || ' amuck execution failures' FROM reports WHERE kind = 'amuck' AND exec_failures > 0
  UNION ALL SELECT report, 'high', 'abduct_timeout_signal', 'abduct execution timed out' FROM reports WHERE kind = 'abduct' AND timed_out
  UNION ALL SELECT report, 'medium', 'abduct_exec_failure_signal', 'abduct execution failed' FROM reports WHERE kind = 'abduct' AND NOT timed_out AND NOT success
)"""


@register(f"WITH {_REPORTS}, {_SIGNALS} SELECT * FROM signals")
def st27_report_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.signals(reports(spark, sf_dir))


_VERDICT = """
verdict AS (
  SELECT CASE WHEN bool_or(kind = 'assault' AND (crashes > 0 OR critical > 0) OR kind = 'abduct' AND timed_out) THEN 'fail'
    WHEN bool_or(kind = 'assault' AND failed > 0 OR kind = 'amuck' AND apply_errors + exec_failures > 0 OR kind = 'abduct' AND NOT success) THEN 'warn' ELSE 'pass' END AS verdict FROM reports
)"""


@register(
    f"""WITH {_REPORTS}, {_TOTALS}, {_VERDICT}, p AS (
      SELECT 0 AS place, 'high' AS level, total_crashes || ' crashes detected across assault reports' AS message FROM totals WHERE total_crashes > 0
      UNION ALL SELECT 1, 'high', critical_weak_points || ' critical weak points detected in assail results' FROM totals WHERE critical_weak_points > 0
      UNION ALL SELECT 2, 'medium', failed_attacks || ' failed attack executions need review' FROM totals WHERE failed_attacks > 0
      UNION ALL SELECT 3, 'medium', 'amuck produced ' || mutation_apply_errors || ' apply errors and ' || mutation_exec_failures || ' execution failures' FROM totals WHERE mutation_apply_errors > 0 OR mutation_exec_failures > 0
      UNION ALL SELECT 4, 'high', abduct_timeouts || ' abduct execution timeouts observed' FROM totals WHERE abduct_timeouts > 0)
    SELECT * FROM p UNION ALL SELECT 5, 'info', 'campaign verdict is ' || verdict FROM verdict WHERE NOT EXISTS (SELECT 1 FROM p)"""
)
def lg13_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = reports(spark, sf_dir)
    # one row each
    return campaigns.priorities(campaigns.totals(of).crossJoin(campaigns.verdict(of)))


_WORDS = [("en", "rec.crash", "Look at the crashes first"), ("en", "rec.none", "Nothing to do"), ("de", "rec.crash", "Zuerst die Abstürze ansehen")]


@register(
    f"""WITH {_REPORTS}, {_SIGNALS}, keys AS (SELECT 'rec.crash' AS key WHERE EXISTS (SELECT 1 FROM signals WHERE signal = 'crash_signal')),
    every AS (SELECT * FROM keys UNION ALL SELECT 'rec.none' WHERE NOT EXISTS (SELECT 1 FROM keys)), w AS (SELECT * FROM {dims.values_sql('lang, key, word', _WORDS)})
    SELECT l.lang, e.key, coalesce(a.word, b.word, e.key) AS word FROM every e, (VALUES ('en'), ('de'), ('fr')) AS l(lang) LEFT JOIN w a ON a.lang = l.lang AND a.key = e.key LEFT JOIN w b ON b.lang = 'en' AND b.key = e.key"""
)
def st28_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations in three languages, in English where a language has no words."""
    counts = campaigns.signals(reports(spark, sf_dir)).groupBy("signal").agg(F.count("*").alias("n"))
    keys = campaigns.recommendations(counts).select("key", F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr")])).alias("lang"))
    words = F.broadcast(dims.values(spark, "lang, key, word", _WORDS))
    english = words.where("lang = 'en'").select("key", F.col("word").alias("english"))
    return keys.join(words, ["lang", "key"], "left").join(english, "key", "left").select("lang", "key", F.coalesce("word", "english", "key").alias("word"))


@register(
    f"""WITH {_REPORTS} SELECT (coalesce(sum(apply_errors), 0))::BIGINT AS total, count(*) FILTER (kind = 'assault' AND apply_errors > 0) AS runs_with, count(*) FILTER (kind <> 'assault' AND apply_errors > 0) AS reports_with FROM reports"""
)
def ag19_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspellings (errors stand for them): all, and the runs and reports that have some."""
    some, run = F.col("apply_errors") > 0, F.col("kind") == "assault"
    of = reports(spark, sf_dir)
    return of.agg(F.coalesce(F.sum("apply_errors"), F.lit(0)).cast("long").alias("total"), F.count_if(run & some).alias("runs_with"), F.count_if(~run & some).alias("reports_with"))


@register(
    """WITH r AS (SELECT event_id, user_id, event_type AS axis, value, CASE WHEN value < 5 THEN 'skipped' WHEN event_type <> 'error' THEN 'passed' ELSE 'failed' END AS status,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, 'attack-' || axis || '-' || k AS id, axis, floor(value * 1000)::BIGINT AS duration_ms, 'unknown' AS intensity, status FROM r"""
)
def snk11_event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event chain of each run without a timeline: attacks numbered in order, with their status."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("value") < 5, "skipped").when(F.col("event_type") != "error", "passed").otherwise("failed")
    id_ = F.concat(F.lit("attack-"), F.col("event_type"), F.lit("-"), place.cast("string"))
    return table(spark, sf_dir, "events").select("user_id", id_.alias("id"), F.col("event_type").alias("axis"), F.floor(F.col("value") * 1000).alias("duration_ms"), F.lit("unknown").alias("intensity"), status.alias("status"))


# fixed values: short labels of categories in the event export
LABELS = {
    "UncheckedAllocation": "unchecked-alloc", "UnboundedLoop": "unbounded-loop", "BlockingIO": "blocking-io", "UnsafeCode": "unsafe-code", "PanicPath": "panic-path",
    "RaceCondition": "race-condition", "DeadlockPotential": "deadlock", "ResourceLeak": "resource-leak", "CommandInjection": "cmd-injection", "UnsafeDeserialization": "unsafe-deser",
    "DynamicCodeExecution": "dynamic-exec", "UnsafeFFI": "unsafe-ffi", "AtomExhaustion": "atom-exhaustion", "InsecureProtocol": "insecure-proto", "ExcessivePermissions": "excess-perms",
    "PathTraversal": "path-traversal", "HardcodedSecret": "hardcoded-secret", "UncheckedError": "unchecked-error", "InfiniteRecursion": "infinite-recursion", "UnsafeTypeCoercion": "unsafe-coercion",
}


@register(BASE + f"SELECT label, axis, count(*) AS n FROM (SELECT category, unnest(axes) AS axis FROM findings) JOIN (SELECT * FROM {dims.values_sql('category, label', list(LABELS.items()))}) l USING (category) GROUP BY ALL")
def prj06_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.common import found

    labels = F.broadcast(dims.values(spark, "category, label", list(LABELS.items())))
    return found(spark, sf_dir).select("category", F.explode("axes").alias("axis")).join(labels, "category").groupBy("label", "axis").agg(F.count("*").alias("n"))


@register(BASE + "SELECT '  ' || rpad(repo, 40, ' ') || lpad(weak_points::VARCHAR, 7, ' ') || lpad(critical::VARCHAR, 7, ' ') || lpad(high::VARCHAR, 7, ' ') || lpad(total_files::VARCHAR, 9, ' ') || lpad(total_lines::VARCHAR, 9, ' ') AS line FROM scored WHERE weak_points > 0 ORDER BY weak_points DESC, repo LIMIT 20")
def snk21_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary table's lines: its top 20 repositories are the feature."""
    top = scored(spark, sf_dir).where("weak_points > 0").orderBy(F.desc("weak_points"), "repo").limit(20)
    cell = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    return top.select(F.concat(F.lit("  "), F.rpad("repo", 40, " "), cell("weak_points", 7), cell("critical", 7), cell("high", 7), cell("total_files", 9), cell("total_lines", 9)).alias("line"))
