"""SQL pieces that the query twins share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import dims
from tessera.operators import findings as FD
from tessera.operators import scoring
from tessera.operators.packs import CORPUS_COUNTERS, CORPUS_RULES
from tessera.sources import bindings
from tessera.sources.bindings import FILES_SQL

SEVERITIES_SQL = f"severities AS (SELECT * FROM {dims.values_sql('severity, rank, value, level', dims.severity_rows())})"
CATEGORIES_SQL = f"categories AS (SELECT * FROM {dims.values_sql('category, rule_id, name', dims.category_rows())})"
COUNTED_SQL = f"counted AS (SELECT *, {FD.count_constructs_sql(CORPUS_COUNTERS)} FROM files)"
FINDINGS_SQL = f"findings AS ({FD.find_sql(CORPUS_RULES)})"
REPOS_SQL = """
repo_files AS (SELECT repo, count(*) AS total_files, sum(lines)::BIGINT AS total_lines FROM counted GROUP BY repo),
repo_found AS (
  SELECT repo, count(*) AS weak_points, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high FROM findings GROUP BY repo
),
repos AS (
  SELECT repo, total_files, total_lines, coalesce(weak_points, 0) AS weak_points, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high
  FROM repo_files LEFT JOIN repo_found USING (repo)
),
raw_risk AS (
  SELECT *, (3 * critical + 2 * high + greatest(weak_points - critical - high, 0)) / (greatest(total_lines, 1) / 1000.0::DOUBLE) AS raw FROM repos
),
nodes AS (
  SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(raw - 5.0::DOUBLE) * 0.5::DOUBLE)) AS risk, weak_points / (greatest(total_lines, 1) / 1000.0::DOUBLE) AS density FROM raw_risk
),
scored AS (
  SELECT *, 1 - risk AS health, CASE WHEN risk < 0.2 THEN 'healthy' WHEN risk < 0.4 THEN 'low' WHEN risk < 0.6 THEN 'moderate' WHEN risk < 0.8 THEN 'high' ELSE 'critical' END AS bucket FROM nodes
)
"""
BASE = f"WITH {FILES_SQL}, {SEVERITIES_SQL}, {CATEGORIES_SQL}, {COUNTED_SQL}, {FINDINGS_SQL}, {REPOS_SQL}"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.count_constructs(bindings.files(spark, sf_dir), CORPUS_COUNTERS)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.find(counted(spark, sf_dir), CORPUS_RULES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = counted(spark, sf_dir)
    return scoring.with_risk(scoring.repo_results(files, FD.find(files, CORPUS_RULES)))
