"""Exports of findings, images and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dims


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, name, category, level): one rule a category, at the level of its first finding by file and rule."""
    known = dims.values(findings.sparkSession, "category, rule_id, name", dims.category_rows())
    levels = dims.values(findings.sparkSession, "severity, rank, value, level", dims.severity_rows())
    first = findings.groupBy("category").agg(F.min(F.struct("file", "rule", "severity")).alias("f"))
    return first.select("category", "f.severity").join(F.broadcast(levels), "severity").join(F.broadcast(known), "category").select("rule_id", "name", "category", "level")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result a finding."""
    known = dims.values(findings.sparkSession, "category, rule_id, name", dims.category_rows())
    levels = dims.values(findings.sparkSession, "severity, rank, value, level", dims.severity_rows())
    joined = findings.join(F.broadcast(known), "category").join(F.broadcast(levels), "severity")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))
    return joined.select("file", "rule", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """SARIF as two line files in one folder: ``rules`` and ``results``; each is written in parallel."""
    sarif_rules(findings).write.mode("overwrite").json(f"{path}/rules")
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{path}/results")


def logtalk(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, line): facts as clauses, arguments quoted and quotes doubled."""
    parts = []
    for name, df in sorted(relations.items()):
        quoted = [F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) for c in df.columns]
        parts.append(df.select(F.lit(name).alias("relation"), F.concat(F.lit(f"{name}("), F.concat_ws(", ", *quoted), F.lit(").")).alias("line")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def hexads(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, document) of each repository: counts by severity and sorted distinct categories, as JSON."""
    severity = F.col("severity")
    by_repo = findings.groupBy("repo").agg(
        *[F.count_if(severity == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")], F.array_sort(F.collect_set("category")).alias("categories")
    )
    joined = repos.select("repo", "total_files").join(by_repo, "repo")
    body = F.struct(F.col("repo").alias("program"), "total_files", "critical", "high", "medium", "low", "categories")
    return joined.select(F.concat(F.lit("hexad-"), "repo").alias("id"), F.to_json(body).alias("document"))


def constraints(findings: DataFrame, cells: DataFrame, least: float = 7.0) -> DataFrame:
    """(id, kind, subject): critical findings and taint cells from ``least`` on, numbered by kind and subject."""
    critical = findings.where("severity = 'Critical'").groupBy("category").count().select(F.lit("critical_finding").alias("kind"), F.col("category").alias("subject"))
    tainted = cells.where(F.col("severity_value") >= least).select(F.lit("taint_cell").alias("kind"), F.concat_ws("/", "category", "axis").alias("subject"))
    # a category or a cell each: at most 20 + 120 rows
    return critical.unionByName(tainted).withColumn("id", F.row_number().over(Window.orderBy("kind", "subject")))


def markdown(repos: DataFrame, least: int) -> DataFrame:
    """(repo, line) of repositories with ``least`` findings or more, worst badge first."""
    badge = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH").otherwise("MEDIUM")
    line = F.concat(F.lit("- **"), "repo", F.lit("** ["), badge, F.lit("]: "), F.col("weak_points").cast("string"), F.lit(" findings"))
    return repos.where(F.col("weak_points") >= least).select("repo", line.alias("line"))


def nickel(findings: DataFrame, most: int = 4) -> DataFrame:
    """(repo, record): a record with a repository's first ``most`` findings, by file and rule."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy("file", "rule"))
    some = findings.withColumn("place", place).where(F.col("place") <= most)
    escaped = F.replace(F.replace("description", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    item = F.concat(F.lit('{ category = "'), "category", F.lit('", description = "'), escaped, F.lit('" }'))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"])
    return some.groupBy("repo").agg(F.concat(F.lit("{ weak_points = ["), F.array_join(listed, ", "), F.lit("] }")).alias("record"))
