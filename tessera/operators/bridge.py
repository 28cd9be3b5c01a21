"""Dependencies, their vulnerabilities, and whether the code reaches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def severity_label(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def cvss_score(raw: Column) -> Column:
    """A plain number as a score; vectors have none."""
    return F.when(F.rlike(raw, F.lit(r"^\s*[0-9]+(\.[0-9]+)?\s*$")), F.trim(raw)).try_cast("double")


def import_sites(sources: DataFrame, deps: DataFrame) -> DataFrame:
    """(name, file, line, statement): lines that import a dependency; comments are left out.

    A crate is named by the word after ``use`` or ``extern crate``, or before
    ``::``, so lines meet dependencies by an equi-join on the words that could
    name one. A bare ``use x`` is a prefix test: all prefixes of its word that
    some dependency has as its length stand for it.
    """
    numbered = sources.select("file", F.posexplode(text.lines(F.col("content"))).alias("at", "raw"))
    code = numbered.select("file", (F.col("at") + 1).alias("line"), F.trim("raw").alias("statement")).where(~F.rlike("statement", F.lit(r"^(//|/\*|\*)")))
    word = r"[A-Za-z0-9_]+"
    after = F.concat(F.regexp_extract_all("statement", F.lit(rf"\buse ({word})"), 1), F.regexp_extract_all("statement", F.lit(rf"\bextern crate ({word})"), 1))
    prefixes = F.flatten(F.transform(after, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    named = F.array_distinct(F.concat(prefixes, F.regexp_extract_all("statement", F.lit(rf"({word})::"), 1)))
    crates = deps.select("name", F.translate("name", "-", "_").alias("crate"))
    return code.select("*", F.explode(named).alias("crate")).join(crates, "crate").select("name", "file", "line", "statement").distinct()


def reachability(deps: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, n_sites, status, imported_at) of each dependency; the first sites by file and line."""
    listed = F.array_sort(F.collect_list(F.struct("file", "line")))
    by_name = sites.groupBy("name").agg(F.count("*").alias("n_sites"), listed.alias("sites"))
    shown = F.transform(F.slice("sites", F.lit(1), F.when(F.col("n_sites") <= 3, 3).otherwise(2)), lambda s: F.concat(s["file"], F.lit(":"), s["line"].cast("string")))
    rest = F.when(F.col("n_sites") > 3, F.concat(F.lit(" and "), (F.col("n_sites") - 2).cast("string"), F.lit(" more"))).otherwise("")
    found = deps.join(by_name, "name", "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))
    status = F.when(F.col("n_sites") > 0, "reachable").otherwise("phantom")
    return found.select("name", "n_sites", status.alias("status"), F.concat(F.array_join(F.coalesce(shown, F.array().cast("array<string>")), ", "), rest).alias("imported_at"))


def classify(vulnerabilities: DataFrame) -> DataFrame:
    """Vulnerabilities (status, fixed_versions, semver_fix) with their class and what to do."""
    fixed = F.col("fixed_versions")
    reached = F.col("status") == "reachable"
    kind = F.when(~reached, "informational").when(F.size(fixed) == 0, "unmitigable").otherwise("mitigable")
    action = (
        F.when(F.col("status") == "phantom", F.concat(F.lit("remove "), "package"))
        .when(~reached, F.lit("monitor"))
        .when(F.size(fixed) == 0, F.concat(F.lit("replace "), "package"))
        .when(F.col("semver_fix"), F.concat(F.lit("update "), "package"))
        .otherwise(F.concat(F.lit("upgrade "), "package", F.lit(" to "), F.array_join(fixed, ", ")))
    )
    return vulnerabilities.withColumn("class", kind).withColumn("action", action)


def register(known: DataFrame, assessed: DataFrame) -> DataFrame:
    """New mitigations of ``assessed`` (advisory, package), numbered on from ``known`` (id): those not registered yet."""
    fresh = assessed.select("advisory", "package").distinct().join(known, ["advisory", "package"], "left_anti")
    last = known.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("int")), F.lit(0)).alias("last"))
    number = F.row_number().over(Window.orderBy("advisory", "package"))
    return fresh.withColumn("n", number).crossJoin(last).select(F.format_string("PB-%04d", F.col("n") + F.col("last")).alias("id"), "advisory", "package")


def parse_lock(raw: DataFrame, content: str = "content") -> DataFrame:
    """(file, name, version) of registry packages in lockfiles: blocks split, keys extracted."""
    block = F.explode(F.slice(F.split(F.col(content), r"\[\[package\]\]"), F.lit(2), F.greatest(F.size(F.split(F.col(content), r"\[\[package\]\]")) - 1, F.lit(0))))
    key = lambda k: F.regexp_extract("block", rf'(?m)^{k}\s*=\s*"([^"]*)"', 1)
    blocks = raw.select("file", block.alias("block"))
    return blocks.select("file", key("name").alias("name"), key("version").alias("version"), key("source").alias("source")).where(F.contains("source", F.lit("registry"))).drop("source")
