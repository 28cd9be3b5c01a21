"""Contexts of files that suppress findings, from counters, paths and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# fixed values: parts of test paths, and words of descriptions that tell a context
TEST_PARTS = ("/test", "_test.", "/tests/", "/spec/", "test_")
WORDS = {
    "null_checked": ("null check", "nil check", "if null", "!= null", "!= nil", "is_null", "null_ptr", "nullptr"),
    "schema_validated": ("schema", "validate", "validated", "serde", "from_str", "deserialize", "json_schema", "type_check"),
    "enum_args": ("enum", "whitelist", "allowlist", "match ", "static set", "known values", "predefined"),
    "timeout_protected": ("timeout", "try_lock", "timed", "deadline", "duration", "wait_timeout"),
    "path_canonicalized": ("canonicalize", "canonicalized", "realpath", "resolve", "normalize", "absolute path", "clean_path"),
    "constant_args": ("literal", "hardcoded", "hard-coded", "constant", "static string", "compile-time", "const "),
}
FIXED_COMMANDS = ("static", "const", "fixed", "known", "predefined")


def described(findings: DataFrame) -> DataFrame:
    """(file, description, fixed, unchecked): a file's descriptions in the order of its rules, one text; whether all its
    commands are described as fixed ones (null without any), and whether an allocation is unchecked.

    A file has one finding a rule at most, so a group is small.
    """
    listed = F.array_sort(F.collect_list(F.struct("rule", "description")))
    joined = F.lower(F.array_join(F.transform(listed, lambda d: d["description"]), " "))
    fixed = F.bool_and(F.when(F.col("category") == "CommandInjection", text.has_any(F.lower("description"), FIXED_COMMANDS)))
    unchecked = F.bool_or(F.col("category") == "UncheckedAllocation")
    return findings.groupBy("file").agg(joined.alias("description"), fixed.alias("fixed"), unchecked.alias("unchecked"))


def contexts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, ctx) of counted ``files`` and their findings."""
    rust = F.endswith(F.col("path"), F.lit(".rs"))
    of_file = F.array(
        F.when(text.has_any(F.col("path"), TEST_PARTS), F.lit("test_file")),
        F.when(F.col("threading_constructs") > 0, F.lit("mutex_guarded")),
        F.when(rust, F.lit("raii_managed")),
        F.when(rust & (F.col("unwrap_calls") > 0), F.lit("result_returning_fn")),
    )
    said = described(findings)
    allocating = files.where("allocation_sites > 0").select(F.col("path").alias("file"), F.lit(True).alias("allocates")).distinct()
    of_words = [F.when(text.has_any(F.col("description"), words), F.lit(ctx)) for ctx, words in WORDS.items()]
    of_words += [F.when(F.col("allocates") & ~F.col("unchecked"), F.lit("null_checked")), F.when(F.col("fixed"), F.lit("constant_args"))]
    plain = files.select(F.col("path").alias("file"), F.explode(F.filter(of_file, lambda c: c.isNotNull())).alias("ctx"))
    told = said.join(allocating, "file", "left").select("file", F.explode(F.filter(F.array(*of_words), lambda c: c.isNotNull())).alias("ctx"))
    return plain.union(told).distinct()


def _any_sql(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def contexts_sql(files: str = "counted", findings: str = "findings") -> str:
    """Common table expressions ``said`` and ``context`` for DuckDB."""
    words = " ".join(f"UNION SELECT file, '{ctx}' FROM said WHERE {_any_sql('description', w)}" for ctx, w in WORDS.items())
    return f"""
said AS (
  SELECT file, lower(string_agg(description, ' ' ORDER BY rule)) AS description, bool_and({_any_sql('lower(description)', FIXED_COMMANDS)}) FILTER (category = 'CommandInjection') AS fixed,
    bool_or(category = 'UncheckedAllocation') AS unchecked FROM {findings} GROUP BY file
),
context AS (
  SELECT path AS file, 'test_file' AS ctx FROM {files} WHERE {_any_sql('path', TEST_PARTS)} UNION SELECT path, 'mutex_guarded' FROM {files} WHERE threading_constructs > 0
  UNION SELECT path, 'raii_managed' FROM {files} WHERE ends_with(path, '.rs') UNION SELECT path, 'result_returning_fn' FROM {files} WHERE ends_with(path, '.rs') AND unwrap_calls > 0
  {words} UNION SELECT file, 'constant_args' FROM said WHERE fixed
  UNION SELECT file, 'null_checked' FROM said JOIN (SELECT DISTINCT path FROM {files} WHERE allocation_sites > 0) a ON a.path = file WHERE NOT unchecked
)"""
