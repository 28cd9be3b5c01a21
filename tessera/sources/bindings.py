"""Logical tables bound to the driver's tables, as DataFrames and as SQL.

The tables hold prose, not code, so ``files`` are the documents, under a path
whose extension follows the language, and repositories are their sources. Every
40th document has the name of a test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dims, text

#: Extension of a document's path by its language.
DOCUMENT_EXTENSIONS = {"en": "rs", "de": "c", "fr": "py", "es": "ex"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(spark: SparkSession) -> DataFrame:
    return dims.values(spark, "ext, language, family", dims.language_rows())


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ext, language and family of the path; unknown where no language has the extension."""
    known = F.broadcast(languages(files.sparkSession))
    found = files.withColumn("ext", text.extension(F.col(path))).join(known, "ext", "left")
    return found.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("language", "family")})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content, lines, ext, language, family)"""
    ext = F.lit("txt")
    for lang, own in DOCUMENT_EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, F.lit(own)).otherwise(ext)
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.when(F.col("doc_id") % 40 == 0, F.lit("/test_doc_")).otherwise(F.lit("/doc_")), F.col("doc_id").cast("string"), F.lit("."), ext)
    found = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content"), text.line_count(F.col("text")).alias("lines"))
    return with_language(found)


_CASE = " ".join(f"WHEN '{lang}' THEN '{ext}'" for lang, ext in DOCUMENT_EXTENSIONS.items())

FILES_SQL = f"""
languages AS (SELECT * FROM {dims.values_sql("ext, language, family", dims.language_rows())}),
raw_files AS (
  SELECT source AS repo, source || '/' || lang || CASE WHEN doc_id % 40 = 0 THEN '/test_doc_' ELSE '/doc_' END || doc_id || '.' || CASE lang {_CASE} ELSE 'txt' END AS path, text AS content,
    CASE lang {_CASE} ELSE 'txt' END AS ext,
    (CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS lines
  FROM documents
),
files AS (
  SELECT f.*, coalesce(language, 'unknown') AS language, coalesce(family, 'unknown') AS family FROM raw_files f LEFT JOIN languages USING (ext)
)
"""
