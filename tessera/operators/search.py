"""Line search in logs: grep and fuzzy grep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def grep(logs: DataFrame, patterns: list[str], id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, mode, pattern, line_no, line, distance) of lines that contain a pattern, whatever the case."""
    low = F.lower(F.col("line"))
    found = [F.when(F.contains(low, F.lit(p.lower())), F.struct(F.lit(p).alias("pattern"), F.lit(0).alias("distance"))) for p in patterns]
    return _scan(logs, id_col, content, "grep", found)


def agrep(logs: DataFrame, patterns: list[str], most: int, id_col: str = "id", content: str = "content") -> DataFrame:
    """The same for lines within ``most`` edits of a pattern."""
    distances = text.fuzzy_distances([p.lower() for p in patterns], most)(F.lower(F.col("line")))
    lines = _numbered(logs, id_col, content).select(id_col, "line_no", "line", distances.alias("distances"))
    names = F.array(*[F.lit(p) for p in patterns])
    hits = lines.select(id_col, "line_no", "line", F.explode(F.filter(F.arrays_zip(names.alias("pattern"), F.col("distances").alias("distance")), lambda h: h["distance"].isNotNull())).alias("h"))
    return hits.select(id_col, F.lit("agrep").alias("mode"), "h.pattern", "line_no", "line", "h.distance")


def _numbered(logs: DataFrame, id_col: str, content: str) -> DataFrame:
    lines = logs.select(id_col, F.posexplode(text.lines(F.col(content))).alias("at", "line"))
    return lines.select(id_col, (F.col("at") + 1).alias("line_no"), "line")


def _scan(logs: DataFrame, id_col: str, content: str, mode: str, found: list) -> DataFrame:
    lines = _numbered(logs, id_col, content)
    hits = lines.select(id_col, "line_no", "line", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull())).alias("h"))
    return hits.select(id_col, F.lit(mode).alias("mode"), "h.pattern", "line_no", "line", "h.distance")
