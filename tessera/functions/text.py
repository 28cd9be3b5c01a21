"""Text functions as Column expressions; all but the fuzzy distances stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle``."""
    shorter = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - shorter) / F.lit(len(needle))).cast("long")


def literal_sum(text: Column, needles: Sequence[str]) -> Column:
    """Sum of independent counts: a needle inside another one counts for both."""
    total = F.lit(0).cast("long")
    for needle in needles:
        total = total + literal_count(text, needle)
    return total


def has_any(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def has_all(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(True)
    for needle in needles:
        found = found & F.contains(text, F.lit(needle))
    return found


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    ends = literal_count(text, "\n")
    return F.when(F.length(text) == 0, F.lit(0)).when(F.endswith(text, F.lit("\n")), ends).otherwise(ends + 1).cast("long")


def extension(path: Column) -> Column:
    """After the last dot of the file name; empty for names without one or with only a leading one."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def location_file(location: Column) -> Column:
    """File of ``path:line``, split at the last colon; without a line number, all of it."""
    return F.when(F.rlike(location, F.lit(r"^.*:[0-9]+$")), F.regexp_extract(location, r"^(.*):([0-9]+)$", 1)).otherwise(location)


def location_line(location: Column) -> Column:
    digits = F.regexp_extract(location, r"^.*:([0-9]{1,9})$", 1)
    return F.when(digits != "", F.when(digits != "", digits).cast("int"))


def clamp(text: Column, most: int, marker: str) -> Column:
    """``text`` of at most ``most`` bytes, else its beginning and a marker."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def duration_ms(text: Column) -> Column:
    """Milliseconds of ``500ms``, ``5s``, ``2m``, ``1h`` or bare seconds; null if empty or negative."""
    own = F.trim(text)
    number = F.regexp_extract(own, r"^([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)?$", 1)
    unit = F.regexp_extract(own, r"^([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)?$", 2)
    factor = F.when(unit == "ms", 1.0).when(unit == "m", 60_000.0).when(unit == "h", 3_600_000.0).otherwise(1_000.0)
    return F.when(number != "", F.round(F.when(number != "", number).cast("double") * factor)).cast("long")


def fuzzy_distances(patterns: list[str], most: int) -> Callable[[Column], Column]:
    """Column function: of each of ``patterns``, in their order, the edit distance to a line where it fits best, null above ``most``.

    That is 0 if the line contains the pattern, else the least over all its
    substrings; words are such, and so are all pieces of the pattern's length up
    to ``most`` characters more or less. A batch's lines are one row of
    characters, and each character of a pattern one pass over it; its code
    travels by value.
    """

    @F.pandas_udf("array<int>")
    def distances(lines: pd.Series) -> pd.Series:
        known = lines.notna().to_numpy()
        # a number that is no character stands before each line
        rows = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in lines[known]]
        found: list = [None] * len(lines)
        places = np.flatnonzero(known)
        start = 0
        while start < len(rows):
            end, size = start, 0
            while end < len(rows) and (end == start or size + len(rows[end]) < 1 << 15):
                size += len(rows[end]) + 1
                end += 1
            sizes = np.array([len(r) + 1 for r in rows[start:end]])
            begins = np.cumsum(sizes) - sizes
            codes = np.full(int(sizes.sum()), 0xFFFFFFFF, dtype=np.uint32)
            inside = np.ones(len(codes), dtype=bool)
            inside[begins] = False
            codes[inside] = np.concatenate(rows[start:end])
            by_pattern = []
            for pattern in patterns:
                # least edits from the pattern so far to a piece that ends here, cut at most + 1
                edits = np.zeros(len(codes), dtype=np.uint8)
                for k, c in enumerate(pattern, 1):
                    now = edits + np.uint8(1)
                    np.minimum(now[1:], edits[:-1] + (codes[1:] != ord(c)), out=now[1:])
                    now[begins] = min(k, most + 1)
                    for _ in range(most):
                        np.minimum(now[1:], now[:-1] + np.uint8(1), out=now[1:])
                        now[begins] = min(k, most + 1)
                    edits = np.minimum(now, np.uint8(most + 1))
                by_pattern.append(np.minimum.reduceat(edits, begins).tolist())
            for place, row in zip(places[start:end], zip(*by_pattern, strict=True), strict=True):
                found[place] = [x if x <= most else None for x in row]
            start = end
        return pd.Series(found, index=lines.index, dtype=object)

    return distances


def semver_parts(version: Column) -> Column:
    """Numeric parts of a dotted version; others are dropped."""
    numeric = F.filter(F.split(version, r"\."), lambda p: F.rlike(p, F.lit(r"^[0-9]{1,9}$")))
    return F.transform(numeric, lambda p: p.cast("int"))


def semver_compatible(current: Column, fixed: Column) -> Column:
    """Whether a fix stays compatible: a higher version with the same major, or for 0.x the same minor."""
    a, b = semver_parts(current), semver_parts(fixed)
    both = (F.size(a) >= 2) & (F.size(b) >= 2)
    same = F.when(F.get(a, F.lit(0)) == 0, (F.get(b, F.lit(0)) == 0) & (F.get(a, F.lit(1)) == F.get(b, F.lit(1)))).otherwise(F.get(a, F.lit(0)) == F.get(b, F.lit(0)))
    return F.coalesce(both & same & (b > a), F.lit(False))


def health_bar(value: Column, width: int = 20) -> Column:
    filled = F.least(F.greatest(F.round(value * width), F.lit(0.0)), F.lit(float(width))).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("]"))


def signed(value: Column) -> Column:
    """``+n``, ``-n`` or ``0``."""
    return F.when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def sigmoid(x: Column, middle: float = 5.0, steepness: float = 0.5) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - F.lit(middle)) * F.lit(steepness)))
