"""Text mutations as column expressions, each with its number of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Stands for the left token while a swap is under way.
PLACEHOLDER = "__SWAP_PLACEHOLDER__"


@dataclass(frozen=True)
class Operation:
    op: str
    old: str = ""
    new: str = ""
    times: int = 1


def _first(source: Column, old: str, new: str) -> Column:
    at = F.locate(old, source)
    return F.when(at > 0, F.concat(F.substring(source, F.lit(1), at - 1), F.lit(new), F.substr(source, at + len(old)))).otherwise(source)


def _has(source: Column, needle: str) -> Column:
    return F.contains(source, F.lit(needle)).cast("long")


def apply(source: Column, operation: Operation) -> tuple[Column, Column]:
    """(mutated text, changes made) of one operation."""
    old, new = operation.old, operation.new
    if operation.op == "replace_first":
        return _first(source, old, new), _has(source, old)
    if operation.op == "replace_all":
        return F.replace(source, F.lit(old), F.lit(new)), T.literal_count(source, old)
    if operation.op == "insert_before":
        return _first(source, old, new + old), _has(source, old)
    if operation.op == "insert_after":
        return _first(source, old, old + new), _has(source, old)
    if operation.op == "append":
        return F.concat(source, F.lit(new)), F.lit(1).cast("long")
    if operation.op == "prepend":
        return F.concat(F.lit(new), source), F.lit(1).cast("long")
    if operation.op == "swap":
        moved = F.replace(F.replace(F.replace(source, F.lit(old), F.lit(PLACEHOLDER)), F.lit(new), F.lit(old)), F.lit(PLACEHOLDER), F.lit(new))
        return moved, T.literal_count(source, old) + T.literal_count(source, new)
    own = F.split(source, "\n")
    hits = F.size(F.filter(own, lambda line: F.contains(line, F.lit(old)))).cast("long")
    if operation.op == "delete_lines":
        return F.array_join(F.filter(own, lambda line: ~F.contains(line, F.lit(old))), "\n"), hits
    if operation.op == "duplicate_lines":
        copies = F.transform(own, lambda line: F.when(F.contains(line, F.lit(old)), F.array_repeat(line, operation.times + 1)).otherwise(F.array(line)))
        return F.array_join(F.flatten(copies), "\n"), hits * operation.times
    raise ValueError(f"unknown operation {operation.op}")


def mutate(sources: DataFrame, combos: dict[str, list[Operation]], content: str = "content") -> DataFrame:
    """(file, combo, mutated, changes): every combination over every source; those that change nothing are left out."""
    made = []
    for name, operations in combos.items():
        own, changes = F.col(content), F.lit(0).cast("long")
        for operation in operations:
            own, n = apply(own, operation)
            changes = changes + n
        made.append(F.struct(F.lit(name).alias("combo"), own.alias("mutated"), changes.alias("changes")))
    return sources.select("file", F.explode(F.array(*made)).alias("m")).select("file", "m.*").where("changes > 0")
