"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a level of the histogram and of the hash.
LEVEL_BITS, HASH_BITS = 10, 60
#: Sources whose totals are ranked and shared out in one task; more is an error, never a cut.
MAX_SOURCES = 1_000_000
#: Sources whose limits are broadcast; those of more are joined.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(id_col: Column, text: Column) -> Column:
    both = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(both, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of each source of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size
    and the excess is shared anew. The shares that result are min(cap, level *
    weight) for one level. With sources in order of cap / weight, each count of
    capped ones gives a level, and the largest of these is the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", (budget - capped) / left)
    level = F.max("level").over(every)
    return levels.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, at, joins): hashes below ``at`` get one copy more, and those at it if ``joins``.

    A level sums the sizes by source and by the next LEVEL_BITS of the hash, and
    finds the bucket in which the running sum passes the remainder of the
    target. Only the rows of that bucket enter the next level, until it holds
    one hash; then half of its size decides on which side it falls.
    """
    state = targets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("sum"))
    found = None
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        prefix = F.shiftright(F.col("hash"), HASH_BITS - used + LEVEL_BITS)
        inside = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (prefix == F.col("s.prefix")))
        sums = inside.groupBy(F.col("s.source"), "rest", F.col("s.sum").alias("base"), F.shiftright("hash", HASH_BITS - used).alias("prefix")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        passed = sums.withColumn("upto", F.col("base") + F.sum("size").over(running)).where("upto > rest")
        first = passed.groupBy("source", "rest").agg(F.min(F.struct("prefix", "upto", "size", "low", "high")).alias("b"))
        step = Table(first.select("source", "rest", "b.*").withColumn("sum", F.col("upto") - F.col("size")), "mix-level").df
        done = step.where("low = high").select("source", F.col("low").alias("at"), (F.col("upto") - F.col("size") / 2 <= F.col("rest")).alias("joins"))
        found = done if found is None else found.unionByName(done)
        state = step.where("low < high").select("source", "rest", "prefix", "sum")
        if state.isEmpty():
            break
    return found


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of ``docs``.

    ``taken`` is ``size`` times the copies that the mix takes: as many whole
    copies as the target holds, and one more for the rows whose hash lies below
    their source's threshold. Reruns agree: the hash is of id and text only.

    Null text: size 0, taken 0. Null source: a source of its own, ranked last.
    Null ids hash as empty ones. Repeated rows have one hash and share its fate.
    No document is taken more than ``ceil(most)`` times. Extra columns are not
    read. An empty table gives no rows.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), *_measures(id_col, text_col, source_col)), "mix-rows")
    of = _plan(rows, weights, share, most)
    return rows.alias("r").join(of.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken")
    )


def take_mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them; columns unchanged.

    A row finds its copies by its hash and the limits of its source. These are
    broadcast if their counted number allows it, so that texts are not shuffled.
    """
    rows = written(docs.select(*_measures(id_col, text_col, source_col)), "mix-rows")
    of = written(_plan(rows, weights, share, most).select(F.col("source").alias("_of"), "copies", "rest", "at", "joins"), "mix-plan")
    if of.count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    hashed = docs.select(whole, F.col(source_col).alias("_source"), _hash(F.col(id_col), F.col(text_col)).alias("hash"))
    found = hashed.join(of, F.col("_source").eqNullSafe(F.col("_of"))).where(_copies() > 0)
    return found.select("_doc", F.explode(F.sequence(F.lit(1), _copies().cast("int"))).alias("_copy")).select("_doc.*")


def _measures(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(F.col(id_col), F.col(text_col)).alias("hash")]


def _copies() -> Column:
    """Copies of a row with ``hash`` beside its source's copies, rest, at and joins."""
    more = F.col("at").isNull() & (F.col("rest") > 0) | (F.col("hash") < F.col("at")) | (F.col("hash") == F.col("at")) & F.col("joins")
    return F.col("copies") + F.when(more, 1).otherwise(0)


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, copies, rest, at, joins) of each source of ``rows`` (source, size, hash)."""
    targets = source_targets(rows, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = written(targets.withColumn("copies", whole).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    limits = _thresholds(rows, targets)
    return targets.alias("t").join(limits.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", "at", "joins")
