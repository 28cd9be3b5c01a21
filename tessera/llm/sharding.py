"""Sharding by jump consistent hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import written

#: Rows of a numbering cell: what one window group holds at most, about.
CELL_ROWS = 100_000
#: Cells of a shard at least, so that few shards still fill many tasks.
LEAST_CELLS = 64

RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of ``key`` among ``shards`` by jump consistent hashing.

    The walk visits the shard counts at which the key moves: from bucket b its
    next one is floor((b + 1) / u) for the next uniform draw u, until that is
    not below ``shards``. The draws are hashes of the key and the step, so they
    don't depend on ``shards``: with one more shard a key either stays or goes
    to the new one. No ring table exists. A null key is a key like any other.
    """

    def step(state: Column, i: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + 1) * F.lit(2.0**-53)
        after = F.floor((state["next"] + 1) / draw).cast("long")
        return F.when(state["next"] < shards, F.struct(state["next"].alias("at"), after.alias("next"))).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: id and shard count decide the shard. A slot numbers the
    rows of a shard without gaps from 0: rows are spread over cells of about
    CELL_ROWS by their position in a written table, cells get their start from
    summed counts, and only rows of one cell are ever sorted together, so one
    id, text or shard with a third of all rows spreads like any others.

    Null text: size 1 and crc 0. Null id: hashed as a key of its own. Repeated
    rows share a shard and get slots of their own. Columns of ``docs`` named
    like a result are replaced, all others stay. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    kept = [f"`{c}`" for c in docs.columns if c not in RESULTS and (keep_text or c != text_col)]
    # one column for all of theirs, so that no name of theirs meets one of ours
    rows = written(
        docs.select(
            F.struct(*kept).alias("_doc"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.lit("key").alias("law"),
            jump_hash(key, shards).alias("shard"),
            jump_hash(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sharded",
    )
    cells = max(LEAST_CELLS, -(-rows.count() // (shards * CELL_ROWS)))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n")).select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_row"))
    slot = (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot")
    return rows.withColumn("_place", place).join(starts, ["shard", "_cell"]).select("_doc.*", "size", "text_crc32", "law", "shard", slot, "grown_shard")
