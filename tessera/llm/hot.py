"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may have; more are dealt out over salts.
HOT_ROWS = 1_000
#: Hot keys that are broadcast, at most: a key is hot only if it has more than this share of all rows.
MOST_HOT = 10_000


def salted_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has one row a key; hot keys of ``rows`` are dealt over several tasks by their other columns.

    A key with more than HOT_ROWS rows, and more than 1 / MOST_HOT of all, gets
    a salt for each HOT_ROWS of its rows, and its row of ``one`` is repeated for
    each: at most one row more for HOT_ROWS rows. The list of such keys is
    broadcast; it has fewer than MOST_HOT entries, as their shares add up to 1.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_rows"))
    most, total = counts.agg(F.max("_rows"), F.sum("_rows")).first()
    bound = max(HOT_ROWS, (total or 0) // MOST_HOT)
    if (most or 0) <= bound:
        return rows.join(one, key, how)
    hot = F.broadcast(counts.where(F.col("_rows") > bound).select("_hot", F.ceil(F.col("_rows") / bound).cast("int").alias("_salts")))
    own = [c for c in rows.columns if c != key]
    salt = F.coalesce(F.pmod(F.xxhash64(*own), F.col("_salts")).cast("int"), F.lit(0)).alias("_salt")
    dealt = rows.join(hot, rows[key] == hot["_hot"], "left").select(key, *own, salt)
    more = one.join(hot, one[key] == hot["_hot"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
    return dealt.join(more, [key, "_salt"], how).drop("_salt")
