"""Near-duplicate documents by SetSketch registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessera.llm.arrow import batches
from tessera.llm.components import components
from tessera.llm.hot import salted_join
from tessera.llm.linking import MOST_IDS, Sketches, link, restrict
from tessera.llm.scratch import written

#: Registers are cut into BANDS bands of ROWS: at a similarity of 0.8, 1 - (1 - 0.8**5)**32 = 0.999997 of pairs share one.
BANDS, ROWS = 32, 5
#: Registers, those of the bands first; the rest only sharpen the estimates.
REGISTERS = 256
#: Base and rate of the registers, and their greatest value.
BASE, RATE, TOP = 1.02, 20.0, 60_000
#: Five standard deviations of an estimate from so many registers, at 0.8.
MARGIN = 5 * (0.8 * 0.2 / REGISTERS) ** 0.5

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.random.default_rng(20_240_601).integers(1, 2**63, size=(REGISTERS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Hashes times registers that are made at once.
_STEP = 2_048


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of so many words.

    A-Z are lower-cased; words are runs of anything but ASCII white space. With
    fewer words the whole sequence is the one shingle; without any, none.
    """
    tokens = (text or b"").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    size = min(words, len(tokens))
    mixed = np.full(len(tokens) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : len(tokens) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes.

    Each register keeps the smallest of the items' exponential variates of rate
    RATE, on a logarithmic scale of base BASE, truncated to 0 .. TOP. As the
    scale is monotone, the minimum of the uniform hashes is taken and placed on
    it. Registers of a union are the maxima of its parts' registers.
    """
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(items), _STEP):
        part = items[at : at + _STEP]
        hashed = (part[None, :] ^ _ODD[:, 1:]) * _ODD[:, :1]
        least = np.minimum(least, (hashed >> np.uint64(32)).min(axis=1))
    uniform = (least.astype(np.float64) + 0.5) / 2**32
    levels = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(levels, 0, TOP).astype("<u2")


def joint_estimate(na: np.ndarray, ra: np.ndarray, nb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their sizes and registers.

    With u and v the shares of the sizes, a register of the first is larger
    with probability p(u - vJ), of the second with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b), and equal otherwise. The likelihood of
    the three counts is concave in J, so its slope is bisected.
    """
    more, less = (ra > rb).sum(axis=1).astype(float), (ra < rb).sum(axis=1).astype(float)
    same = ra.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    scale, logb = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    tiny = 1e-12
    for _ in range(20):
        j = (low + high) / 2
        x, y = 1 - (u - v * j) * scale, 1 - (v - u * j) * scale
        p, q = np.maximum(-np.log(x) / logb, tiny), np.maximum(-np.log(y) / logb, tiny)
        dp, dq = -v * scale / (x * logb), -u * scale / (y * logb)
        slope = more * dp / p + less * dq / q - same * (dp + dq) / np.maximum(1 - p - q, tiny)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return high


def _key(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


_DIGEST = StructType([StructField("id", LongType()), StructField("n", IntegerType()), StructField("key", BinaryType()), StructField("sig", BinaryType())])
def _text_classes(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, labels): (id, n, key) of each row, (node, first, n, key) of each text class, (node, component) of the linked ones.

    A class is all rows of one shingle set, whatever their ids; first is its smallest id.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sketch(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                items = shingle_set(text, words)
                rows.append((id_, len(items), _key(items), registers(items).tobytes() if len(items) else None))
            yield from batches(rows, _DIGEST)

    digests = written(source.mapInArrow(sketch, _DIGEST), "digests")
    classes = digests.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("first"), F.min(F.struct("n", "sig")).alias("s"))
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), "first", "s.n", "key", "s.sig"), "nodes")

    def fetch(wanted: DataFrame) -> DataFrame:
        def sets(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                made = [shingle_set(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_key, made), pa.binary()), pa.array([m.tobytes() for m in made], pa.binary())], names=["first", "key", "set"])

        asked = written(restrict(nodes.select("node", "first", "key"), wanted, "node"), "asked")
        found = restrict(source, asked.select(F.col("first").alias("node")), "id").mapInArrow(sets, "first long, key binary, set binary")
        return found.join(asked, ["first", "key"]).select("node", "set").dropDuplicates(["node"])

    sketches = Sketches(nodes.select("node", "n", "sig"), ROWS * 2, BANDS, "<u2", fetch, joint_estimate, num / den - MARGIN, num, den)
    labels = written(link(sketches), "labels")
    return digests.select("id", "n", "key"), nodes.select("node", "first", "n", "key"), labels


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked if den * intersection >= num * union of their shingle
    sets; component_id is the smallest id that links reach, itself included,
    and kept says that it is the row's own. Equal sets are one node, found by a
    128-bit hash, so copies are never paired. Registers of the nodes give
    candidates by band and their estimates; links are confirmed on full sets.

    Null and empty texts: no shingles, linked with nothing. Rows that repeat an
    id with one text are one document. All texts of an id take part in links,
    and the id links what they reach. Null ids are linked with nothing:
    component_id is null and they are kept. Ids are integers. Extra columns are
    not read. An empty table gives no rows.
    """
    rows, nodes, labels = _text_classes(docs, words, num, den, id_col, text_col)
    known = rows.where("id is not null and key is not null")
    several = written(known.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("id"), "several")
    if not several.isEmpty():
        of_id = known.join(several, "id").select("id", "key").distinct().join(nodes, "key").select("id", "node")
        joined = of_id.join(of_id.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v")
        labels = written(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(joined)), "labels")
    linked = labels.join(nodes.select("node", "first"), "node")
    firsts = linked.groupBy("component").agg(F.min("first").alias("smallest"))
    of_node = salted_join(linked.select("component", "node"), firsts, "component").select("node", "smallest")
    of_class = nodes.join(of_node, "node", "left").select("key", F.coalesce("smallest", "first").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")
    found = salted_join(rows, of_class, "key", "left").select("id", "n", component)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` of which each group of near duplicates keeps one; columns unchanged.

    The text whose smallest id, then hash, comes first stays, at that id. Rows
    that repeat an id and text are one; of an id with several texts each is
    judged by itself. Rows with a null id, and of several rows of an id without
    a word one, stay. An empty table gives no rows.
    """
    rows, nodes, labels = _text_classes(docs, words, num, den, id_col, text_col)
    linked = labels.join(nodes.select("node", "first", "key"), "node")
    leads = linked.groupBy("component").agg(F.min(F.struct("first", "key")).alias("lead"))
    copies = salted_join(linked, leads, "component").where((F.col("lead.first") != F.col("first")) | (F.col("lead.key") != F.col("key"))).select("node")
    stay = nodes.join(copies, "node", "left_anti").select("key", F.col("first").alias("stays"))
    judged = salted_join(rows.where("id is not null"), stay, "key", "left").select("id", "key", (F.col("key").isNull() | F.coalesce(F.col("id") == F.col("stays"), F.lit(False))).alias("stays"))
    judged = written(judged, "judged")
    repeated = written(judged.groupBy("id").count().where("count > 1").select("id"), "repeated")
    gone = written(judged.where("not stays").select(F.col("id").alias("_gone")).distinct(), "gone")
    few = lambda ids: F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    if repeated.isEmpty():
        gone = few(gone)
        return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    several = few(repeated.select(F.col("id").alias("_several")))
    is_several = docs[id_col].cast("long") == several["_several"]
    once = docs.join(several, is_several, "left_anti")
    gone = few(gone)
    once = once.join(gone, once[id_col].cast("long") == gone["_gone"], "left_anti")

    @F.pandas_udf("binary")
    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_key(shingle_set(None if t is None else t.encode(), words)) for t in batch], dtype=object)

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    more = docs.join(several, is_several, "left_semi").select(whole, F.col(id_col).cast("long").alias("_id"), F.coalesce(keys(F.col(text_col)), F.lit(b"")).alias("_key"))
    wanted = judged.where("stays").select(F.col("id").alias("_id"), F.coalesce("key", F.lit(b"")).alias("_key")).distinct()
    more = more.join(wanted, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("_doc.*")
    return once.unionByName(more)
