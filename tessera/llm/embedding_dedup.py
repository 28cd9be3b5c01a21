"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StringType, StructField, StructType

from tessera.llm.arrow import batches
from tessera.llm.components import components
from tessera.llm.hot import salted_join
from tessera.llm.scratch import written

#: Dimensions of a subspace.
SUBSPACE = 8
#: Members of a cell that one task compares with as many others.
CHUNK = 2_048
#: Rows of a distance matrix, and pairs that are verified, at once.
_ROWS, _PAIRS = 256, 16_384
#: Room for the rounding of single-precision coordinates in a squared distance.
_SLACK = 1e-5
#: Vectors are compared among the same number of dimensions; at most so many different numbers.
MAX_SHAPES = 64


def _usable(vector, dtype) -> np.ndarray | None:
    """The vector as an array, or None if it is null, zero or holds null or non-finite components."""
    if not vector or any(x is None for x in vector):
        return None
    found = np.array(vector, dtype=dtype)
    wide = found.astype(np.float64)
    norm = float(np.sqrt(wide @ wide))
    return found if np.isfinite(wide).all() and 0 < norm < np.inf else None


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))


def _rotations(nodes: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """For each number of dimensions, principal axes of all unit vectors, dealt to the subspaces in turn.

    Only sums of products come to the driver: dimensions squared rows.
    """
    schema = "size int, cell int, total double"

    def moments(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            by_size: dict[int, list[bytes]] = {}
            for raw in frame["raw"]:
                by_size.setdefault(len(raw) // np.dtype(dtype).itemsize, []).append(raw)
            for size, own in by_size.items():
                unit = _unit(np.frombuffer(b"".join(own), dtype=dtype).reshape(len(own), size))
                sums[size] = sums.get(size, 0) + unit.T @ unit
        for size, total in sums.items():
            yield pd.DataFrame({"size": size, "cell": np.arange(size * size), "total": total.ravel()})

    summed = nodes.select("raw").mapInPandas(moments, schema).groupBy("size", "cell").agg(F.sum("total").alias("total")).toPandas()
    found = {}
    for size, own in summed.groupby("size"):
        matrix = np.zeros(int(size) ** 2)
        matrix[own["cell"]] = own["total"]
        matrix = matrix.reshape(int(size), int(size))
        axes = np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1]
        blocks = -(-int(size) // SUBSPACE)
        found[int(size)] = axes[:, np.concatenate([np.arange(b, size, blocks) for b in range(blocks)]).astype(int)]
    if len(found) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} numbers of dimensions")
    return found


def _spans(size: int) -> list[tuple[int, int]]:
    """Start and end of each subspace among the rotated coordinates."""
    blocks = -(-size // SUBSPACE)
    ends = np.cumsum([len(range(b, size, blocks)) for b in range(blocks)])
    return [(int(e) - len(range(b, size, blocks)), int(e)) for b, e in enumerate(ends)]


def _roots(left: np.ndarray, right: np.ndarray, label: np.ndarray) -> None:
    """Lower ``label`` to the least one along the links, in place."""
    while True:
        least = np.minimum(label[left], label[right])
        if (label[left] == least).all() and (label[right] == least).all():
            return
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)


def _compare(dtype: str, least: float):
    """Function of a cell's two chunks -> (node, links, root) of its linked members."""
    budget = 2 * (1 - least)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        block, i, j = (int(frame[c].iloc[0]) for c in ("block", "i", "j"))
        raw = np.frombuffer(b"".join(frame["raw"]), dtype=dtype).reshape(len(frame), -1)
        turned = np.frombuffer(b"".join(frame["turned"]), dtype=np.float32).reshape(len(frame), -1)
        size = raw.shape[1]
        node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        probe, chunk = frame["probe"].to_numpy(), frame["chunk"].to_numpy()
        spans = _spans(size)
        room = [budget * (b - a) / size + _SLACK for a, b in spans]
        a, b = spans[block]
        own = turned[:, a:b].astype(np.float64)
        squares = (own**2).sum(axis=1)
        first, second = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        links, place = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))

        def verified(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, y = raw[left].astype(np.float64), raw[right].astype(np.float64)
            cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            ok = cosine >= least
            # a pair within budget in several subspaces counts in the first of them
            for (c, d), most in list(zip(spans, room, strict=True))[:block]:
                ok &= ((turned[left, c:d].astype(np.float64) - turned[right, c:d].astype(np.float64)) ** 2).sum(axis=1) > most
            return left[ok], right[ok]

        for at in range(0, len(first), _ROWS):
            rows = first[at : at + _ROWS]
            near = squares[rows][:, None] + squares[second][None, :] - 2 * own[rows] @ own[second].T <= room[block] + _SLACK
            near &= ~(probe[rows][:, None] & probe[second][None, :])
            if i == j:
                near &= rows[:, None] < second[None, :]
            for lo in range(0, len(pairs := np.argwhere(near)), _PAIRS):
                left, right = rows[pairs[lo : lo + _PAIRS, 0]], second[pairs[lo : lo + _PAIRS, 1]]
                exact = ((own[left] - own[right]) ** 2).sum(axis=1) <= room[block]
                left, right = verified(left[exact], right[exact])
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                _roots(left, right, place)
        root = node[place]
        linked = links > 0
        return pd.DataFrame({"node": node[linked], "links": links[linked], "root": root[linked]})

    return compare


def near_embeddings(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors of an equal, non-null label are linked if their cosine in double
    precision is ``least`` or more, that is if unit vectors are at a squared
    distance of 2 - 2 * least or less. Rotated coordinates are cut into
    subspaces; a pair within that distance is, in one subspace at least, within
    the part of it that its dimensions make. In each subspace a vector goes to
    a cell of that width along the first axis, and as a probe to the next one,
    which makes the range join an equi-join on cells. Cells are dealt into
    chunks, so a task holds 2 x CHUNK vectors at most. A pair counts only in
    its first subspace; tasks return link counts and roots, never pairs.

    Equal vectors of a label are compared once and linked with each other.
    Vectors that are null, zero or hold null or non-finite components, and rows
    without label or id, have no links: component_id is the own id, and kept is
    true. Repeated rows of an id with one vector are one vector; of an id with
    several vectors each counts its own links, and the id links what they reach. Vectors of
    different lengths aren't linked. Extra columns are not read.
    """
    kind = vectors.schema[vector_col].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    digest = StructType([StructField("id", LongType()), StructField("label", StringType()), StructField("key", BinaryType()), StructField("raw", BinaryType())])
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for id_, label, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = None if label is None or id_ is None else _usable(vector, dtype)
                body = None if raw is None else raw.tobytes()
                rows.append((id_, label, None if body is None else xxhash.xxh3_128_digest(body), body))
            yield from batches(rows, digest)

    digests = written(source.mapInArrow(read, digest), "vectors")
    known = digests.where("key is not null")
    classes = written(known.select("id", "label", "key").distinct().groupBy("label", "key").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.join(known.withColumnRenamed("id", "first"), ["first", "label", "key"]).dropDuplicates(["node"])
    nodes = written(nodes.select("node", "label", "copies", "raw"), "nodes")
    spark = vectors.sparkSession
    turns = spark.sparkContext.broadcast(_rotations(nodes, dtype))
    budget = 2 * (1 - least)
    placed = StructType([StructField("node", LongType()), StructField("turned", BinaryType()), StructField("size", LongType()), StructField("cells", ArrayType(LongType()))])
    schema = StructType([*[StructField("n_" + f.name if f.name == "node" else f.name, f.dataType) for f in nodes.schema], *placed[1:]])

    def turn(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for node, label, copies, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector = np.frombuffer(raw, dtype=dtype)
                turned = (_unit(vector[None, :]) @ turns.value[len(vector)])[0].astype(np.float32)
                cells = []
                for a, b in _spans(len(vector)):
                    width = np.sqrt(budget * (b - a) / len(vector) + _SLACK) * (1 + 1e-9)
                    cells.append(int(np.floor(float(turned[a]) / width)))
                rows.append((node, label, copies, raw, turned.tobytes(), len(vector), cells))
            yield from batches(rows, schema)

    turned = written(nodes.mapInArrow(turn, schema), "turned")
    cell = ["label", "size", "block", "cell"]
    spread = turned.select(F.col("n_node").alias("node"), "label", "size", "copies", "raw", "turned", F.posexplode("cells").alias("block", "home"))
    members = spread.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("probe")).withColumn("cell", F.col("home") + F.col("probe").cast("long"))
    sizes = members.groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, cell).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("chunks", "other", "home")
    found = written(dealt.groupBy(*cell, "i", "j").applyInPandas(_compare(dtype, least), "node long, links long, root long"), "links")
    summed = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    ids = known.select("id", "label", "key").distinct()
    several = written(ids.groupBy("id").count().where("count > 1").select("id"), "several")
    if not several.isEmpty():
        own = ids.join(several, "id").join(classes.select("label", "key", "node"), ["label", "key"]).select("id", "node")
        edges = edges.union(own.join(own.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v"))
    labels = written(components(edges), "labels")
    firsts = labels.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"))
    of_node = salted_join(labels, firsts, "component").select("node", "smallest")
    of_class = classes.join(summed, "node", "left").join(of_node, "node", "left")
    of_class = of_class.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component"))
    key = F.concat(F.col("key"), F.encode("label", "UTF-8")).alias("key")
    of_class = of_class.select(key, "n_links", "component")
    judged = salted_join(digests.select("id", key), of_class, "key", "left")
    return judged.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
