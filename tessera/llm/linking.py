"""Links between near-equal sets: candidates from bands, exact checks, components.

Shared by the operators that compare sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import written

#: Members of a bucket that one task compares with as many others.
CHUNK = 1_024
#: Pairs of signatures that are compared at once.
PAIRS = 20_000
#: Buckets of several nodes that are broadcast to find their members, at most: 8 bytes each; more are joined.
MOST_BUCKETS = 2_000_000
#: Ids that are broadcast to filter a scan, at most; more are joined.
MOST_IDS = 1_000_000

#: (sizes, signatures, sizes, signatures) of pairs -> estimated similarity.
Estimate = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def hashes(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, dtype=np.uint64)


@dataclass(frozen=True)
class Sketches:
    """Nodes to link, and how to compare them.

    nodes: (node long, n int, sig binary), one row a node.
    band_bytes: the signature is cut into bands of so many bytes.
    dtype: of a register of the signature.
    fetch: (node) DataFrame -> (node, set binary): what ``decode`` makes the sorted uint64 hashes of a node's set from.
    estimate: of similarity; pairs below ``least`` are not checked.
    num, den: the similarity that links, as a fraction.
    Without nodes and fetch it only says how to compare, and travels to tasks.
    """

    nodes: DataFrame | None
    band_bytes: int
    bands: int
    dtype: str
    fetch: Callable[[DataFrame], DataFrame] | None
    estimate: Estimate
    least: float
    num: int
    den: int
    decode: Callable[[bytes], np.ndarray] = hashes


def restrict(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``ids`` (node): a broadcast filter if its counted size allows that, else a join."""
    ids = ids.select(F.col("node").alias("_node"))
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col(column) == F.col("_node"), "left_semi")


def _bands(s: Sketches) -> DataFrame:
    """(no, band, node): each band's number, and a hash of it and of the band's registers."""
    numbers = F.array(*[F.lit(k) for k in range(s.bands)])
    hashed = F.transform(numbers, lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * s.band_bytes + 1, F.lit(s.band_bytes))))
    return s.nodes.select("node", F.posexplode(hashed).alias("no", "band"))


def _registers(values: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)


def _likely(s_estimate: Estimate, least: float, num: int, den: int, dtype: str, na, sa, nb, sb) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs may be links, their estimates)."""
    estimated = s_estimate(na, _registers(sa, dtype), nb, _registers(sb, dtype))
    return (estimated >= least) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb)), estimated


def _score(s: Sketches, pairs: DataFrame) -> DataFrame:
    """(a, b, estimate) of the pairs (a, b) that may be links."""
    estimate, least, num, den, dtype = s.estimate, s.least, s.num, s.den, s.dtype
    side = lambda x: s.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            if not f.num_rows:
                continue
            d = {name: f.column(k) for k, name in enumerate(f.schema.names)}
            ok, estimated = _likely(estimate, least, num, den, dtype, d["na"].to_numpy(), d["sa"].to_pylist(), d["nb"].to_numpy(), d["sb"].to_pylist())
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([d["a"].filter(mask), d["b"].filter(mask), pa.array(estimated[ok], pa.float64())], names=["a", "b", "estimate"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(score, "a long, b long, estimate double")


def _verified(s: Sketches, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity that links."""
    num, den, decode = s.num, s.den, s.decode
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = written(s.fetch(wanted), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            ok = []
            for left, right in zip(f.column(2), f.column(3), strict=True):
                ok.append(_alike(decode(left.as_py()), decode(right.as_py()), num, den))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([f.column(0).filter(mask), f.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all the ranges starts[i] .. starts[i] + sizes[i], one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups, from frames in which groups follow one another."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield frame.iloc[:cut]
        rest = frame.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _pairs(s: Sketches, frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of likely pairs of different components in the groups of ``frame``.

    Pairs are compared by their signatures, each in the first of its common
    bands, so that no two groups find the same pair.
    """
    size, count, width = len(frame), s.bands, s.band_bytes // np.dtype(s.dtype).itemsize
    no, i, j, chunk, component, n = (frame[c].to_numpy() for c in ("no", "i", "j", "chunk", "component", "n"))
    own = frame[keys].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
    ends = np.repeat(np.append(first[1:], size), np.diff(np.append(first, size)))
    regs = _registers(list(frame["sig"]), s.dtype)
    after = ends - np.arange(size) - 1
    upto = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < size:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        left, right = np.repeat(np.arange(at, to), after[at:to]), _spread(np.arange(at, to) + 1, after[at:to])
        at = to
        wanted = (component[left] != component[right]) & ((i[left] == j[left]) | (chunk[left] != chunk[right]))
        wanted &= s.den * np.minimum(n[left], n[right]) >= s.num * np.maximum(n[left], n[right])
        left, right = left[wanted], right[wanted]
        equal = regs[left] == regs[right]
        # registers agree about as often as the sets do: the estimate can't be far above that
        some = equal.mean(axis=1) >= s.least - 0.1
        common = equal[some][:, : count * width].reshape(-1, count, width).all(axis=2)
        left, right = left[some], right[some]
        if len(left):
            mine = common.argmax(axis=1) == no[left]
            left, right = left[mine], right[mine]
        if len(left):
            close = s.estimate(n[left], regs[left], n[right], regs[right]) >= s.least
            yield left[close], right[close]


def _dealt(labelled: DataFrame) -> DataFrame:
    """(no, band, i, j, chunk, node, component): members of mixed buckets, in groups of two chunks.

    ``labelled`` is (no, band, node, component). A bucket is mixed if it holds
    several components. Its largest one can only be linked with the others, so
    its chunks meet theirs and not each other: a few foreign members of a large
    group of near copies cost one row a member. A bucket that fits into one
    chunk is one group. Members of a pair of different components meet in one
    group, in different chunks of it or in a group of a single chunk.
    """
    parts = labelled.groupBy("band", "component").agg(F.count("*").alias("size"))
    shape = parts.groupBy("band").agg(F.sum("size").alias("all"), F.max(F.struct("size", (-F.col("component")).alias("minus"))).alias("most")).where(F.col("all") > F.col("most.size"))
    whole = F.col("all") <= CHUNK
    chunks = lambda size: F.ceil(size / CHUNK).cast("int")
    foreign = F.when(whole, 1).otherwise(chunks(F.col("all") - F.col("most.size"))).alias("foreign")
    own = F.when(whole, 0).otherwise(chunks(F.col("most.size"))).alias("own")
    shape = shape.select("band", (-F.col("most.minus")).alias("largest"), foreign, own)
    in_largest = (F.col("component") == F.col("largest")) & (F.col("own") > 0)
    place = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    chunk = F.when(in_largest, F.col("foreign") + place(F.greatest("own", F.lit(1)))).otherwise(place(F.col("foreign")))
    last = F.when(in_largest, F.col("foreign")).otherwise(F.col("foreign") + F.col("own")) - 1
    chunked = labelled.join(shape, "band").select("no", "band", "node", "component", chunk.alias("chunk"), last.alias("last"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return dealt.select("no", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "component")


def across(s: Sketches, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v): links between components that share a bucket, as a forest of each group.

    Only buckets with several components are looked at. Their members are dealt
    into groups of two chunks, so that no more than about 2 x CHUNK of them are
    ever compared at once. A first pass keeps the members
    that have a likely partner in their group; these get their whole sets, and
    a second pass checks their likely pairs on them. Neither emits pairs: the
    first returns members, the second one link a member at most.
    """
    keys = ["band", "i", "j"]
    labelled = members.join(labels, "node", "left").select("no", "band", "node", F.coalesce("component", "node").alias("component"))
    dealt = _dealt(labelled)
    dealt = dealt.join(s.nodes, "node").select(*keys, "no", "chunk", "node", "component", "n", "sig")
    slim = replace(s, nodes=None, fetch=None)

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, keys):
            found = [np.concatenate(p) for p in _pairs(slim, frame, keys)]
            if found:
                yield frame.iloc[np.unique(np.concatenate(found))]

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, keys):
            sets = [slim.decode(x) for x in frame["set"]]
            forest = Forest(len(frame))
            for left, right in _pairs(slim, frame, keys):
                for x, y in zip(left.tolist(), right.tolist(), strict=True):
                    if forest.root(x) != forest.root(y) and _alike(sets[x], sets[y], slim.num, slim.den):
                        forest.join(x, y)
            node = frame["node"].to_numpy()
            roots = np.array([forest.root(x) for x in range(len(frame))], dtype=np.int64)
            own = roots != np.arange(len(frame))
            yield pd.DataFrame({"u": node[own], "v": node[roots[own]]})

    some = written(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(likely, dealt.schema), "across")
    sets = written(s.fetch(some.select("node").distinct()), "sets")
    whole = some.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys)
    return whole.mapInPandas(linked, "u long, v long")


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether the similarity of two sorted sets is num / den or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def link(s: Sketches) -> DataFrame:
    """(node, component) of all linked nodes; nodes without a link are left out.

    Nodes that share a band fall into a bucket; most bands are a node's own,
    and are left out as soon as they are counted. First each is paired with one
    node, of those that are the smallest of a bucket the one in most of its
    buckets, and checked on whole sets if likely; that already joins groups of
    near copies, however large, with one checked pair a node. Then the likely
    pairs across components, in all buckets, are checked too. So no pair that
    shares a band is left out that could join two components, and pairs inside
    a component, which can't change it, are never made.
    """
    bands = _bands(s)
    shared = written(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"), "buckets")
    if shared.count() <= MOST_BUCKETS:
        shared = F.broadcast(shared)
    members = written(bands.join(shared, "band", "left_semi").select("no", "band", "node"), "members")
    # only nodes that share a band are ever compared: their signatures alone are joined from here on
    s = replace(s, nodes=written(restrict(s.nodes, members.select("node").distinct(), "node"), "active"))
    least_of = members.groupBy("band").agg(F.min("node").alias("a"))
    star = members.join(least_of, "band").where("node > a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    best = star.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    scored = written(_score(s, best), "scored")
    first = written(_verified(s, scored).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    labels = written(components(first), "labels")
    second = written(across(s, members, labels), "links")
    if second.isEmpty():
        return labels
    return components(first.union(second))
