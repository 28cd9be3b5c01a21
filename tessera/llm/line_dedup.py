"""Fuzzy line dedup by MinHash over character shingles."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessera.llm.arrow import batches
from tessera.llm.components import components
from tessera.llm.linking import Sketches, _spread, across, restrict
from tessera.llm.scratch import release, written

#: Characters of a shingle unless the caller says; a shorter line is one shingle.
CHARS = 8
#: Characters at which one changed character leaves a line of 39 or more linked at 0.8; it costs up to so many shingles of each line.
EDIT_CHARS = 4
#: Minima are cut into BANDS bands of ROWS. A pair counts if it shares a band and, of the MORE minima after that, four bits of
#: LEAST_MORE or more: at a similarity of 0.8 with a probability of 0.8**6 * 0.947 = 0.25 a band, and 1 - (1 - 0.25)**30 = 0.9998 in all.
#: Short shingles are common to many lines: bands of 6 alone would pair 100 times as many that are far apart.
BANDS, ROWS = 30, 6
MORE, LEAST_MORE = 12, 8
MINIMA = BANDS * ROWS
#: Bins into which the shingles of a line are thrown, a power of two; the first MINIMA give the signature.
BINS = 256
#: Five standard deviations of an estimate from so many minima, at 0.8.
MARGIN = 5 * (0.8 * 0.2 / MINIMA) ** 0.5
#: Steps of a size by which the sizes of a band's lines are told apart: sizes of linked lines are at most 1.25 times each other.
SIZE_STEPS = 20
#: Nodes of a block, whose lines are packed together, and lines of a pack at most: a line that many documents share has several packs.
BLOCK_BITS, PACK = 12, 50_000
BLOCK = 1 << BLOCK_BITS
#: Lines, and characters of lines, that a task holds before it sends them on.
FLUSH_LINES, FLUSH_CHARS = 60_000, 1 << 24
#: Pairs a line that a bucket may give; denser buckets, and those of more than LARGE lines, are compared by chunks.
DENSE, LARGE = 8, 2_048
#: How tables of texts are written: none repeats, and the third level takes 30 % more time to save 14 % of the bytes.
TEXTS = {"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}
#: Links of which a task makes a forest.
FOREST = 1_000_000
#: Characters that are hashed at once, and lines whose bins are filled at once.
_STEP, _FILL = 1 << 15, 1_000

_PROBES = np.random.default_rng(20_240_602).permutation(np.arange(1, BINS))
_EMPTY = np.uint32(0xFFFFFFFF)
#: A band's entry: a hash of its registers, the place of its line in the flush, the step of its size, bits of more registers.
_ENTRY = {"low": "<u2", "high": "u1", "at": "<u2", "step": "u1", "more": "<u4", "rest": "<u2"}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shingles(codes: np.ndarray, chars: int) -> np.ndarray:
    """64-bit hashes of the shingles that begin at each of ``codes`` but the last chars - 1."""
    n = len(codes) - chars + 1
    hashed = np.full(max(n, 0), chars, dtype=np.uint64)
    for k in range(chars if n > 0 else 0):
        hashed = (hashed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
    return hashed


def _codes(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all lines, number of them by line)."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    short = np.flatnonzero(sizes < chars)
    if not len(short):
        return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), sizes
    codes = np.frombuffer("".join([x.ljust(chars) for x in lines]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    # a short line is filled up with a value that is no character, so that it has one shingle
    filled = np.maximum(sizes, chars)
    codes[_spread((np.cumsum(filled) - filled + sizes)[short], chars - sizes[short])] = 0xFFFFFFFF
    return codes, filled


def line_set(line: str, chars: int = CHARS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a line."""
    return np.unique(_shingles(_codes([line], chars)[0].astype(np.uint64), chars))


def _stored_set(stored: bytes, chars: int) -> np.ndarray:
    """Set of a line that travelled as text, an eighth of the size of its hashes."""
    return line_set(stored.decode("utf-8", "surrogatepass"), chars)


def _sketch(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(registers, numbers of shingles) of many lines at once."""
    regs, counts = [np.empty((0, MINIMA), dtype="<u2")], np.empty(len(lines), dtype=np.int64)
    for start in range(0, len(lines), _FILL):
        piece = lines[start : start + _FILL]
        least = np.full(len(piece) * BINS, _EMPTY, dtype=np.uint32)
        at = 0
        while at < len(piece):
            begin, size = at, 0
            while at < len(piece) and (at == begin or size + len(piece[at]) <= _STEP):
                size += max(len(piece[at]), chars)
                at += 1
            codes, sizes = _codes(piece[begin:at], chars)
            counts[start + begin : start + at] = sizes - chars + 1
            if len(sizes) == 1:
                for a in range(0, size - chars + 1, _STEP):
                    _throw(least, _shingles(codes[a : a + _STEP + chars - 1].astype(np.uint64), chars), np.int64(begin * BINS))
            else:
                hashed = _shingles(codes.astype(np.uint64), chars)
                inside = np.ones(size, dtype=bool)
                ends = np.cumsum(sizes)
                for back in range(1, chars):
                    inside[ends - back] = False
                _throw(least, hashed[inside[: len(hashed)]], np.repeat(np.arange(begin, at) * BINS, sizes - chars + 1))
        regs.append((_filled(least.reshape(-1, BINS)) >> np.uint32(16)).astype("<u2"))
    return np.concatenate(regs), counts


def _throw(least: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> None:
    """Keep the smallest hash of each bin; ``first`` is the place of a line's first bin."""
    mixed = _mixed(hashed)
    np.minimum.at(least, first + (mixed >> np.uint64(64 - BINS.bit_length() + 1)).view(np.int64), mixed.astype(np.uint32))


def _filled(least: np.ndarray) -> np.ndarray:
    """The first MINIMA bins; an empty one takes the value of the first full one among those it probes, in an order of its own that is the same in all lines."""
    out = least[:, :MINIMA].copy()
    alone = (least != _EMPTY).sum(axis=1) == 1
    out[alone] = least[alone].min(axis=1, keepdims=True)
    own = out.reshape(-1)
    open_ = np.flatnonzero(own == _EMPTY)
    # places in whole rows of bins; a probe flips bits of a bin's number only
    bin_ = open_ // MINIMA * BINS + open_ % MINIMA
    for probe in _PROBES:
        if not len(open_):
            break
        found = least.take(bin_ ^ probe)
        own[open_] = found
        empty = found == _EMPTY
        open_, bin_ = open_[empty], bin_[empty]
    return out


def signatures(lines: list[str], chars: int = CHARS) -> list[bytes]:
    """MinHash signatures by one permutation, 16 bits a register, of many lines at once."""
    return [row.tobytes() for row in _sketch(lines, chars)[0]]


def _band_hashes(regs: np.ndarray) -> np.ndarray:
    """64-bit hashes of each line's bands, by line and band."""
    words = np.ascontiguousarray(regs).view("<u4").reshape(len(regs), BANDS, ROWS // 2)
    hashed = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), words.shape[:2])
    for k in range(ROWS // 2):
        hashed = _mixed(hashed ^ words[:, :, k])
    return hashed


def _more_bits(regs: np.ndarray) -> np.ndarray:
    """Four bits of each of the MORE registers after each band, by line and band."""
    low, own = (regs & np.uint16(15)).reshape(len(regs), BANDS, ROWS), np.zeros((len(regs), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        own |= low[:, :, k].astype(np.uint64) << np.uint64(4 * k)
    out = np.zeros_like(own)
    # MORE is a multiple of ROWS: whole bands after one's own
    for k in range(MORE // ROWS):
        out |= np.roll(own, -1 - k, axis=1) << np.uint64(4 * ROWS * k)
    return out


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether LEAST_MORE or more of the fours of bits are the same."""
    differ = x ^ y
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    return np.bitwise_count(differ & np.uint64(0x1111111111111111)) <= MORE - LEAST_MORE


def equal_share(na: np.ndarray, ra: np.ndarray, nb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    return (ra == rb).mean(axis=1)


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that take part: without outer white space, none empty."""
    return [(k, own) for k, line in enumerate((text or "").split("\n")) if (own := line.strip())]


def _parts(spark: SparkSession) -> list[int]:
    """A number for each partition of a shuffle that the hash of Spark deals there."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(40 * count + 40).select(F.col("id").cast("int").alias("part"))
    found = numbers.groupBy(F.pmod(F.hash("part"), F.lit(count)).alias("place")).agg(F.min("part").alias("part")).collect()
    return sorted(r.part for r in found)


_PACKED = StructType([StructField("part", IntegerType()), StructField("data", BinaryType())])
_LINES = StructType([StructField("node", LongType()), StructField("text", BinaryType()), StructField("block", LongType()), StructField("data", BinaryType())])


def _packed_lines(parts: list[int]):
    """Lines in packs by the hash of their text: equal lines of a pack share one text."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        texts: list[bytes] = []
        of, ids, numbers = [], [], []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.frombuffer(b"".join(known), dtype="V16")
            part_of = (keys.view("<u4")[::4] % np.uint32(len(parts))).astype(np.int64)
            order = np.argsort(part_of, kind="stable")
            cuts = np.searchsorted(part_of[order], np.arange(len(parts) + 1))
            place = np.empty(len(keys), dtype=np.int64)
            place[order] = np.arange(len(keys)) - cuts[part_of[order]]
            text, id_, number = np.array(of), np.array(ids, dtype=np.int64), np.array(numbers, dtype=np.int32)
            lines = np.argsort(part_of[text], kind="stable")
            ends = np.searchsorted(part_of[text][lines], np.arange(len(parts) + 1))
            rows = []
            for k, part in enumerate(parts):
                if len(mine := order[cuts[k] : cuts[k + 1]]):
                    own = lines[ends[k] : ends[k + 1]]
                    columns = keys[mine], place[text[own]].astype("<u4"), id_[own], number[own]
                    rows.append((part, pickle.dumps(([texts[x] for x in mine.tolist()], *[x.tobytes() for x in columns]), 5)))
            yield from batches(rows, _PACKED, 64)

        for frame in frames:
            for at in range(0, frame.num_rows, 500):
                piece = frame.slice(at, 500)
                for id_, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for number, line in _lines(text):
                        stored = line.encode("utf-8", "surrogatepass")
                        key = xxhash.xxh3_128_digest(stored)
                        if (place := known.get(key)) is None:
                            place = known[key] = len(texts)
                            texts.append(stored)
                            size += len(stored)
                        of.append(place)
                        ids.append(id_)
                        numbers.append(number)
                        size += 24
                    if size >= FLUSH_CHARS:
                        yield from flush()
                        for held in known, texts, of, ids, numbers:
                            held.clear()
                        size = 0
        if known:
            yield from flush()

    return pack


def _numbered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) of each distinct line, then (block, data) of all lines in packs by blocks of nodes."""
    base = TaskContext.get().partitionId() << 33
    schema = to_arrow_schema(_LINES)
    known: dict[bytes, int] = {}
    nodes, ids, numbers = [], [], []
    for frame in frames:
        for data in frame.column(1):
            texts, keys, place, own_ids, own_numbers = pickle.loads(data.as_py())
            before = len(known)
            node = np.array([known.setdefault(keys[at : at + 16], len(known)) for at in range(0, len(keys), 16)])
            fresh = np.flatnonzero(node >= before)
            for at in range(0, len(fresh), 5_000):
                own = fresh[at : at + 5_000]
                none = [pa.nulls(len(own), f.type) for f in list(schema)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(base + node[own]), pa.array([texts[x] for x in own.tolist()], pa.binary()), *none], schema=schema)
            nodes.append(node[np.frombuffer(place, dtype="<u4")])
            ids.append(np.frombuffer(own_ids, dtype=np.int64))
            numbers.append(np.frombuffer(own_numbers, dtype=np.int32))
    if not known:
        return
    node, id_, number = (np.concatenate(x) for x in (nodes, ids, numbers))
    order = np.lexsort((number, id_, node))
    node, id_, number = node[order], id_[order], number[order]
    fresh = np.concatenate([[True], (node[1:] != node[:-1]) | (id_[1:] != id_[:-1]) | (number[1:] != number[:-1])])
    node, id_, number = node[fresh], id_[fresh], number[fresh]
    first = np.searchsorted(node, node)
    block = node >> BLOCK_BITS
    cuts = np.append(np.unique(block, return_index=True)[1], len(node)).tolist()
    rows = []
    for start, end in pairwise(cuts):
        for at in range(start, end, PACK):
            to = slice(at, min(at + PACK, end))
            # the first line of a node that began in an earlier pack
            earlier = (int(id_[first[at]]), int(number[first[at]])) if first[at] < at else None
            packed = (node[to] & BLOCK - 1).astype("<u2"), id_[to], number[to]
            rows.append((None, None, (base >> BLOCK_BITS) + int(block[at]), pickle.dumps((earlier, *[x.tobytes() for x in packed]), 5)))
    yield from batches(rows, _LINES, 16)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """(place of its node in the block, id, line_no, id and line_no of the node's first) of the lines of a pack, by node."""
    earlier, *own = pickle.loads(data)
    place, id_, number = (np.frombuffer(x, dtype=kind) for x, kind in zip(own, ("<u2", np.int64, np.int32), strict=True))
    first = np.searchsorted(place, place)
    first_id, first_number = id_[first], number[first]
    if earlier:
        first_id[first == 0], first_number[first == 0] = earlier
    return place, id_, number, first_id, first_number


def _first_lines(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, first_id, first_line_no) of linked nodes, from packs (data) with the linked nodes of their block (own)."""
    for frame in frames:
        for data, own in zip(frame.column(0), frame.column(1), strict=True):
            place, _, _, first_id, first_number = _unpacked(data.as_py())
            node, component = (own.values.field(k).to_numpy() for k in range(2))
            wanted = node & BLOCK - 1
            at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            here = place[at] == wanted
            at = at[here]
            yield pa.RecordBatch.from_arrays([pa.array(component[here]), pa.array(first_id[at]), pa.array(first_number[at])], names=["component", "first_id", "first_line_no"])


def _judged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line_no, first_id, first_line_no, kept) of all lines, from packs (data) with the first lines of their block's linked nodes (own)."""
    for frame in frames:
        for data, own in zip(frame.column(0), frame.column(1), strict=True):
            place, id_, number, first_id, first_number = _unpacked(data.as_py())
            if own.is_valid:
                node, won_id, won_number = (own.values.field(k).to_numpy() for k in range(3))
                at = np.full(BLOCK, -1)
                at[node & BLOCK - 1] = np.arange(len(node))
                at = at[place]
                first_id, first_number = np.where(at < 0, first_id, won_id[at]), np.where(at < 0, first_number, won_number[at])
            kept = (id_ == first_id) & (number == first_number)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id_, number, first_id, first_number, kept)], names=["id", "line_no", "first_id", "first_line_no", "kept"])


def _part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _packed_bands(parts: list[int], chars: int):
    """Entries of the bands of (node, text), in packs by their hash."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hashed, sizes, more = (np.concatenate(x) for x in zip(*kept, strict=True))
            part_of = _part_of(hashed.reshape(-1), len(parts)).astype(np.min_scalar_type(len(parts)))
            order = np.argsort(part_of, kind="stable")
            dealt, line = hashed.reshape(-1)[order], order // BANDS
            step = (np.log(sizes) * SIZE_STEPS).astype("u1")
            cuts = np.append(0, np.cumsum(np.bincount(part_of, minlength=len(parts))))
            more = more.reshape(-1)[order]
            entry = {"low": dealt.astype("<u2"), "high": (dealt >> np.uint64(16)).astype("u1"), "at": line.astype("<u2"), "step": step[line], "more": more.astype("<u4"), "rest": (more >> np.uint64(32)).astype("<u2")}
            known = np.array(nodes, dtype=np.int64)
            run = bool((np.diff(known) == 1).all())
            rows = []
            for k, part in enumerate(parts):
                own = {c: x[cuts[k] : cuts[k + 1]] for c, x in entry.items()}
                # nodes that follow one another are told by the first
                base = known[:1]
                if not run and len(own["at"]):
                    base, own["at"] = np.unique(own["at"], return_inverse=True)
                    base, own["at"] = known[base], own["at"].astype("<u2")
                if len(own["at"]):
                    rows.append((part, pickle.dumps((k, run, base, *[x.tobytes() for x in own.values()]), 5)))
            yield from batches(rows, _PACKED, 64)

        for frame in frames:
            for at in range(0, frame.num_rows, 5_000):
                piece = frame.slice(at, 5_000)
                regs, sizes = _sketch([x.decode("utf-8", "surrogatepass") for x in piece.column(1).to_pylist()], chars)
                kept.append((_band_hashes(regs), sizes, _more_bits(regs)))
                nodes += piece.column(0).to_pylist()
                if len(nodes) > FLUSH_LINES - 5_000:
                    yield from flush()
                    nodes.clear()
                    kept.clear()
        if nodes:
            yield from flush()

    return pack


def _shared_bands(num: int, den: int):
    """From packs of entries: (a, b) of lines that may be alike by a bucket; of a dense bucket (a, band) of each such line, and pairs with its first one."""
    most = int(np.log(den / num) * SIZE_STEPS) + 1

    def likely(ends: np.ndarray, step: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, gap = np.arange(len(ends)), 1
        while len(at := at[at + gap < ends[at]]):
            # no prune by step: it counts places, and lines that repeat themselves have equal sets at other lengths
            left = at[_agree(more[at], more[at + gap])]
            yield left, left + gap
            gap += 1

    def share(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for frame in frames:
            for data in frame.column(1):
                part, run, base, *own = pickle.loads(data.as_py())
                low, high, place, step, more, rest = (np.frombuffer(x, dtype=kind) for x, kind in zip(own, _ENTRY.values(), strict=True))
                hashed = high.astype(np.uint32) << np.uint32(16) | low
                by_part.setdefault(part, []).append((hashed, base[0] + place.astype(np.int64) if run else base[place], step, rest.astype(np.uint64) << np.uint64(32) | more))
        for part, packs in by_part.items():
            hashed, node, step, more = (np.concatenate(x) for x in zip(*packs, strict=True))
            order = np.argsort(hashed)
            hashed = hashed[order]
            same = hashed[1:] == hashed[:-1]
            some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            order, hashed = order[some], hashed[some]
            node, step, more = node[order], step[order].astype(np.int16), more[order]
            starts = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]])) if len(hashed) else np.empty(0, dtype=np.int64)
            sizes = np.diff(np.append(starts, len(hashed)))
            bucket = np.repeat(np.arange(len(starts)), sizes)
            large = (sizes > LARGE)[bucket]
            ends = np.where(large, 0, (starts + sizes)[bucket])
            # what a bucket gives is counted before it is made
            count, wanted = np.zeros(len(starts), dtype=np.int64), large.copy()
            for left, right in likely(ends, step, more):
                np.add.at(count, bucket[left], 1)
                wanted[left] = wanted[right] = True
            dense = wanted & (large | (count > DENSE * sizes)[bucket])
            pairs = [(node[left], node[right]) for left, right in likely(np.where(dense, 0, ends), step, more)]
            inside = np.flatnonzero(dense)
            hub = np.full(len(starts), len(node), dtype=np.int64)
            np.minimum.at(hub, bucket[inside], inside)
            pairs.append((node[hub[bucket[inside]]], node[inside]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = (a != b) & np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
            a, b = a[fresh], b[fresh]
            for columns in (a, b, None), (node[inside], None, (part << 24) + hashed[inside].astype(np.int64)):
                for at in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0][at : at + 50_000]), pa.int64()) if c is None else pa.array(c[at : at + 50_000]) for c in columns], names=["a", "b", "band"])

    return share


def _shingle_sets(lines: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct place << 50 | hash of the shingles of the line in that place, number of them by place)."""
    codes, sizes = _codes(lines, chars)
    hashed = _shingles(codes.astype(np.uint64), chars)
    inside = np.ones(len(hashed) + chars - 1, dtype=bool)
    for back in range(1, chars):
        inside[np.cumsum(sizes) - back] = False
    place = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes)[inside]
    keys = np.sort(place << np.uint64(50) | hashed[inside[: len(hashed)]] >> np.uint64(14))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.bincount((keys >> np.uint64(50)).astype(np.int64), minlength=len(lines))


def _repeated_sets(stored: list[bytes], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """``_shingle_sets`` of stored lines, made once for each distinct one."""
    place = {x: k for k, x in enumerate(dict.fromkeys(stored))}
    keys, sizes = _shingle_sets([x.decode("utf-8", "surrogatepass") for x in place], chars)
    of = np.array([place[x] for x in stored])
    counts = sizes[of]
    keys = keys[_spread((np.cumsum(sizes) - sizes)[of], counts)] & np.uint64((1 << 50) - 1)
    return np.repeat(np.arange(len(of), dtype=np.uint64) << np.uint64(50), counts) | keys, counts


def _alike_lines(num: int, den: int, chars: int):
    """The pairs (a, b) of (a, b, text of a, text of b) whose whole sets have the similarity that links."""

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ok = []
            for at in range(0, frame.num_rows, 200):
                (one, na), (two, nb) = (_repeated_sets(frame.column(k).slice(at, 200).to_pylist(), chars) for k in (2, 3))
                keys = np.sort(np.concatenate([one, two]), kind="stable")
                both = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(50)).astype(np.int64), minlength=len(na))
                ok.append((both > 0) & (den * both >= num * (na + nb - both)))
            mask = pa.array(np.concatenate(ok) if ok else [], pa.bool_())
            yield pa.RecordBatch.from_arrays([frame.column(0).filter(mask), frame.column(1).filter(mask)], names=["u", "v"])

    return check


def _large_members(parts: int, chars: int):
    """(no, band, node, n, sig) of the lines of large buckets, from (node, text, bands)."""
    schema = StructType([StructField("no", IntegerType()), StructField("band", LongType()), StructField("node", LongType()), StructField("n", IntegerType()), StructField("sig", BinaryType())])

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 1_000):
                node, text, bands = (frame.column(k).slice(at, 1_000).to_pylist() for k in range(3))
                regs, _ = _sketch(lines := [x.decode("utf-8", "surrogatepass") for x in text], chars)
                hashed = _band_hashes(regs)
                hashed = (_part_of(hashed, parts) << 24) + (hashed & np.uint64(0xFFFFFF)).astype(np.int64)
                sizes = _shingle_sets(lines, chars)[1].tolist()
                yield from batches([(no, own[no], node[k], sizes[k], regs[k].tobytes()) for k, own in enumerate(hashed.tolist()) for no in range(BANDS) if own[no] in bands[k]], schema)

    return place, schema


def _forest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): a link of each node that has a smaller one with the smallest that the links of this task lead to."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for frame in frames:
        for x, y in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield from batches([(x, root(x)) for x in up], StructType([StructField("u", LongType()), StructField("v", LongType())]))


def _joined(links: DataFrame) -> DataFrame:
    """Components of ``links`` (u, v), of which tasks first make forests: a group of near copies has many links."""
    tasks = 1 + links.count() // FOREST
    return components(links.coalesce(tasks).mapInArrow(_forest, "u long, v long"))


def _labels(texts: DataFrame, num: int, den: int, chars: int) -> DataFrame:
    """(node, component) of all linked lines of ``texts`` (node, text).

    Likely pairs of a bucket are all checked on their whole sets, unless it has
    many. Then each line is checked with the first, which joins most of a group
    of near copies; what is still apart there is compared by chunks.
    """
    spark = texts.sparkSession
    parts = _parts(spark)
    entries = texts.mapInArrow(_packed_bands(parts, chars), _PACKED).repartition(len(parts), "part")
    found = written(entries.mapInArrow(_shared_bands(num, den), "a long, b long, band long"), "found")
    release(spark)
    pairs = written(found.where("b is not null").select("a", "b").distinct(), "pairs")
    bands = written(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.collect_set("band").alias("bands")), "bands")
    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(bands.select("node")).distinct(), "wanted")
    # all texts are read once for both ways
    sets = written(restrict(texts, wanted, "node"), "sets", **TEXTS)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    first = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_alike_lines(num, den, chars), "u long, v long"), "links")
    if bands.isEmpty():
        return _joined(first)
    labels = written(_joined(first), "labels")
    place, schema = _large_members(len(parts), chars)
    members = written(restrict(sets, bands, "node").join(bands, "node").select("node", "text", "bands").mapInArrow(place, schema), "members")
    fetch = lambda wanted: restrict(sets, wanted, "node").select("node", F.col("text").alias("set"))
    s = Sketches(members.select("node", "n", "sig").dropDuplicates(["node"]), ROWS * 2, BANDS, "<u2", fetch, equal_share, num / den - MARGIN, num, den, partial(_stored_set, chars=chars))
    second = written(across(s, members.select("no", "band", "node"), labels), "links")
    return labels if second.isEmpty() else _joined(first.union(second))


def line_classes(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """(id, line_no, first_id, first_line_no, kept) of every line that is not blank.

    Lines are linked if the Jaccard similarity of their sets of shingles of
    ``chars`` characters is num / den or more. The first line of a component, by id and number, is
    kept. Equal lines are one node, found by a 128-bit hash, so a line that a
    third of all documents share is never paired with itself.

    Lines and bands travel in packs, one row for each task and partition; a
    partition's must fit into its task, as ``spark.sql.shuffle.partitions`` sets.

    Null and empty texts have no lines. Rows with a null id take no part.
    Repeated rows of an id are one document. Lines of any length are read
    whole. Extra columns are not read. An empty table gives no rows.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = _parts(docs.sparkSession)
    lines = written(source.mapInArrow(_packed_lines(parts), _PACKED).repartition(len(parts), "part").mapInArrow(_numbered, _LINES), "lines", **TEXTS)
    # the shuffle's files are as large as the lines, and those of the bands are to come
    release(docs.sparkSession)
    labels = written(_labels(lines.where("text is not null").select("node", "text"), num, den, chars), "labels")
    packs = lines.where("data is not null").select("block", "data")
    by_block = lambda rows, *columns: rows.groupBy(F.shiftright("node", BLOCK_BITS).alias("block")).agg(F.collect_list(F.struct("node", *columns)).alias("own"))
    firsts = packs.join(by_block(labels, "component"), "block").select("data", "own").mapInArrow(_first_lines, "component long, first_id long, first_line_no int")
    winners = firsts.groupBy("component").agg(F.min(F.struct("first_id", "first_line_no")).alias("winner")).select("component", "winner.*")
    won = written(labels.join(winners, "component").select("node", "first_id", "first_line_no"), "won")
    judged = packs.join(by_block(won, "first_id", "first_line_no"), "block", "left").select("data", "own")
    return judged.mapInArrow(_judged, "id long, line_no int, first_id long, first_line_no int, kept boolean").withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of the text; columns and rows stay.

    Blank lines stay, and so do rows with a null id or text.
    """
    gone = line_classes(docs, num, den, id_col, text_col, chars).where("not kept").groupBy(F.col(id_col).alias("_id")).agg(F.collect_list("line_no").alias("_gone"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda _, k: ~F.array_contains("_gone", k))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return docs.join(gone, docs[id_col] == F.col("_id"), "left").select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
