"""Benchmark decontamination: a BM25 index of test items, queried by every passage."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tessera.llm.arrow import batches
from tessera.llm.scratch import written

#: Items that are indexed and broadcast at once; a larger benchmark is taken in blocks of about this many.
BLOCK_ITEMS = 20_000
#: Items that share one bound in the index.
BOUND_ITEMS = 4
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: A passage retrieves the items of whose own score it reaches this share.
RETRIEVE = 0.5
#: Words of a shingle, and the share of an item's shingles that makes a leak.
WORDS, OVERLAP = 5, 0.8
#: Share of its limit that an item gets from the terms that only open blocks are looked up for.
LIGHT = 0.2
#: Cells of windows and blocks whose bounds are summed at once, and open ones that are scored at once.
STEP, CELLS = 1 << 20, 1 << 11
#: Every item's limit, less what the order of a sum can change.
REACHED = 1 - 1e-9

_WORD = re.compile(r"\w+")
_LAST = re.compile(r"(?s)^(.*[.!?])\s+(\S.*)$")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item: the last sentence answers; a single sentence is all question."""
    m = _LAST.match(text.strip())
    return (m[1], m[2]) if m else (text, "")


def _shingles(ids: list[int]) -> set[tuple[int, ...]]:
    return {tuple(ids[k : k + WORDS]) for k in range(max(1, len(ids) - WORDS + 1))} if ids else set()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all the ranges starts[i] .. starts[i] + sizes[i], one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _holds(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether the sorted ``keys`` hold each of ``wanted``."""
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


@dataclass(frozen=True)
class Statistics:
    """What BM25 knows of the whole benchmark: items, their mean length, and the items that hold a word."""

    items: int
    mean: float
    holders: dict[str, int]

    @staticmethod
    def of(words: list[list[str]]) -> Statistics:
        return Statistics(len(words), sum(map(len, words)) / max(len(words), 1), Counter(w for x in words for w in set(x)))


class _Class:
    """Items of like length, in blocks of BOUND_ITEMS: their terms' bounds and postings.

    The commonest terms of an item, whose weights sum up to LIGHT at most, are
    its light ones. The others' bounds are listed by term; what an item of a
    block can get from light terms is one number of the block. The rest is by
    block: entries are the terms of the blocks, one block after another.
    """

    def __init__(self, members: list[int], weights: list[dict[int, float]], commonness: np.ndarray, longest: int):
        self.longest = longest
        self.members = sorted(members, key=lambda i: (sorted(weights[i], key=lambda t: (commonness[t], t)), i))
        blocks = -(-len(members) // BOUND_ITEMS)
        bounds: list[dict[int, float]] = [{} for _ in commonness]
        rests, sizes, terms, held, places, posted = np.zeros(blocks), [], [], [], [], []
        for block in range(blocks):
            postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for place, i in enumerate(self.members[block * BOUND_ITEMS : (block + 1) * BOUND_ITEMS]):
                light = upto = 0.0
                for t in sorted(weights[i], key=lambda t: (-commonness[t], t)):
                    postings[t].append((place, weights[i][t]))
                    upto += weights[i][t]
                    if upto <= LIGHT:
                        light = upto
                    else:
                        bounds[t][block] = max(bounds[t].get(block, 0.0), weights[i][t])
                rests[block] = max(rests[block], light)
            sizes.append(len(postings))
            for t in sorted(postings):
                terms.append(t)
                held.append(len(postings[t]))
                places += [place for place, _ in postings[t]]
                posted += [w for _, w in postings[t]]
        self.needed = REACHED - rests
        self.bound_size = np.array([len(x) for x in bounds], dtype=np.int64)
        self.bound_start = np.cumsum(self.bound_size) - self.bound_size
        self.bound_block = np.array([b for x in bounds for b in sorted(x)], dtype=np.int64)
        self.bound = np.array([x[b] for x in bounds for b in sorted(x)])
        self.size, self.term = np.array(sizes, dtype=np.int64), np.array(terms, dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.held, self.place, self.weight = np.array(held, dtype=np.int64), np.array(places, dtype=np.int64), np.array(posted)
        self.first = np.cumsum(self.held) - self.held

    def _open(self, own: np.ndarray, windows: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(windows, blocks, bounds read) that the bounds leave open.

        A window's bounds are those of its two halves, so each half is summed
        once; terms of both halves count twice, which only loosens the bound.
        """
        n, blocks = len(self.bound_size), len(self.needed)
        step = max(1, STEP // blocks)
        for first in range(0, windows, step):
            count = min(step, windows - first)
            a, b = np.searchsorted(own, [first * n, (first + count + 1) * n])
            term = own[a:b] % n
            size = self.bound_size[term]
            entry = _spread(self.bound_start[term], size)
            cell = np.repeat(own[a:b] // n - first, size) * blocks + self.bound_block[entry]
            sums = np.bincount(cell, weights=self.bound[entry], minlength=(count + 1) * blocks).reshape(count + 1, blocks)
            window, block = np.nonzero(sums[:-1] + sums[1:] >= self.needed)
            yield window + first, block, len(entry)

    def retrieve(self, terms: np.ndarray) -> tuple[list[tuple[int, int, float]], int]:
        """(window, item, score) where an item reaches its limit; bounds, terms and postings read.

        Windows are twice the longest item long and half overlap.
        """
        n, read = len(self.bound_size), 0
        found: list[tuple[int, int, float]] = []
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return found, read
        own = np.unique(at // self.longest * n + terms[at])
        for windows, blocks, bounds in self._open(own, max((len(terms) - 1) // self.longest, 1)):
            read += bounds
            for k in range(0, len(windows), CELLS):
                window, block = windows[k : k + CELLS], blocks[k : k + CELLS]
                entry = _spread(self.start[block], self.size[block])
                row = np.repeat(np.arange(len(block)), self.size[block])
                read += len(entry)
                key = window[row] * n + self.term[entry]
                there = _holds(own, key) | _holds(own, key + n)
                entry, row = entry[there], row[there]
                posting = _spread(self.first[entry], self.held[entry])
                read += len(posting)
                slot = np.repeat(row, self.held[entry]) * BOUND_ITEMS + self.place[posting]
                scores = np.bincount(slot, weights=self.weight[posting])
                for x in np.flatnonzero(scores >= REACHED).tolist():
                    cell, place = divmod(x, BOUND_ITEMS)
                    found.append((int(window[cell]), self.members[int(block[cell]) * BOUND_ITEMS + place], float(scores[x])))
        return found, read


class Index:
    """Inverted index of test items with block maxima.

    Weights are BM25's, divided by the score that an item must reach, so that
    every item's limit is 1. As in block-max WAND, the rarer terms of a passage
    decide by their bounds which blocks of items can reach it at all; only in
    these the commoner ones and the postings are read. That is done for all
    windows of a text at once. Items are indexed by classes of length, so that
    a long one doesn't stretch the windows of the others. ``read`` counts the
    bounds, terms of blocks and postings that searches looked at.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        self.ids = [i for i, _ in items]
        self.read = 0
        texts = [text for _, text in items]
        words = [_words(t) for t in texts]
        known = statistics or Statistics.of(words)
        self.terms = {w: k for k, w in enumerate(sorted({w for x in words for w in x}))}
        of = [[self.terms[w] for w in x] for x in words]
        commonness = np.array([known.holders[w] for w in self.terms], dtype=np.int64)
        idf = np.log(1 + (known.items - commonness + 0.5) / (commonness + 0.5))
        weights: list[dict[int, float]] = []
        classes: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(of):
            own = {t: float(idf[t]) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x) / known.mean)) for t, n in Counter(x).items()}
            limit = RETRIEVE * sum(own.values())
            weights.append({t: w / limit for t, w in own.items()})
            if x:
                classes[len(x).bit_length() // 2].append(i)
        self.classes = [_Class(own, weights, commonness, max(len(of[i]) for i in own)) for _, own in sorted(classes.items())]
        parts = [split_item(t) for t in texts]
        ids = lambda text: [self.terms[w] for w in _words(text)]
        self.whole = [_shingles(x) for x in of]
        self.parts = [(_shingles(ids(q)), _shingles(ids(a))) for q, a in parts]

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float, float | None]]:
        """item's place -> (score, overlap, question's and answer's overlap) of the items that leak into ``text``."""
        found: dict[int, tuple[float, float, float, float | None]] = {}
        if not text or not self.terms:
            return found
        words = _words(text)
        terms = np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        for own in self.classes:
            passages: dict[int, set] = {}
            retrieved, read = own.retrieve(terms)
            self.read += read
            for window, i, score in retrieved:
                piece = terms[window * own.longest : (window + 2) * own.longest]
                if window not in passages:
                    passages = {window: _shingles_of(piece)}
                self._verify(i, score * RETRIEVE, passages[window], piece, found)
        return found

    def _verify(self, i: int, score: float, passage: set, piece: np.ndarray, found: dict) -> None:
        overlap = _share(self.whole[i], passage, piece)
        question, answer = (_share(x, passage, piece) if x else None for x in self.parts[i])
        if overlap >= OVERLAP or (question or 0) >= OVERLAP and (answer is None or answer >= OVERLAP):
            if i not in found or (overlap, score) > (found[i][1], found[i][0]):
                found[i] = (score, overlap, question, answer)


def _shingles_of(terms: np.ndarray) -> set[tuple[int, ...]]:
    ids = terms.tolist()
    return {tuple(ids[k : k + WORDS]) for k in range(len(ids) - WORDS + 1)}


def _share(wanted: set[tuple[int, ...]], passage: set[tuple[int, ...]], piece: np.ndarray) -> float:
    """Share of ``wanted`` in the passage; a sequence of fewer words than a shingle is looked for as it is."""
    short = len(next(iter(wanted)))
    if short < WORDS:
        ids = piece.tolist()
        passage = {tuple(ids[k : k + short]) for k in range(len(ids) - short + 1)}
    return len(wanted & passage) / len(wanted)


@F.pandas_udf(ArrayType(StringType()))
def _word_lists(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(_words)


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[Index]:
    """Indices of the items in blocks that fit into a broadcast; by a hash of the item if there are several.

    Statistics are those of the whole benchmark, whatever the blocks: they are
    summed by word on the cluster, and a block gets those of its own words.
    """
    items = benchmark.where("text is not null").select("item_id", "text")
    blocks = -(-items.count() // block_items)
    if blocks > 1:
        listed = items.select(_word_lists("text").alias("words")).where(F.size("words") > 0)
        total = listed.agg(F.count("*"), F.avg(F.size("words"))).first()
        holders = written(listed.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count(), "benchmark_words")
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        found = sorted(((r[0], r[1]) for r in own.collect() if _words(r[1])), key=lambda x: (x[0] is None, x[0], x[1]))
        if found and blocks > 1:
            words = own.select(F.explode(_word_lists("text")).alias("word")).distinct()
            yield Index(found, Statistics(total[0], total[1], {r[0]: r[1] for r in holders.join(words, "word", "leftsemi").collect()}))
        elif found:
            yield Index(found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap): test items that leak into documents.

    Every window of every document's words queries the index; retrieved items
    are verified by the share of their five-word shingles (case and punctuation
    aside) in the window: 0.8 or more of the item, or of its question and of
    its answer. One row for a document and an item, of the best window; score
    is the share of the item's own BM25 score.

    Null and empty texts and items leak nothing. Items under five words must
    occur as they are. Rows are searched one by one: repeated rows repeat their
    leaks, null ids keep theirs. The benchmark is broadcast in blocks of about
    ``block_items`` items, which change no result. Extra columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = StructType(
        [StructField(id_col, id_type), StructField("item_id", LongType()), *[StructField(c, DoubleType()) for c in ("score", "overlap", "question_overlap", "answer_overlap")]]
    )
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    result = spark.createDataFrame([], schema)
    for k, index in enumerate(_blocks(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), block_items)):
        shared = spark.sparkContext.broadcast(index)

        def search(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in found:
                rows = []
                for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(id_, index.ids[i], *leak) for i, leak in sorted(index.leaks(text).items())]
                yield from batches(rows, schema)

        own = texts.mapInArrow(search, schema)
        result = own if k == 0 else result.unionByName(own)
    return result


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Rows of ``docs`` into which no test item leaks; columns unchanged.

    The index answers row by row, so nothing is shuffled and null or repeated
    ids need no care.
    """
    items = benchmark.select(F.col("item_id"), F.col("text"))
    for index in _blocks(items, block_items):
        docs = docs.where(~_leak_test(docs.sparkSession.sparkContext.broadcast(index))(F.col(text_col)))
    return docs


def _leak_test(shared):
    """Column function text -> whether an item of the broadcast index leaks into it."""

    @F.pandas_udf("boolean")
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([bool(shared.value.leaks(t)) for t in batch], dtype=bool)

    return leaks
