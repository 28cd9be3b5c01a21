"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.arrow import batches
from tessera.llm.scratch import written

#: Most frequent pre-tokens that are broadcast, at most, and the longest of them in bytes: 400,000 x 64 B is the bound.
HEAD_ENTRIES, HEAD_BYTES = 400_000, 64
#: Distinct words that a task remembers or sums up before it passes them on.
TASK_WORDS = 300_000
#: Bins of log2(frequency) in which the head's least frequency is sought.
BINS = 8

# ASCII and Latin-1 letters, then ASCII punctuation without the apostrophe: normalised and split without the library.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class PreTokenizer:
    """Pre-tokens of a word tokenizer, and the pieces of each, by the library's own parts.

    For tokenizers whose normalizer and pre-tokenizer drop white space, so that
    a text is counted as the sum of its words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        for probe in ("a b", "a\x0bb", "a \n\t b", "é's 12"):
            if self.encoded(probe) != sum(map(self.encoded, probe.encode().split())):
                raise ValueError("this tokenizer does not drop white space between words")
        for probe in ("Word,", "ÀÉ", "x.)"):
            if self.plain(probe) != self.split(probe):
                raise ValueError("this tokenizer does not lower-case letters and split at punctuation")

    def encoded(self, text: str | bytes) -> int:
        return len(self.whole.encode(text.decode() if isinstance(text, bytes) else text, add_special_tokens=False).ids)

    def split(self, word: str) -> tuple[str, ...]:
        """Pre-tokens of a word as normalised text; a special token is one, behind a space."""
        found: list[str] = []
        for k, part in enumerate(self.cut.split(word) if self.cut else [word]):
            if k % 2:
                found.append(f" {part}")
            elif part:
                text = self.whole.normalizer.normalize_str(part)
                found += [text[a:b] for _, (a, b) in self.whole.pre_tokenizer[0].pre_tokenize_str(text)]
        return tuple(p for p in found if p.strip(" "))

    def plain(self, word: str) -> tuple[str, ...] | None:
        """The same for the words that need no library; None for others."""
        if m := _PLAIN.fullmatch(word):
            return tuple(p for p in (m[1].lower(), m[2]) if p)
        return None

    def parts(self, word: bytes) -> tuple[str, ...]:
        text = word.decode()
        found = self.plain(text)
        return self.split(text) if found is None else found

    def pieces(self, pre_token: str) -> int:
        if pre_token[0] == " ":
            return 1
        return sum(len(self.whole.model.tokenize(p)) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(pre_token))


_VOCABULARY = StructType([StructField("piece", StringType()), StructField("n", LongType())])


def vocabulary(texts: DataFrame, path: str) -> DataFrame:
    """(piece, n, pieces) of every distinct pre-token of ``texts`` (text): its frequency and its tokens, counted once."""

    def distinct(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = PreTokenizer(path), Counter()

        def flush():
            parts: Counter = Counter()
            for word, n in words.items():
                for p in split.parts(word):
                    parts[p] += n
            words.clear()
            return batches(list(parts.items()), _VOCABULARY)

        for batch in found:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words.update(text.split())
                if len(words) > TASK_WORDS:
                    yield from flush()
        yield from flush()

    def tokens(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokenizer(path)
        for batch in found:
            counts = [split.pieces(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["piece", "n", "pieces"])

    summed = texts.where("text is not null").select("text").mapInArrow(distinct, _VOCABULARY).groupBy("piece").agg(F.sum("n").alias("n"))
    return summed.mapInArrow(tokens, "piece string, n long, pieces long")


def _head(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, tail) of a vocabulary: the head has at most HEAD_ENTRIES rows, of the highest frequencies."""
    bin_of = F.when(F.octet_length("piece") <= HEAD_BYTES, F.floor(F.log2("n") * BINS)).otherwise(-1)
    room, least = HEAD_ENTRIES, 1 << 30
    for row in sorted(counted.groupBy(bin_of.alias("b")).count().collect(), reverse=True):
        room -= row[1]
        if room < 0 or row[0] < 0:
            break
        least = row[0]
    return counted.where(bin_of >= least), counted.where(bin_of < least)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Pieces are counted once for each distinct pre-token of all texts. A pass
    over the texts then makes the pre-token frequencies of each document. Those
    of the most frequent pre-tokens meet their counts in the same pass, in a
    broadcast table of bounded size; the rest meet them in an equi-join, and
    the products are summed by document. No token id is ever made.

    Null and empty texts: 0 bytes, 0 tokens. Each row is counted by itself, so
    null and repeated ids keep their rows. Texts of any length are read whole,
    word by word. Extra columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = written(vocabulary(docs.select(F.col(text_col).alias("text")), path), "vocabulary")
    head, tail = _head(counted)
    found = head.select("piece", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)))
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("row", LongType()), StructField("id", id_type), StructField("n_bytes", LongType()), StructField("piece", StringType()), StructField("n", LongType())])

    def frequencies(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, heads = PreTokenizer(path), known.value
        words: dict[bytes, tuple[int, tuple[str, ...]]] = {}
        rows: list[tuple] = []
        for batch in batch_iter:
            for row, id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                summed, rest = 0, {}
                for word, n in Counter((text or b"").split()).items():
                    if (own := words.get(word)) is None:
                        if len(words) >= TASK_WORDS:
                            words.clear()
                        parts = split.parts(word)
                        own = words[word] = (sum(heads.get(p, 0) for p in parts), tuple(p for p in parts if p not in heads))
                    summed += own[0] * n
                    for p in own[1]:
                        rest[p] = rest.get(p, 0) + n
                # a key with a leading space and a digit is no pre-token: this row meets no count
                rows.append((row, id_, len(text or b""), f" {row}", summed))
                rows += [(row, None, None, p, n) for p, n in rest.items()]
                if len(rows) > 50_000:
                    yield from batches(rows, schema)
                    rows = []
        yield from batches(rows, schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = numbered.mapInArrow(frequencies, schema).join(tail.select("piece", "pieces"), "piece", "left")
    tokens = F.sum(F.col("n") * F.coalesce("pieces", F.when(F.col("n_bytes").isNotNull(), 1).otherwise(0)))
    summed = found.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return summed.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
