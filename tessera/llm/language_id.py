"""Language identification by naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
N_GRAMS = (1, 2, 3)
HASH_BITS = 16
#: Characters that are hashed at once.
CHUNK = 1 << 17
#: Log-probabilities that are gathered at once, about.
GATHERED = 1 << 22
#: Characters of texts that are scored together, about.
PIECE = 1 << 20
#: Distinct labelled texts of a language that are learned from, about; larger languages are thinned by a hash of the text.
TRAIN_DOCUMENTS = 2_000
#: Label values; more is an error.
MAX_LANGUAGES = 1_000
SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, one after another, with all but letters as spaces; the texts' ends; which are letters."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    small = codes < 1 << 16
    letter = small & _letters()[np.where(small, codes, 0).astype(np.int64)]
    for i in np.flatnonzero(~small):
        letter[i] = chr(int(codes[i])).isalpha()
    return np.where(letter, codes, np.uint64(SPACE)), np.cumsum([len(t) for t in low], dtype=np.int64), letter


def _buckets(codes: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash bucket) of all n-grams, by text, in pieces of bounded size; none reaches over the end of its text."""
    for at in range(0, len(codes), chunk):
        upto = min(at + chunk, len(codes))
        first, last = np.searchsorted(ends, [at, upto - 1], side="right")
        inside = np.minimum(ends[first : last + 1], upto)
        text = np.repeat(np.arange(first, last + 1), np.diff(inside, prepend=at))
        for n in N_GRAMS:
            piece = codes[at : upto + n - 1]
            if len(piece) < n:
                continue
            hashed = np.full(len(piece) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                hashed = (hashed ^ piece[k : len(piece) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            own = text[: len(hashed)]
            fits = at + np.arange(len(hashed)) + n <= ends[own]
            yield own[fits], ((hashed[fits] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log-probabilities of the buckets, a column for each language, and of the languages themselves."""

    languages: list[str]
    logs: np.ndarray
    priors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors of a batch: one sparse product of its n-grams, row by text, with the log matrix."""
        codes, ends, letter = _codes(texts)
        letters = np.concatenate([[0], np.cumsum(letter)])[ends]
        lettered = np.diff(letters, prepend=0) > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.priors, (len(texts), 1))
        for text, bucket in _buckets(codes, ends, min(CHUNK, GATHERED // len(self.languages) + 1)):
            if len(text):
                starts = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[starts]] += np.add.reduceat(self.logs[bucket], starts, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [self.languages[k] if known else UNKNOWN for k, known in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit(labelled: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> Model:
    """Model of ``labelled`` (lang, text), null labels and texts left out.

    About ``per_language`` distinct texts of each language are used, whole and
    once, drawn by a hash of the text, so that copies neither fill the sample
    nor leave it empty. N-gram counts are summed by language and bucket before
    they come to the driver: at most languages x 2**HASH_BITS rows. A
    language's prior is its share of the labelled rows.
    """
    labelled = labelled.dropna(subset=["lang", "text"])
    by_text = labelled.groupBy("lang", F.xxhash64("text").alias("_h")).count()
    sizes = {r[0]: (r[1], r[2]) for r in by_text.groupBy("lang").agg(F.count("*"), F.sum("count")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << HASH_BITS, 0), dtype=np.float32), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang][0]))])
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) * F.lit(2.0**-53)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                own = counts.setdefault(lang, np.zeros(1 << HASH_BITS, dtype=np.int64))
                codes, ends, _ = _codes(texts.tolist())
                for _, buckets in _buckets(codes, ends):
                    own += np.bincount(buckets, minlength=1 << HASH_BITS)
        for lang, own in counts.items():
            seen = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": own[seen]})

    sampled = labelled.select("lang", "text").where(draw < shares[F.col("lang")]).dropDuplicates()
    summed = sampled.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << HASH_BITS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[summed["bucket"].to_numpy(np.int64), [place[x] for x in summed["lang"]]] = summed["n"]
    smoothed = counts + 0.5
    rows = np.array([sizes[lang][1] for lang in languages], dtype=np.float64)
    return Model(languages, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32), np.log(rows / rows.sum()))


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts with about PIECE characters together, whole texts all of them."""
    own: list[str | None] = []
    size = 0
    for text in texts:
        own.append(text)
        size += len(text or "")
        if size >= PIECE:
            yield own
            own, size = [], 0
    if own:
        yield own


def predictor(spark, model: Model) -> Callable[[Column], Column]:
    """Column function text -> struct(lang_pred, score); the model is broadcast, languages x 2**HASH_BITS floats."""
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(schema)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            found = [own.predict(texts) for texts in _pieces(batch.tolist())]
            yield pd.DataFrame({"lang_pred": [x for langs, _ in found for x in langs], "score": np.concatenate([np.zeros(0), *[scores for _, scores in found]])})

    return predict


def held_out(id_col: str) -> Column:
    """crc32 of the id's text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of ``docs``.

    Learns from the labelled rows that are not held out; a prediction sees the
    whole text and nothing else. score is the posterior of the language, whose
    prior is its share of the labelled rows.

    Null, empty and letterless texts get ``und`` and 0. Rows with a null id or
    label are predicted and not learned from. Without any label all rows get
    ``und``. Repeated rows and extra columns change nothing else.
    """
    out = held_out(id_col)
    model = fit(docs.where(F.col(id_col).isNotNull() & ~out).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    predict = predictor(docs.sparkSession, model)
    return docs.select(F.col(id_col), out.alias("held_out"), predict(F.col(text_col)).alias("_p")).select(id_col, "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is known with a posterior of ``least`` or more.

    Only texts without a letter and texts that no language explains best go,
    null and empty ones with them. Repeated rows stay or go together; rows with
    a null id or label are judged like others. Without any label no row stays.
    An empty table gives no rows.
    """
    model = fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    found = predictor(docs.sparkSession, model)(F.col(text_col))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), found.alias("_p")).where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least)).select("_d.*")
