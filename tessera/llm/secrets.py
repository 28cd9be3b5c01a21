"""Secret scans: known shapes, and a battery of randomness tests for the rest."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.arrow import batches
from tessera.llm.scratch import written

#: Kinds of spans, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")

# fixed values: the shapes and least lengths of the known kinds
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LEAST = 8
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ACCESS_LEAST = 16
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Runs of these that are long enough are tested for randomness.
_CANDIDATE_LEAST = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{_CANDIDATE_LEAST},}}")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest alphabet to the widest; the first that holds all characters is inferred.
ENCODINGS = {
    "digits": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "letters": _LOWER + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "any": _UPPER + _LOWER + _DIGITS + "+/_=-",
}
_SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}

# fixed values: per cent of the letters a to z in English prose
_PROSE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)

#: Of the spans that the battery reports, this share at most is prose in expectation.
FALSE_DISCOVERIES = 0.01
#: A string whose joint p-value as a random one is below this isn't random.
RANDOM_LEAST = 0.001
#: Nodes and weights of the integral over the chi-squared's part.
_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(48)
#: Bins of -log10(p) to a unit and their greatest value.
_BINS, _DEEPEST = 8, 60


def _excess(alphabet: str) -> float:
    """Chi-squared a character, beyond chance, of prose in ``alphabet``: how far prose is from uniform."""
    shares = np.full(len(alphabet), 1e-4)
    for letter, share in zip(_LOWER, _PROSE, strict=True):
        for c, part in ((letter, 1.0), (letter.upper(), 0.03 if letter in alphabet else 1.0)):
            if c in alphabet:
                shares[alphabet.index(c)] += share * part
    for digit in _DIGITS:
        if digit in alphabet:
            # digits of prose come in numbers: mostly low and few
            shares[alphabet.index(digit)] += 30.0 / (1 + int(digit)) if alphabet == _DIGITS else 0.05
    shares /= shares.sum()
    return len(alphabet) * float((shares**2).sum()) - 1


_EXCESS = {name: _excess(chars) for name, chars in ENCODINGS.items()}


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _nearer(joint: float, mean: float, deviation: float) -> float:
    """Chance of a distance up to ``joint`` if the chi-squared's part has this mean and deviation and the others are standard normal."""
    reach = math.sqrt(joint)
    at = (_NODES + 1) * reach / 2
    density = np.exp(-(((at - mean) / deviation) ** 2) / 2) / (deviation * math.sqrt(2 * math.pi))
    inside = reach / 2 * float(_NODE_WEIGHTS @ (density * -np.expm1((at**2 - joint) / 2)))
    return _below(-mean / deviation) * -math.expm1(-joint / 2) + inside


def battery(text: str) -> tuple[str, float, float]:
    """(encoding, p as random, p as prose) of a string.

    Three statistics that are about standard normal for random strings over the
    inferred alphabet: chi-squared of the character counts, the number of runs
    above and below the alphabet's middle, and the serial correlation of
    neighbours. Their squares' sum is the distance from randomness; the first
    p-value is its chi-squared tail with three degrees.

    The second is the chance that prose of this length comes as near to
    randomness in all three tests. Its chi-squared grows with the length, so
    short strings can't reach small values; its runs and correlation are taken to
    spread as random ones do, the least that they can. A string that the first
    p-value rejects has 1 here: whatever control the second is under decides alone.
    """
    body = text.rstrip("=") or text
    own = set(body)
    encoding = next((name for name, chars in _SETS.items() if own <= chars), "any")
    alphabet = ENCODINGS[encoding]
    n, k = len(body), len(alphabet)
    codes = np.array([alphabet.index(c) for c in body], dtype=np.float64)
    counts = np.bincount(codes.astype(np.int64), minlength=k)
    chi = float((counts.astype(np.float64) ** 2).sum()) * k / n - n
    plain = math.sqrt(2 * (k - 1) * max(n - 1, 1) / n)
    z_chi = (chi - (k - 1)) / plain
    high = codes >= k / 2
    share = (k - math.ceil(k / 2)) / k
    expected, turn = 2 * (n - 1) * share * (1 - share), 2 * share * (1 - share)
    runs = int((high[1:] != high[:-1]).sum())
    z_runs = (runs - expected) / math.sqrt(max((n - 1) * turn * (1 - turn), 1e-9))
    spread = codes - codes.mean()
    total = float((spread**2).sum())
    z_serial = ((float((spread[1:] * spread[:-1]).sum()) / total) + 1 / n) * math.sqrt(n) if total else math.inf
    joint = max(z_chi, 0.0) ** 2 + z_runs**2 + z_serial**2
    as_random = math.erfc(math.sqrt(joint / 2)) + math.sqrt(2 * joint / math.pi) * math.exp(-joint / 2) if math.isfinite(joint) else 0.0
    if as_random < RANDOM_LEAST:
        return encoding, as_random, 1.0
    excess = _EXCESS[encoding]
    as_prose = _nearer(joint, (n - 1) * excess / plain, math.sqrt(2 * (k - 1) + 4 * n * excess) / plain)
    return encoding, as_random, max(as_prose, 10.0**-_DEEPEST)


def known_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known kinds, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int, str, float, float]]:
    """(start, end, encoding, p as random, p as prose) of long runs, known spans cut out of them.

    ``known`` is sorted by start, as the runs are; both are swept once.
    """
    found = []
    at, covered = 0, 0
    for m in _CANDIDATE.finditer(text):
        start, end = max(m.start(), covered), m.end()
        pieces = []
        while at < len(known) and known[at][1] < end:
            _, a, b = known[at]
            pieces.append((start, a))
            start, covered, at = max(start, b), max(covered, b), at + 1
        pieces.append((start, end))
        found += [(a, b, *battery(text[a:b])) for a, b in pieces if b - a >= _CANDIDATE_LEAST]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _stratum(start: Column, end: Column) -> Column:
    return F.floor(F.log2(end - start)).cast("int")


def _limits(tested: DataFrame, rate: float) -> dict[int, float]:
    """Benjamini-Hochberg p-value limit of each length stratum.

    Over all candidates of the corpus, from a histogram of p-values: strata x
    bins rows come to the driver whatever the size of the corpus. A limit is a
    bin's upper edge, so the procedure is never laxer than with exact ranks.
    """
    depth = F.least(F.floor(-F.log10("c.prose") * _BINS), F.lit(_DEEPEST * _BINS)).cast("int")
    rows = tested.groupBy(_stratum(F.col("c.start"), F.col("c.end")).alias("s"), depth.alias("d")).count().collect()
    limits = {}
    for stratum in {r["s"] for r in rows}:
        own = sorted(((r["d"], r["count"]) for r in rows if r["s"] == stratum), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for depth_of, n in own:
            seen += n
            edge = 10.0 ** (-depth_of / _BINS)
            if edge <= rate * seen / total:
                limits[stratum] = edge
    return limits


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    The known kinds are found by shape. Other long runs of code-like characters,
    without the known spans in them, are random secrets if the battery's p-value
    as prose, to which all three tests belong, is below the false-discovery limit
    of their length stratum, which all candidates of the corpus decide together.

    Null and empty texts have no spans. Texts are read whole; spans count code
    points. Rows are judged one by one, so null and repeated ids keep their
    rows. Extra columns are not read. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    candidate = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("encoding", StringType()), StructField("random", DoubleType()), StructField("prose", DoubleType())])
    base = StructType([StructField("start", IntegerType()), StructField("kind", IntegerType()), StructField("end", IntegerType())])
    schema = StructType(
        [StructField("id", id_type), *[StructField(f"n_{k}", LongType()) for k in KINDS[:3]], StructField("base_sha256", StringType()), StructField("base", ArrayType(base)), StructField("found", ArrayType(candidate))]
    )

    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in candidate]
        for batch in found:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = known_spans(text or "")
                counts = [sum(kind == k for kind, _, _ in known) for k in KINDS[:3]]
                listed = [{"start": a, "kind": KINDS.index(kind), "end": b} for kind, a, b in known]
                more = [dict(zip(names, c, strict=True)) for c in candidates(text or "", known)]
                rows.append((id_, *counts, hashlib.sha256(joined(known).encode()).hexdigest(), listed, more))
            yield from batches(rows, schema)

    scanned = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, schema), "secrets")
    random_kind = KINDS.index("random")
    tested = scanned.select(F.explode("found").alias("c"))
    limits = _limits(tested, rate)
    if limits:
        table = F.create_map(*[F.lit(x) for s, p in sorted(limits.items()) for x in (s, p)])
        passes = lambda c: c["prose"] <= F.coalesce(F.try_element_at(table, _stratum(c["start"], c["end"])), F.lit(-1.0))
        more = F.transform(F.filter("found", passes), lambda c: F.struct(c["start"].alias("start"), F.lit(random_kind).alias("kind"), c["end"].alias("end")))
        every = F.array_sort(F.concat("base", more))
    else:
        every = F.col("base")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return scanned.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(named, ",").alias("spans"))
