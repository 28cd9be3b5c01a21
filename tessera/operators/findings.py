"""Counters and finding rules: rules are data, one evaluator runs them all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.dims import literal_sql
from tessera.operators.rust_strings import stripped

#: Counters of a file, in report order.
COUNTERS = ("unsafe_blocks", "panic_sites", "unwrap_calls", "allocation_sites", "io_operations", "threading_constructs")


@dataclass(frozen=True, init=False)
class Count:
    """Non-overlapping occurrences of ``needles``, or of ``regex``, up to ``most``; in ``code`` without string literals."""

    needles: tuple[str, ...]
    regex: str | None
    most: int | None
    code: bool

    def __init__(self, *needles: str, regex: str | None = None, most: int | None = None, code: bool = False):
        for name, value in {"needles": needles, "regex": regex, "most": most, "code": code}.items():
            object.__setattr__(self, name, value)

    def column(self, content: str) -> Column:
        own = F.col("code" if self.code else content)
        found = F.regexp_count(own, F.lit(self.regex)).cast("long") if self.regex else text.literal_sum(own, self.needles)
        return found if self.most is None else F.least(found, F.lit(self.most).cast("long"))

    def sql(self, content: str) -> str:
        own = "code" if self.code else content
        found = f"len(regexp_extract_all({own}, {literal_sql(self.regex)}))" if self.regex else count_sql(self.needles, own)
        return found if self.most is None else f"least({found}, {self.most})"


@dataclass(frozen=True)
class Test:
    """One predicate on a text or on a counter; ``unless`` must not hold.

    ``or_all`` is an alternative to ``any_of``. ``pattern`` is counted, less the
    matches of ``minus``. ``code`` looks at the text without string literals.
    """

    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    regex: str | None = None
    counter: str | None = None
    needles: tuple[str, ...] = ()
    above: int = 0
    also_any: tuple[str, ...] = ()
    or_all: tuple[str, ...] = ()
    pattern: str | None = None
    minus: str | None = None
    code: bool = False

    def column(self, content: str) -> Column:
        own, found = F.col("code" if self.code else content), F.lit(True)
        if self.any_of:
            any_of = text.has_any(own, self.any_of)
            found = found & (any_of | text.has_all(own, self.or_all) if self.or_all else any_of)
        if self.also_any:
            found = found & text.has_any(own, self.also_any)
        if self.all_of:
            found = found & text.has_all(own, self.all_of)
        if self.unless:
            found = found & ~text.has_any(own, self.unless)
        if self.regex:
            found = found & F.rlike(own, F.lit(self.regex))
        if self.counter or self.needles or self.pattern:
            found = found & (self.count(content) > self.above)
        return found

    def count(self, content: str) -> Column:
        if self.counter:
            return F.col(self.counter)
        own = F.col("code" if self.code else content)
        if not self.pattern:
            return text.literal_sum(own, self.needles)
        found = F.regexp_count(own, F.lit(self.pattern))
        return (found - F.regexp_count(own, F.lit(self.minus)) if self.minus else found).cast("long")

    def sql(self, content: str = "content") -> str:
        content = "code" if self.code else content
        holds = lambda needles, word: "(" + word.join(f"contains({content}, {literal_sql(n)})" for n in needles) + ")"
        parts = []
        if self.any_of:
            parts.append(f"({holds(self.any_of, ' OR ')} OR {holds(self.or_all, ' AND ')})" if self.or_all else holds(self.any_of, " OR "))
        if self.also_any:
            parts.append(holds(self.also_any, " OR "))
        if self.all_of:
            parts.append(holds(self.all_of, " AND "))
        if self.unless:
            parts.append(f"NOT {holds(self.unless, ' OR ')}")
        if self.regex:
            parts.append(f"regexp_matches({content}, {literal_sql(self.regex)})")
        if self.counter or self.needles or self.pattern:
            parts.append(f"{self.count_sql(content)} > {self.above}")
        return " AND ".join(parts) or "TRUE"

    def count_sql(self, content: str = "content") -> str:
        if not self.pattern:
            return self.counter or count_sql(self.needles, content)
        found = f"len(regexp_extract_all({content}, {literal_sql(self.pattern)}))"
        return f"({found} - len(regexp_extract_all({content}, {literal_sql(self.minus)})))" if self.minus else found


@dataclass(frozen=True)
class Rule:
    """A finding: which languages (none: all), when, and what it says of a file; ``adds`` follows the path."""

    id: str
    languages: tuple[str, ...]
    test: Test
    category: str
    severity: str
    axes: tuple[str, ...]
    says: str
    adds: str = ""
    counts: Test | None = field(default=None)


def count_sql(needles: Sequence[str], content: str = "content") -> str:
    terms = [f"(length({content}) - length(replace({content}, {literal_sql(n)}, ''))) // {len(n)}" for n in needles]
    return "(" + (" + ".join(terms) or "0") + ")::BIGINT"


def _terms(needles: Sequence[str | Count]) -> list[Count]:
    """Plain needles as one term, and the others."""
    plain = [n for n in needles if isinstance(n, str)]
    return ([Count(*plain)] if plain else []) + [n for n in needles if not isinstance(n, str)]


def _total(needles: Sequence[str | Count], content: str) -> Column:
    total = F.lit(0).cast("long")
    for term in _terms(needles):
        total = total + term.column(content)
    return total


def _total_sql(needles: Sequence[str | Count], content: str) -> str:
    return "(" + (" + ".join(term.sql(content) for term in _terms(needles)) or "0") + ")::BIGINT"


def with_code(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with code: the text without the bodies of string literals of Rust files, else null."""
    return files.withColumn("code", stripped()(F.when(F.col("language") == "rust", F.col(content))))


def count_constructs(files: DataFrame, pack: dict[str, dict[str, Sequence[str | Count]]], content: str = "content") -> DataFrame:
    """``files`` with the six counters; ``pack``: language or ``*`` -> counter -> needles.

    One projection over the text; the needles of other languages cost nothing
    but a comparison of the language.
    """
    own = {}
    for counter in COUNTERS:
        total = _total(pack.get("*", {}).get(counter, ()), content)
        for language, counters in pack.items():
            if language != "*" and counters.get(counter):
                total = total + F.when(F.col("language") == language, _total(counters[counter], content)).otherwise(0)
        own[counter] = total.cast("long")
    return files.withColumns(own)


def count_constructs_sql(pack: dict[str, dict[str, Sequence[str | Count]]], content: str = "content") -> str:
    """Select items for the six counters."""
    items = []
    for counter in COUNTERS:
        terms = [_total_sql(pack.get("*", {}).get(counter, ()), content)]
        for language, counters in pack.items():
            if language != "*" and counters.get(counter):
                terms.append(f"CASE WHEN language = '{language}' THEN {_total_sql(counters[counter], content)} ELSE 0 END")
        items.append(f"({' + '.join(terms)})::BIGINT AS {counter}")
    return ", ".join(items)


def find(files: DataFrame, rules: Sequence[Rule], content: str = "content") -> DataFrame:
    """(repo, file, rule, category, severity, axes, description), a row for each rule that a file breaks.

    All rules are evaluated in one pass: an array of structs or nulls, filtered
    and exploded. Nothing is shuffled.
    """
    found = []
    for rule in rules:
        holds = rule.test.column(content)
        if rule.languages:
            holds = F.col("language").isin(*rule.languages) & holds
        number = (rule.counts or rule.test).count(content).cast("string") if "{n}" in rule.says else F.lit("")
        before, _, after = rule.says.partition("{n}") if "{n}" in rule.says else (rule.says, "", "")
        description = F.concat(F.lit(before), number, F.lit(after), F.lit(" in "), F.col("path"), F.lit(rule.adds))
        parts = {"rule": rule.id, "category": rule.category, "severity": rule.severity}
        struct = F.struct(*[F.lit(v).alias(k) for k, v in parts.items()], F.array(*[F.lit(a) for a in rule.axes]).alias("axes"), description.alias("description"))
        found.append(F.when(holds, struct))
    exploded = files.select("repo", F.col("path").alias("file"), F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f"))
    return exploded.select("repo", "file", "f.*")


def find_sql(rules: Sequence[Rule], files: str = "counted") -> str:
    """The same as a union of one select a rule."""
    selects = []
    for rule in rules:
        holds = rule.test.sql()
        if rule.languages:
            holds = f"language IN ({', '.join(map(literal_sql, rule.languages))}) AND {holds}"
        number = f"({(rule.counts or rule.test).count_sql()})::VARCHAR" if "{n}" in rule.says else "''"
        before, _, after = rule.says.partition("{n}") if "{n}" in rule.says else (rule.says, "", "")
        axes = "[" + ", ".join(map(literal_sql, rule.axes)) + "]"
        selects.append(
            f"SELECT repo, path AS file, {literal_sql(rule.id)} AS rule, {literal_sql(rule.category)} AS category, {literal_sql(rule.severity)} AS severity, "
            f"{axes} AS axes, concat({literal_sql(before)}, {number}, {literal_sql(after)}, ' in ', path, {literal_sql(rule.adds)}) AS description FROM {files} WHERE {holds}"
        )
    return " UNION ALL ".join(selects)
