"""Readers: source trees, reports, rule packs, timelines and S-expression bundles."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators.findings import Rule, Test
from tessera.sources.bindings import with_language

# fixed values: folders that a scan leaves out
SKIPPED = (
    "target", "build", "node_modules", ".git", "vendor", "_build", "_opam", ".stack-work", "dist-newstyle", "deps", "_deps", "zig-cache", ".zig-cache", "zig-out",
    ".elixir_ls", ".lexical", "__pycache__", "ebin", "_checkouts", ".fetch", ".hex", ".nimble", ".dub", "obj", "runtime",
)

# fixed values: what bytes 0x80 to 0x9F stand for in windows-1252
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_LATIN1 = "".join(map(chr, range(0x80, 0xA0)))

WEAK_POINT = T.StructType(
    [*[T.StructField(c, T.StringType()) for c in ("category", "location", "file")], T.StructField("line", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("severity", "description")],
     T.StructField("recommended_attack", T.ArrayType(T.StringType()))]
)
REPORT = T.StructType([T.StructField("program_path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("weak_points", T.ArrayType(WEAK_POINT))])
ATTACK = T.StructType([T.StructField("program", T.StringType()), T.StructField("axis", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("skipped", T.BooleanType())])


def decoded(content: Column) -> Column:
    """UTF-8, or windows-1252 where the bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _LATIN1, _CP1252))


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, lines, ext, language, family) of the files of known languages under ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = raw.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED])))
    known = with_language(inside.select("path", "content")).where("language <> 'unknown'")
    return known.withColumn("content", decoded(F.col("content"))).withColumn("lines", text.line_count(F.col("content")))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports with the whole schema, so that absent fields are null; (path, weak_points...)."""
    found = spark.read.schema(REPORT).option("multiLine", "true").json(path)
    return found.withColumn("weak_points", F.coalesce("weak_points", F.array().cast(T.ArrayType(WEAK_POINT))))


def latest(listing: DataFrame, n: int) -> DataFrame:
    """The last ``n`` JSON files of a listing (path) by name; fewer are an error."""
    found = listing.where(F.endswith("path", F.lit(".json"))).orderBy(F.desc("path")).limit(n)
    if found.count() < n:
        raise ValueError(f"fewer than {n} reports")
    return found


def attack_results(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Results from a bare array or from ``{"attack_results": [...]}``."""
    bare = F.from_json(column, T.ArrayType(ATTACK))
    wrapped = F.from_json(column, T.StructType([T.StructField("attack_results", T.ArrayType(ATTACK))]))["attack_results"]
    return raw.select(F.explode(F.when(F.startswith(F.ltrim(column), F.lit("[")), bare).otherwise(wrapped)).alias("r")).select("r.program", "r.axis", *[F.coalesce(f"r.{c}", F.lit(False)).alias(c) for c in ("success", "skipped")])


def report_kind(column: str = "raw") -> Column:
    """Which of the report kinds a JSON text is, by the field that only this kind has."""
    has = lambda key: F.get_json_object(column, f"$.{key}").isNotNull()
    return F.when(has("attack_results"), "assault").when(has("outcomes"), "amuck").when(has("selected_files"), "abduct")


TRACKS = "array<struct<axis:string,events:array<struct<id:string,at:string,for:string,intensity:string>>>>"


def timeline(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(program, axis, id, start_ms, duration_ms, intensity): events of JSON timelines, numbered where unnamed."""
    spec = raw.select(F.from_json(column, f"struct<program:string,duration:string,tracks:{TRACKS}>").alias("t"))
    tracks = spec.select("t.program", F.posexplode("t.tracks").alias("track", "own"))
    events = tracks.select("program", "track", "own.axis", F.posexplode("own.events").alias("k", "e"))
    name = F.coalesce("e.id", F.concat("axis", F.lit("-"), (F.col("k") + 1).cast("string")))
    return events.select("program", "axis", name.alias("id"), text.duration_ms(F.col("e.at")).alias("start_ms"), text.duration_ms(F.col("e.for")).alias("duration_ms"), "e.intensity")


def rule_pack(path: str) -> list[Rule]:
    """Rules of a JSON file: a list of objects with the fields of Rule; ``test`` has those of Test."""
    with open(path) as f:
        return [Rule(**{**r, "languages": tuple(r.get("languages", ())), "axes": tuple(r.get("axes", ())), "test": Test(**{k: tuple(v) if isinstance(v, list) else v for k, v in r["test"].items()})}) for r in json.load(f)]


_TOKEN = re.compile(r'"((?:\\.|[^"\\])*)"|([()])|([^\s()"]+)')


def parse_bundle(raw: str) -> list:
    """An S-expression bundle as nested lists of strings."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(raw):
        if m[2] == "(":
            stack.append([])
        elif m[2] == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced bundle")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[3])
    if len(stack) != 1:
        raise ValueError("unbalanced bundle")
    return stack[0]
