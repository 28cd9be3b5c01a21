"""Queries over source projects: frameworks, dependency graph, migration. Projects are literal rows beside all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dims, text
from tessera.operators import findings as FD
from tessera.operators import frameworks, logic, scoring
from tessera.plans.common import BASE, found
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import FILES_SQL

PROJECTS = [
    ("shop", "Cargo.toml", "[dependencies]\ntokio = \"1\"\nsqlx = \"0.8\"\nredis = \"0.2\""), ("shop", "src/main.rs", "fn main() { std::thread::spawn(f); }"), ("shop", "src/api.rs", "use axum::Router;"),
    ("chat", "mix.exs", "{:phoenix, \"~> 1.7\"}, {:ecto, \"~> 3\"}, {:broadway, \"~> 1\"}"), ("chat", "lib/room.ex", "defmodule Room do\n  use GenServer\n  spawn(f)\nend"), ("chat", "lib/feed.ex", "  alias Cachex.Spec"),
    ("chat", "lib/not.ex", "# we use GenServer here"), ("grid", "rebar.config", "{deps, [cowboy]}."), ("grid", "src/grid.erl", "-behaviour(gen_server)."), ("leaf", "gleam.toml", "wisp = \"1\""),
    ("desk", "package.json", "{\"express\": \"4\", \"ioredis\": \"5\", \"kafkajs\": \"2\", \"pg\": \"8\"}"), ("desk", "a/b.ts", "import x from 'koa'"), ("desk", "a/c.js", "const y = require(\"redis\")"), ("desk", "a/d.js", "from 'express/lib'"),
    ("lab", "requirements.txt", "flask==3\ncelery"), ("lab", "sub/requirements.txt", "redis"), ("lab", "x.py", "import os\n  from sqlalchemy import x"), ("lab", "y.py", "# from redis"),
    ("port", "m.go", "import (\n\t\"net/http\"\n)"), ("port", "n.go", "import \"net/http/httptest\""), ("rail", "a.rb", "require 'sinatra'\nrequire \"active_record\""),
    ("res1", "src/a.res", "Js.log2(x); Js.log(y); Belt.Array.map(z, f); Array.map(q, g); Js.Json.classify(j)"), ("res1", "src/b.res", "ReactDOM.Style.make() Console.log(1) Option.map(x, f)"),
    ("res2", "src/a.resi", "Dict.get(d, k) JSON.parse(s) Array.length(a) String.trim(t) Map.size(m)"), ("res3", "src/a.res", "let x = 1"),
]
CONFIGS = [("res1", "bsconfig.json", "{\"reason\": {\"react-jsx\": 3}, \"jsx\": {\"version\": 3}}"), ("res2", "rescript.json", "{\"jsx\": {\"version\": 4}, \"uncurried\": true}")]
_PROJECTS_SQL = f"""
projects AS (
  SELECT p.*, coalesce(language, 'unknown') AS language
  FROM (SELECT *, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM {dims.values_sql('repo, path, content', PROJECTS)}) p LEFT JOIN languages USING (ext)
),
sources AS (SELECT repo, path, content, language FROM projects UNION ALL SELECT repo, path, content, language FROM files)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content, language) of the projects and of every document."""
    projects = bindings.with_language(dims.values(spark, "repo, path, content", PROJECTS)).select("repo", "path", "content", "language")
    return projects.union(bindings.files(spark, sf_dir).select("repo", "path", "content", "language"))


def _evidence_sql(files: str = "sources") -> str:
    parts = []
    for name, rules in frameworks.MANIFESTS.items():
        for framework, needles in rules:
            holds = " OR ".join(f"contains(content, {dims.literal_sql(n)})" for n in needles)
            parts.append(f"SELECT repo, path AS file, '{framework}' AS framework, 'manifest' AS kind FROM {files} WHERE path IN ('{name}', repo || '/{name}') AND ({holds})")
    for language, rules in frameworks.IMPORTS.items():
        for framework, modules in rules:
            pattern = dims.literal_sql(frameworks.import_pattern(language, modules))
            parts.append(f"SELECT repo, path, '{framework}', 'import' FROM {files} WHERE language = '{language}' AND regexp_matches(content, {pattern})")
    return "evidence AS (" + " UNION ALL ".join(parts) + ")"


@register(f"WITH {FILES_SQL}, {_PROJECTS_SQL}, {_evidence_sql()} SELECT repo, file, framework, kind FROM evidence")
def src22_st08_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.evidence(sources(spark, sf_dir))


@register(f"WITH {FILES_SQL}, {_PROJECTS_SQL}, {_evidence_sql()} SELECT repo, array_to_string(list_sort(list(DISTINCT framework)), ',') AS frameworks FROM evidence GROUP BY repo")
def fd82_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = frameworks.evidence(sources(spark, sf_dir)).groupBy("repo")
    return told.agg(F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))


_PACK = {"*": {"threading_constructs": ("spawn(", " | "), "unsafe_blocks": ("!!",), "panic_sites": ("###",), "unwrap_calls": (".unwrap()",)}}
_GRAPH_SQL = f"""{FILES_SQL}, {_PROJECTS_SQL}, {_evidence_sql()}, counted AS (SELECT *, {FD.count_constructs_sql(_PACK)} FROM sources),
framework_edges AS (
  SELECT path AS a, framework AS b, 'framework' AS relation, greatest(3 * unsafe_blocks + 2 * panic_sites + unwrap_calls + 2 * threading_constructs, 1)::DOUBLE AS weight
  FROM counted JOIN (SELECT DISTINCT repo, framework FROM evidence) USING (repo)
)"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.count_constructs(sources(spark, sf_dir), _PACK)


@register(f"WITH {_GRAPH_SQL} SELECT * FROM framework_edges")
def jn17_framework_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.edges(_counted(spark, sf_dir), scoring.simple_risk())


@register(
    f"""WITH {_GRAPH_SQL}, dirs AS (SELECT repo, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM sources)
    SELECT * FROM framework_edges UNION ALL
    SELECT path, lead(path) OVER (PARTITION BY repo, dir ORDER BY path), 'shared_dir:' || dir, 1.0::DOUBLE FROM dirs QUALIFY lead(path) OVER (PARTITION BY repo, dir ORDER BY path) IS NOT NULL"""
)
def fd83_dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framework edges and the chains of files of a folder, of each repository."""
    files = _counted(spark, sf_dir)
    placed = files.select("repo", F.col("path").alias("a"), text.directory(F.col("path")).alias("dir"))
    chain = placed.withColumn("b", F.lead("a").over(Window.partitionBy("repo", "dir").orderBy("a"))).where(F.col("b").isNotNull())
    chain = chain.select("a", "b", F.concat(F.lit("shared_dir:"), "dir").alias("relation"), F.lit(1.0).alias("weight"))
    return frameworks.edges(files, scoring.simple_risk()).union(chain)


_OLD_ROWS = [(" / ".join(p), r, g) for p, r, g in frameworks.OLD]
_OLD_SQL = "old AS (" + " UNION ALL ".join(
    f"SELECT repo, path AS file, {dims.literal_sql(' / '.join(p))} AS pattern, {dims.literal_sql(r)} AS replacement, '{g}' AS category, {FD.count_sql(p)} AS n FROM sources" for p, r, g in frameworks.OLD
) + ")"


@register(f"WITH {FILES_SQL}, {_PROJECTS_SQL}, {_OLD_SQL} SELECT * FROM old WHERE n > 0")
def fd84_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.old_interfaces(sources(spark, sf_dir))


@register(f"WITH {FILES_SQL}, {_PROJECTS_SQL}, {_OLD_SQL} SELECT category, sum(n)::BIGINT AS n FROM old WHERE n > 0 GROUP BY category")
def ag25_old_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frameworks.old_interfaces(sources(spark, sf_dir)).groupBy("category").agg(F.sum("n").alias("n"))


@register(
    f"""WITH {FILES_SQL}, {_PROJECTS_SQL}, s AS (SELECT repo, sum({FD.count_sql([n for p, _, _ in frameworks.OLD for n in p])})::BIGINT AS old, sum({FD.count_sql(frameworks.NEW)})::BIGINT AS new FROM sources GROUP BY repo),
    c AS (SELECT repo, bool_or(name = 'bsconfig.json') AS before, bool_or(name = 'rescript.json') AS after, max_by(content, name) AS config FROM {dims.values_sql('repo, name, content', CONFIGS)} GROUP BY repo),
    j AS (SELECT repo, old, new, coalesce(before, false) AS before, coalesce(after, false) AS after, coalesce(config, '') AS config,
      CASE WHEN old + new > 0 THEN new / (old + new) ELSE 1.0::DOUBLE END AS ratio, CASE WHEN old + new > 0 THEN new / (old + new) ELSE 0.5::DOUBLE END AS seen FROM s LEFT JOIN c USING (repo)),
    h AS (SELECT *, ratio * 0.5::DOUBLE + CASE WHEN before AND after THEN 0.5::DOUBLE WHEN after THEN 1.0::DOUBLE WHEN before THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE
      + CASE WHEN contains(config, '"version": 4') OR contains(config, '"version":4') THEN 1.0::DOUBLE WHEN contains(config, '"version": 3') OR contains(config, '"version":3') THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END * 0.15::DOUBLE
      + CASE WHEN contains(config, '"uncurried"') THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * 0.15::DOUBLE AS score FROM j)
    SELECT repo, old, new, round(ratio, 6) AS ratio, round(score * 100) / 100 AS health,
      CASE WHEN contains(config, '"uncurried"') AND contains(config, '"v13') THEN 'V13PreRelease' WHEN before AND after THEN 'V12Alpha' WHEN before THEN CASE WHEN seen < 0.1 THEN 'BuckleScript' ELSE 'V11' END
      WHEN after THEN CASE WHEN seen > 0.8 THEN 'V12Current' ELSE 'V12Stable' END WHEN seen > 0.5 THEN 'V12Current' ELSE 'V11' END AS bracket FROM h"""
)
def ag24_js03_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of new interfaces, health and version bracket of every repository, from its files and configuration."""
    return frameworks.migration(sources(spark, sf_dir), dims.values(spark, "repo, name, content", CONFIGS))


@register(BASE + "SELECT DISTINCT CASE severity WHEN 'Critical' THEN 'critical_vuln' ELSE 'high_vuln' END AS relation, category, file FROM findings WHERE severity IN ('Critical', 'High')")
def lg07_lg08_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard rules over the facts of findings: constants select the severity."""
    weak = found(spark, sf_dir).select(F.col("category").alias("a0"), F.col("file").alias("a1"), F.col("severity").alias("a2"))
    derived = logic.forward_chain({"weak_point": weak}, logic.SEVERITY_RULES)
    parts = [derived[n].select(F.lit(n).alias("relation"), F.col("a0").alias("category"), F.col("a1").alias("file")) for n in ("critical_vuln", "high_vuln") if n in derived]
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
