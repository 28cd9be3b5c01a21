"""Frameworks of a project, from its manifests and from import lines; migration of old interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# fixed values: what a manifest at the top of a project has to hold, by manifest and framework
_PYTHON = [
    ("WebServer", ("flask", "django", "fastapi")), ("Database", ("sqlalchemy", "psycopg", "pymongo")), ("MessageQueue", ("celery", "kafka")), ("Cache", ("redis",)),
]
MANIFESTS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "Cargo.toml": [
        ("Networking", ("tokio", "async-std")), ("Concurrent", ("rayon", "crossbeam")), ("WebServer", ("actix-web", "axum", "warp =", "rocket =")),
        ("Database", ("diesel", "sqlx")), ("MessageQueue", ("rdkafka",)), ("Cache", ("redis =", "[dependencies.redis]")),
    ],
    "mix.exs": [
        ("Phoenix", (":phoenix",)), ("Ecto", (":ecto",)), ("Cowboy", (":cowboy", ":bandit")), ("WebServer", (":phoenix", ":cowboy", ":bandit")),
        ("Database", (":ecto",)), ("MessageQueue", (":broadway", ":gen_stage")), ("Cache", (":cachex", ":con_cache")),
    ],
    "rebar.config": [("Cowboy", ("cowboy",)), ("WebServer", ("cowboy",))],
    "gleam.toml": [("WebServer", ("wisp", "mist"))],
    "package.json": [
        ("WebServer", ('"express"', '"fastify"', '"koa"')), ("Database", ('"mongodb"', '"pg"', '"prisma"')), ("MessageQueue", ('"kafkajs"', '"amqplib"')), ("Cache", ('"ioredis"', '"redis"')),
    ],
    "requirements.txt": _PYTHON,
    "pyproject.toml": _PYTHON,
    "setup.py": _PYTHON,
}

# fixed values: modules whose import lines tell a framework, by language
IMPORTS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "elixir": [
        ("OTP", ("GenServer", "Supervisor", "Agent")), ("Phoenix", ("Phoenix",)), ("Ecto", ("Ecto",)), ("MessageQueue", ("Broadway", "GenStage")), ("Cache", ("Cachex", "ConCache")),
        ("WebServer", ("Plug", "Bandit")), ("Concurrent", ("Flow",)), ("Networking", ("Mint", "Finch")),
    ],
    "erlang": [("OTP", ("gen_server", "supervisor"))],
    "go": [("WebServer", ("net/http", "github.com/gin-gonic")), ("Database", ("database/sql", "github.com/jackc/pgx"))],
    "ruby": [("WebServer", ("rails", "sinatra")), ("Database", ("active_record",))],
    "python": _PYTHON,
    "javascript": [("WebServer", ("express", "fastify", "koa")), ("Database", ("mongodb", "pg")), ("MessageQueue", ("kafkajs", "amqplib")), ("Cache", ("ioredis", "redis"))],
}
IMPORTS["rescript"] = IMPORTS["javascript"]

#: How a language writes an import of one of the modules ``{m}``; both engines read these patterns alike.
_LINE = r"(^|\n)[\t\r ]*"
SHAPES = {
    "elixir": _LINE + r"(use|import|alias) ({m})", "erlang": r"-behaviour\(({m})\)", "go": r'"({m})"', "ruby": _LINE + r"""require ('({m})'|"({m})")""",
    "python": _LINE + r"(import|from) ({m})", "javascript": r"""require\('({m})'\)|require\("({m})"\)|from '({m})'|from "({m})\"""",
}
SHAPES["rescript"] = SHAPES["javascript"]


def import_pattern(language: str, modules: tuple[str, ...]) -> str:
    return SHAPES[language].replace("{m}", "|".join(m.replace(".", r"\.") for m in modules))


def evidence(files: DataFrame) -> DataFrame:
    """(repo, file, framework, kind): manifests at the top of a repository and files whose import lines tell a framework; one pass."""
    found = []
    for name, rules in MANIFESTS.items():
        here = (F.col("path") == name) | (F.col("path") == F.concat("repo", F.lit(f"/{name}")))
        found += [F.when(here & text.has_any(F.col("content"), needles), F.struct(F.lit(framework).alias("framework"), F.lit("manifest").alias("kind"))) for framework, needles in rules]
    for language, rules in IMPORTS.items():
        own = F.col("language") == language
        found += [F.when(own & F.rlike("content", F.lit(import_pattern(language, m))), F.struct(F.lit(framework).alias("framework"), F.lit("import").alias("kind"))) for framework, m in rules]
    told = F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")
    return files.select("repo", F.col("path").alias("file"), told).select("repo", "file", "f.*")


def edges(files: DataFrame, risk: Column) -> DataFrame:
    """(a, b, relation, weight) from each file to each framework of its repository; the weight is the file's risk, 1 at least."""
    of_repo = evidence(files).select("repo", "framework").distinct()
    weight = F.greatest(risk, F.lit(1)).cast("double").alias("weight")
    return files.join(F.broadcast(of_repo), "repo").select(F.col("path").alias("a"), F.col("framework").alias("b"), F.lit("framework").alias("relation"), weight)


# fixed values: old interfaces with what replaces them and their group; collections that lose their prefix; new interfaces
OLD_JS = [
    ("Js.Array2", "Array", "JsApi"), ("Js.Array.", "Array", "JsApi"), ("Js.String2", "String", "JsApi"), ("Js.String.", "String", "JsApi"), ("Js.Dict.", "Dict", "OldDict"),
    ("Js.Console.", "Console", "OldConsole"), ("Js.log", "Console.log", "OldConsole"), ("Js.log2", "Console.log2", "OldConsole"), ("Js.Promise.", "Promise", "OldPromise"),
    ("Js.Nullable.", "Nullable", "OldNullable"), ("Js.Float.", "Float", "OldNumeric"), ("Js.Int.", "Int", "OldNumeric"), ("Js.Math.", "Math", "OldNumeric"),
    ("Js.Json.", "JSON", "OldJson"), ("Js.Re.", "RegExp", "OldRegExp"), ("Js.Date.", "Date (no core replacement yet)", "OldDate"),
]
OLD_BELT = (
    "Belt.Array", "Belt.List", "Belt.Map", "Belt.Set", "Belt.Option", "Belt.Result", "Belt.Int", "Belt.Float", "Belt.SortArray", "Belt.HashMap", "Belt.HashSet",
    "Belt.MutableMap", "Belt.MutableSet", "Belt.MutableQueue", "Belt.MutableStack", "Belt.Range",
)
OLD_STYLES = [(("Js.Json.classify",), "JSON.Classify.classify", "OldJson"), (("ReactDOMStyle.make", "ReactDOM.Style.make"), "inline record style={{...}}", "OldReactStyle")]
NEW = (
    "Array.", "String.", "Dict.", "Console.", "Promise.", "Nullable.", "Float.", "Int.", "Math.", "JSON.", "RegExp.", "Map.", "Set.", "Option.", "Result.",
    "Error.", "Iterator.", "AsyncIterator.", "BigInt.",
)

#: (needles, replacement, group) of all old interfaces.
OLD = [((p,), r, g) for p, r, g in OLD_JS] + [((p,), p.removeprefix("Belt."), "BeltApi") for p in OLD_BELT] + OLD_STYLES


def old_interfaces(files: DataFrame) -> DataFrame:
    """(repo, file, pattern, replacement, category, n) of the old interfaces that files use."""
    hits = [F.struct(F.lit(" / ".join(p)).alias("pattern"), F.lit(r).alias("replacement"), F.lit(g).alias("category"), text.literal_sum(F.col("content"), p).alias("n")) for p, r, g in OLD]
    found = F.explode(F.filter(F.array(*hits), lambda h: h["n"] > 0)).alias("h")
    return files.select("repo", F.col("path").alias("file"), found).select("repo", "file", "h.*")


def migration(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(repo, old, new, ratio, health, bracket) of each repository; ``configs`` (repo, name, content) has its configuration files, if any.

    Half of the health is the share of new interfaces; the rest comes from the
    configuration's name, its JSX version and whether it is uncurried.
    """
    old, new = [n for p, _, _ in OLD for n in p], list(NEW)
    sums = files.groupBy("repo").agg(F.sum(text.literal_sum(F.col("content"), old)).alias("old"), F.sum(text.literal_sum(F.col("content"), new)).alias("new"))
    has = lambda name: F.bool_or(F.col("name") == name)
    # a repository has at most one file of each name; the newer name is read
    config = configs.groupBy("repo").agg(has("bsconfig.json").alias("before"), has("rescript.json").alias("after"), F.max_by("content", "name").alias("config"))
    joined = sums.join(config, "repo", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("before", "after")})
    total = F.col("old") + F.col("new")
    ratio = F.when(total > 0, F.col("new") / total).otherwise(1.0)
    seen = F.when(total > 0, F.col("new") / total).otherwise(0.5)
    holds = lambda *needles: F.coalesce(text.has_any(F.col("config"), needles), F.lit(False))
    by_name = F.when(F.col("before") & F.col("after"), 0.5).when(F.col("after"), 1.0).when(F.col("before"), 0.0).otherwise(0.5)
    jsx = F.when(holds('"version": 4', '"version":4'), 1.0).when(holds('"version": 3', '"version":3'), 0.3).otherwise(0.5)
    uncurried = F.when(holds('"uncurried"'), 1.0).otherwise(0.3)
    health = F.round((ratio * 0.5 + by_name * 0.2 + jsx * 0.15 + uncurried * 0.15) * 100) / 100
    bracket = (
        F.when(holds('"uncurried"') & holds('"v13'), "V13PreRelease")
        .when(F.col("before") & F.col("after"), "V12Alpha")
        .when(F.col("before"), F.when(seen < 0.1, "BuckleScript").otherwise("V11"))
        .when(F.col("after"), F.when(seen > 0.8, "V12Current").otherwise("V12Stable"))
        .otherwise(F.when(seen > 0.5, "V12Current").otherwise("V11"))
    )
    return joined.select("repo", "old", "new", F.round(ratio, 6).alias("ratio"), health.alias("health"), bracket.alias("bracket"))
