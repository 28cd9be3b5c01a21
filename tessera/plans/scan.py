"""Queries: files, counters, findings, scores and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dims, text
from tessera.operators import findings as FD
from tessera.operators import scoring
from tessera.operators.packs import CODE_COUNTERS, CODE_RULES, HTTP, LOCAL
from tessera.operators.rust_strings import strip_sql
from tessera.plans.common import BASE, counted, found, scored
from tessera.plans.registry import register
from tessera.sources import bindings, sinks
from tessera.sources.bindings import FILES_SQL

_ROUNDED = ("risk", "density", "health")


@register(BASE + "SELECT repo, total_files, total_lines, weak_points, critical, high, round(risk, 6) AS risk, round(density, 6) AS density, round(health, 6) AS health, bucket FROM scored")
def q_repo_risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "repo", "total_files", "total_lines", "weak_points", "critical", "high", *[F.round(c, 6).alias(c) for c in _ROUNDED], "bucket"
    ).orderBy(F.desc("weak_points"), "repo")


@register(f"WITH {FILES_SQL} SELECT ext, language, family, count(*) AS files, sum(lines)::BIGINT AS lines FROM files GROUP BY ALL")
def prj01_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.files(spark, sf_dir).groupBy("ext", "language", "family").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


_PATHS = [(p,) for p in ("a/b.ts", "b.resi", "lib/c.P", "c.p", "d.xyz", ".bashrc", "Makefile", "x.tar.gz", "dir.d/readme", "m.scrbl", "n.hxx", "o.duet")]


@register(
    f"""WITH languages AS (SELECT * FROM {dims.values_sql('ext, language, family', dims.language_rows())}),
    paths AS (SELECT path, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM {dims.values_sql('path', _PATHS)})
    SELECT path, ext, coalesce(language, 'unknown') AS language, coalesce(family, 'unknown') AS family FROM paths LEFT JOIN languages USING (ext)"""
)
def prj02_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.with_language(dims.values(spark, "path", _PATHS)).select("path", "ext", "language", "family")


@register(
    f"""WITH {FILES_SQL}, counts AS (SELECT repo, language, count(*) AS n FROM files GROUP BY ALL)
    SELECT repo, arg_min(language, (-n, language)) AS language, max(n) AS n FROM counts GROUP BY repo"""
)
def src04_main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bindings.files(spark, sf_dir).groupBy("repo", "language").agg(F.count("*").alias("n"))
    return counts.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("m"), "language")).alias("s")).select("repo", "s.language", (-F.col("s.m")).alias("n"))


@register(BASE + f"SELECT path, language, lines, {', '.join(FD.COUNTERS)} FROM counted WHERE greatest({', '.join(FD.COUNTERS)}) > 0")
def fd80_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).where(F.greatest(*FD.COUNTERS) > 0).select("path", "language", "lines", *FD.COUNTERS)


@register(BASE + "SELECT repo, file, rule, category, severity, array_to_string(axes, '/') AS axes, description FROM findings")
def fd01_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).withColumn("axes", F.array_join("axes", "/"))


# snippets of code, one or more for each family of rules
SNIPPETS = [
    ("r", "src/a.rs", "unsafe { *p }\nlet x = y.unwrap();\nstd::mem::forget(x); let q = r as *const u8; transmute(z)"),
    ("r", "src/b.rs", ".unwrap().unwrap().unwrap().unwrap().unwrap().expect(1)"),
    ("r", "c/test.c", "int* ptr = malloc(100);\ngets(buf); system(cmd); sprintf(a, b); strcpy(c, d);"),
    ("r", "g/test.go", "go func() {}()\ngo processData()\ngo handleRequest()\nexec.Command(1); unsafe.Pointer(x)"),
    ("r", "p/test.py", "while True:\n    eval(x)\npickle.loads(data)\nsubprocess.call(cmd, shell=True)\nos.system(1)"),
    ("r", "j/a.js", "el.innerHTML = x; eval(y); JSON.parseExn(z); fetch(u)"),
    ("r", "j/b.tsx", "<div dangerouslySetInnerHTML={x}/> deno run -A"),
    ("r", "e/a.ex", "String.to_atom(x)\nSystem.cmd(y)\napply(m, f, a)\nspawn(z)\nCode.eval_string(q)"),
    ("r", "e/b.erl", "list_to_atom(X), os:cmd(Y), file:read(Z)"),
    ("r", "m/a.ml", "Obj.magic x; Obj.repr y; Marshal.from_string z; Unix.system q"),
    ("r", "l/a.scm", "(eval x) (system y) call/cc call/cc call/cc call/cc"),
    ("r", "h/a.hs", "unsafePerformIO x unsafeCoerce y fromJust z (head q) (tail r) head s error \"no\""),
    ("r", "i/a.idr", "believe_me x %foreign y"), ("r", "i/b.lean", "sorry native_decide"), ("r", "i/c.agda", "trustMe"),
    ("r", "o/a.pl", "assert(a), retract(b), assertz(c), asserta(d), assert(e), shell(f)"),
    ("r", "z/a.zig", "@ptrCast(x) unreachable"), ("r", "z/b.adb", "Unchecked_Conversion pragma Suppress"), ("r", "z/c.odin", "rawptr"), ("r", "z/d.nim", "cast[int](x) {.emit: y.}"),
    ("r", "s/a.sh", "eval $x\nchmod 777 f\ncat /tmp/f\ncurl http://example.com"), ("r", "s/b.sh", "f=$(mktemp /tmp/x)"), ("r", "s/c.nix", "builtins.exec [ 1 ]"),
    ("r", "u/a.jl", "Meta.parse(x) ccall(y)"), ("r", "u/b.lua", "loadstring(x) os.execute(y)"), ("r", "u/c.rb", "eval(x) Thread.new"), ("r", "u/d.java", "Runtime.getRuntime().exec(x)"),
    ("r", "w/a.woke", "foreign external @ffi @native"), ("r", "w/b.txt", "TODO TODO TODO TODO FIXME FIXME FIXME HACK HACK XXX XXX"),
    ("r", "w/c.txt", "password = \"hunter2hunter2\""), ("r", "w/d.txt", ""),
]


@register(
    f"""WITH languages AS (SELECT * FROM {dims.values_sql('ext, language, family', dims.language_rows())}),
    raw AS (SELECT *, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM {dims.values_sql('repo, path, content', SNIPPETS)}),
    plain AS (SELECT raw.*, coalesce(language, 'unknown') AS language FROM raw LEFT JOIN languages USING (ext)),
    files AS (SELECT *, CASE WHEN language = 'rust' THEN {strip_sql('content')} END AS code FROM plain),
    counted AS (SELECT *, {FD.count_constructs_sql(CODE_COUNTERS)} FROM files),
    found AS ({FD.find_sql(CODE_RULES)})
    SELECT file, rule, category, severity, array_to_string(axes, '/') AS axes, description FROM found"""
)
def fd79_code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = FD.count_constructs(FD.with_code(bindings.with_language(dims.values(spark, "repo, path, content", SNIPPETS))), CODE_COUNTERS)
    return FD.find(files, CODE_RULES).select("file", "rule", "category", "severity", F.array_join("axes", "/").alias("axes"), "description")


_RULE_ROWS = [(r.id, r.category, r.severity, "/".join(r.axes)) for r in CODE_RULES]


@register(
    f"""WITH {FILES_SQL}, stripped AS (SELECT *, CASE WHEN language = 'rust' THEN {strip_sql('content')} END AS code FROM files),
    counted AS (SELECT *, {FD.count_constructs_sql(CODE_COUNTERS)} FROM stripped), found AS ({FD.find_sql(CODE_RULES)}),
    rules AS (SELECT * FROM {dims.values_sql('rule, category, severity, axes', _RULE_ROWS)})
    SELECT file, rule, category, severity, array_to_string(axes, '/') AS axes, description FROM found
    UNION ALL SELECT NULL, rule, category, severity, axes, NULL FROM rules WHERE rule NOT IN (SELECT rule FROM found)"""
)
def fd79_document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules W01 to W79 over every document, in the language of its path; a rule that none breaks has one row without a file."""
    files = FD.count_constructs(FD.with_code(bindings.files(spark, sf_dir)), CODE_COUNTERS)
    broken = FD.find(files, CODE_RULES).select("file", "rule", "category", "severity", F.array_join("axes", "/").alias("axes"), "description")
    rules = dims.values(spark, "rule, category, severity, axes", _RULE_ROWS)
    kept = rules.join(broken.select("rule").distinct(), "rule", "left_anti")
    none = F.lit(None).cast("string")
    return broken.unionByName(kept.withColumns({"file": none, "description": none}))


@register(
    f"""WITH n AS (SELECT page_id, greatest(len(regexp_extract_all(url, '{HTTP}')) - len(regexp_extract_all(url, '{LOCAL}')), 0)::BIGINT AS in_url,
    greatest(len(regexp_extract_all(html, '{HTTP}')) - len(regexp_extract_all(html, '{LOCAL}')), 0)::BIGINT AS in_page FROM pages)
    SELECT page_id, in_url, in_page, (in_url + in_page) || ' HTTP (non-HTTPS) URLs' AS says FROM n WHERE in_url + in_page > 0"""
)
def fd81_insecure_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain addresses that aren't local, in the address and in the body of each page."""
    plain = lambda c: F.greatest(F.regexp_count(c, F.lit(HTTP)) - F.regexp_count(c, F.lit(LOCAL)), F.lit(0)).cast("long")
    pages = bindings.table(spark, sf_dir, "pages").select("page_id", plain("url").alias("in_url"), plain("html").alias("in_page"))
    total = F.col("in_url") + F.col("in_page")
    return pages.where(total > 0).select("*", F.concat(total.cast("string"), F.lit(" HTTP (non-HTTPS) URLs")).alias("says"))


@register(BASE + "SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*FD.COUNTERS, "lines")) + " FROM counted")
def ag01_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in (*FD.COUNTERS, "lines")])


@register(BASE + "SELECT repo, weak_points, critical, high, total_files, total_lines FROM repos")
def ag02_repo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = counted(spark, sf_dir)
    return scoring.repo_results(files, found(spark, sf_dir))


@register(BASE + "SELECT count(*) AS repos, count(*) FILTER (weak_points > 0) AS with_findings, sum(weak_points)::BIGINT AS weak_points, sum(critical)::BIGINT AS critical FROM repos WHERE weak_points >= 10")
def ag03_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scoring.repo_results(counted(spark, sf_dir), found(spark, sf_dir)).where("weak_points >= 10")
    return kept.agg(F.count("*").alias("repos"), F.count_if(F.col("weak_points") > 0).alias("with_findings"), F.sum("weak_points").alias("weak_points"), F.sum("critical").alias("critical"))


_CELLS = "cells AS (SELECT category, value, file, unnest(axes) AS axis FROM findings JOIN severities USING (severity))"


@register(BASE + f", {_CELLS} SELECT category, axis, max(value) AS severity_value, count(*) AS findings, count(DISTINCT file) AS files FROM cells GROUP BY ALL")
def ag04_taint_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.taint_matrix(found(spark, sf_dir))


@register(BASE + f", {_CELLS} SELECT category, axis, sum(value) AS total, row_number() OVER (ORDER BY sum(value) DESC, category, axis) AS place FROM cells GROUP BY category, axis QUALIFY place <= 4")
def ag05_so05_pivot_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pivot(found(spark, sf_dir)).where("place <= 4")


@register(
    BASE
    + """, counts AS (SELECT repo, category, count(*) AS n FROM findings GROUP BY ALL)
    SELECT repo, string_agg(category || '=' || n, ',' ORDER BY n DESC, category) AS top FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, category) AS k FROM counts) WHERE k <= 3 GROUP BY repo"""
)
def ag06_so07_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.slice("categories", F.lit(1), F.lit(3))
    joined = F.array_join(F.transform(top, lambda c: F.concat(c["category"], F.lit("="), c["count"].cast("string"))), ",")
    return scoring.category_breakdown(found(spark, sf_dir)).select("repo", joined.alias("top"))


@register(BASE + "SELECT severity, count(*) AS n, min(rank) AS rank FROM findings JOIN severities USING (severity) GROUP BY severity")
def ag07_severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_values(found(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))


@register(BASE + "SELECT count(DISTINCT family) AS families FROM files WHERE family <> 'unknown'")
def ag12_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.files(spark, sf_dir).where("family <> 'unknown'").agg(F.count_distinct("family").alias("families"))


@register(BASE + "SELECT repo, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM findings GROUP BY repo")
def ag13_category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@register(
    BASE
    + """, sums AS (SELECT repo, sum(allocation_sites) AS a, sum(io_operations) AS i, sum(threading_constructs) AS t FROM counted GROUP BY repo),
    axes AS (SELECT repo, unnest(axes) AS axis FROM findings UNION SELECT repo, 'cpu' FROM sums UNION SELECT repo, 'memory' FROM sums WHERE a > 10
      UNION SELECT repo, 'disk' FROM sums WHERE i > 5 UNION SELECT repo, 'concurrency' FROM sums WHERE t > 3)
    SELECT repo, array_to_string(list_sort(list(DISTINCT axis)), ',') AS axes FROM axes GROUP BY repo"""
)
def ag14_recommended_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = counted(spark, sf_dir)
    return scoring.recommended_axes(found(spark, sf_dir), files).withColumn("axes", F.array_join("axes", ","))


@register(BASE + "SELECT file, bool_and(contains(lower(description), 'secret')) AS all_secret, count(DISTINCT category) AS categories FROM findings GROUP BY file")
def ag15_ag16_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("file").agg(F.bool_and(F.contains(F.lower("description"), F.lit("secret"))).alias("all_secret"), F.count_distinct("category").alias("categories"))


@register(
    BASE
    + """, c AS (SELECT repo, sum(unsafe_blocks) AS unsafe, sum(unwrap_calls) AS unwraps, sum(panic_sites) AS crashes FROM counted GROUP BY repo)
    SELECT repo, greatest(0.0, least(100.0, 100.0 - 10.0 * crashes - 20.0 * critical - 5.0 * unsafe))::DOUBLE AS robustness,
      concat_ws(',', CASE WHEN unwraps > 10 THEN 'unwrap' END, CASE WHEN unsafe > 0 THEN 'unsafe' END) AS advice
    FROM repos JOIN c USING (repo)"""
)
def ag21_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 less 10 a crash, 20 a critical finding and 5 an unsafe block, from 0 to 100; panic sites stand for crashes."""
    files = counted(spark, sf_dir)
    sums = files.groupBy("repo").agg(F.sum("unsafe_blocks").alias("unsafe"), F.sum("unwrap_calls").alias("unwraps"), F.sum("panic_sites").alias("crashes"))
    repos = scoring.repo_results(files, found(spark, sf_dir)).join(sums, "repo")
    advice = F.filter(F.array(F.when(F.col("unwraps") > 10, "unwrap"), F.when(F.col("unsafe") > 0, "unsafe")), lambda a: a.isNotNull())
    score = scoring.robustness(F.col("crashes"), F.col("critical"), F.col("unsafe"))
    return repos.select("repo", score.alias("robustness"), F.array_join(advice, ",").alias("advice"))


_SCORE = " + ".join(f"{c} * {w}::DOUBLE" for c, w in scoring.FILE_WEIGHTS.items())


@register(
    BASE
    + f"""SELECT path, round(CASE WHEN lines > 500 THEN 0.5::DOUBLE * least(lines / 500.0::DOUBLE, 5.0) ELSE 0 END + {_SCORE}, 6) AS score,
    (3 * unsafe_blocks + 2 * panic_sites + unwrap_calls + 2 * threading_constructs)::BIGINT AS simple FROM counted"""
)
def ma03_ma04_file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).select("path", F.round(scoring.file_score(), 6).alias("score"), scoring.simple_risk().alias("simple"))


@register(
    BASE
    + """, r AS (SELECT path, (3 * unsafe_blocks + 2 * panic_sites + unwrap_calls + 2 * threading_constructs)::BIGINT AS risk FROM counted)
    SELECT path, risk, row_number() OVER (ORDER BY risk DESC, path) AS place FROM r QUALIFY place <= 5"""
)
def so04_wn02_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the five riskiest files: top-k is the feature, taken without sorting the rest."""
    top = counted(spark, sf_dir).select("path", scoring.simple_risk().alias("risk")).orderBy(F.desc("risk"), "path").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("risk"), "path")))


def strategy_order(files: DataFrame, strategy: str) -> list:
    """Sort columns of a search strategy over files (risk, family, lines)."""
    return {
        "risk_weighted": [F.desc("risk"), "path"],
        "boundary_first": [F.desc("risk"), "path"],
        "language_family": ["family", F.desc("risk"), "path"],
        "breadth_first": ["lines", "path"],
        "depth_first": [F.desc("lines"), "path"],
    }[strategy]


_STRATEGIES = ("risk_weighted", "language_family", "breadth_first", "depth_first")


@register(
    BASE
    + """, r AS (SELECT repo, path, family, lines, (3 * unsafe_blocks + 2 * panic_sites + unwrap_calls + 2 * threading_constructs)::BIGINT AS risk FROM counted)
    SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY risk DESC, path) AS risk_weighted,
      row_number() OVER (PARTITION BY repo ORDER BY family, risk DESC, path) AS language_family,
      row_number() OVER (PARTITION BY repo ORDER BY lines, path) AS breadth_first, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, path) AS depth_first FROM r"""
)
def so02_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = counted(spark, sf_dir).withColumn("risk", scoring.simple_risk())
    places = [F.row_number().over(Window.partitionBy("repo").orderBy(*strategy_order(files, s))).alias(s) for s in _STRATEGIES]
    return files.select("repo", "path", *places)


@register(
    BASE
    + """, s AS (SELECT (SELECT count(DISTINCT family) FROM files WHERE family <> 'unknown') AS families, (SELECT count(*) FROM files) AS n,
      (SELECT bool_or(severity IN ('Critical', 'High')) FROM findings) AS risky)
    SELECT CASE WHEN families > 1 AND risky THEN 'boundary_first' WHEN risky THEN 'risk_weighted' WHEN n > 100 THEN 'breadth_first' WHEN families > 1 THEN 'language_family' ELSE 'depth_first' END AS strategy FROM s"""
)
def so03_ag17_auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_files = bindings.files(spark, sf_dir).agg(F.count_distinct(F.when(F.col("family") != "unknown", F.col("family"))).alias("families"), F.count("*").alias("n"))
    risky = found(spark, sf_dir).agg(F.coalesce(F.bool_or(F.col("severity").isin("Critical", "High")), F.lit(False)).alias("risky"))
    several = F.col("families") > 1
    chain = F.when(several & F.col("risky"), "boundary_first").when(F.col("risky"), "risk_weighted").when(F.col("n") > 100, "breadth_first")
    return of_files.crossJoin(risky).select(chain.when(several, "language_family").otherwise("depth_first").alias("strategy"))


@register(BASE + "SELECT repo, weak_points, row_number() OVER (ORDER BY weak_points DESC, repo) AS place FROM repos WHERE weak_points >= 5")
def so01_flt01_ranked_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = scoring.repo_results(counted(spark, sf_dir), found(spark, sf_dir)).where("weak_points >= 5")
    return repos.select("repo", "weak_points", F.row_number().over(Window.orderBy(F.desc("weak_points"), "repo")).alias("place"))


@register(
    BASE
    + """, dirs AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM counted)
    SELECT path AS a, lead(path) OVER (PARTITION BY dir ORDER BY path) AS b, 'shared_dir:' || dir AS relation, 1.0::DOUBLE AS weight FROM dirs QUALIFY b IS NOT NULL"""
)
def wn01_directory_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bindings.files(spark, sf_dir).select(F.col("path").alias("a"), text.directory(F.col("path")).alias("dir"))
    pairs = files.withColumn("b", F.lead("a").over(Window.partitionBy("dir").orderBy("a"))).where(F.col("b").isNotNull())
    return pairs.select("a", "b", F.concat(F.lit("shared_dir:"), "dir").alias("relation"), F.lit(1.0).alias("weight"))


@register(
    BASE
    + """, h AS (SELECT repo, path, sha256(content) AS h FROM files)
    SELECT repo, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path)) AS fingerprint FROM h GROUP BY repo"""
)
def ag28_so09_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each repository from the hashes of its files; SHA-256 stands in for BLAKE3."""
    hashed = bindings.files(spark, sf_dir).select("repo", F.struct("path", F.sha2(F.col("content").cast("binary"), 256).alias("h")).alias("f"))
    own = F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["path"], F.lit(":"), f["h"]))
    return hashed.groupBy("repo").agg(F.sha2(F.array_join(own, "\n").cast("binary"), 256).alias("fingerprint"))


@register(
    BASE
    + """, one AS (SELECT repo, sha256(string_agg(path, ',' ORDER BY path)) AS a, sha256(sum(lines)::VARCHAR) AS b, sha256(count(*)::VARCHAR) AS c FROM files GROUP BY repo)
    SELECT repo, sha256(a || b || c) AS chain FROM one"""
)
def ag30_hs01_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = bindings.files(spark, sf_dir).groupBy("repo").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("path")), ",").cast("binary"), 256).alias("a"),
        F.sha2(F.sum("lines").cast("string").cast("binary"), 256).alias("b"),
        F.sha2(F.count("*").cast("string").cast("binary"), 256).alias("c"),
    )
    return parts.select("repo", F.sha2(F.concat("a", "b", "c").cast("binary"), 256).alias("chain"))


@register(
    BASE
    + """, firsts AS (SELECT category, arg_min(severity, (file, rule)) AS severity FROM findings GROUP BY category)
    SELECT rule_id, name, category, level FROM firsts JOIN severities USING (severity) JOIN categories USING (category)"""
)
def snk02_sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_rules(found(spark, sf_dir))


@register(
    BASE
    + """SELECT file, rule, '{"ruleId":"' || rule_id || '","level":"' || level || '","message":{"text":"' || description || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"}}}]}' AS result
    FROM findings JOIN severities USING (severity) JOIN categories USING (category)"""
)
def snk02_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_results(found(spark, sf_dir))


@register(
    BASE
    + """, f AS (SELECT repo, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m,
      count(*) FILTER (severity = 'Low') AS l, list_sort(list(DISTINCT category)) AS cats FROM findings GROUP BY repo)
    SELECT 'hexad-' || repo AS id, '{"program":"' || repo || '","total_files":' || total_files || ',"critical":' || c || ',"high":' || h || ',"medium":' || m || ',"low":' || l
      || ',"categories":["' || array_to_string(cats, '","') || '"]}' AS document FROM f JOIN repos USING (repo)"""
)
def snk06_hexads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.hexads(scoring.repo_results(counted(spark, sf_dir), found(spark, sf_dir)), found(spark, sf_dir))


@register(
    BASE
    + f""", {_CELLS}, m AS (SELECT category, axis, max(value) AS v FROM cells GROUP BY ALL),
    u AS (SELECT DISTINCT 'critical_finding' AS kind, category AS subject FROM findings WHERE severity = 'Critical' UNION ALL SELECT 'taint_cell', category || '/' || axis FROM m WHERE v >= 3.5)
    SELECT kind, subject, row_number() OVER (ORDER BY kind, subject) AS id FROM u"""
)
def snk12_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = found(spark, sf_dir)
    return sinks.constraints(findings, scoring.taint_matrix(findings), 3.5)


@register(
    BASE
    + """SELECT repo, '- **' || repo || '** [' || CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' ELSE 'MEDIUM' END || ']: ' || weak_points || ' findings' AS line
    FROM repos WHERE weak_points >= 3"""
)
def snk14_flt02_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown(scoring.repo_results(counted(spark, sf_dir), found(spark, sf_dir)), 3)


@register(
    BASE
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, rule) AS place FROM findings QUALIFY place <= 4)
    SELECT repo, '{ weak_points = [' || string_agg('{ category = "' || category || '", description = "' || description || '" }', ', ' ORDER BY place) || '] }' AS record FROM k GROUP BY repo"""
)
def snk03_so06_nickel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.nickel(found(spark, sf_dir))
