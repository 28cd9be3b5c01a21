"""Queries: text functions, log search, mutations, readers and small scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dims, text
from tessera.operators import bridge, mutations, rust_strings, search, signatures
from tessera.operators.mutations import Operation
from tessera.plans.registry import register
from tessera.sources import bindings, readers
from tessera.sources.bindings import table
from tessera.streaming import events as streaming

_LOCATIONS = [("src/a.rs:12",), ("src/a.rs",), ("C:\\x\\y.rs:7",), ("a:b:3",), ("a:b",), ("x:",), (":5",)]


@register(
    f"""SELECT loc, CASE WHEN regexp_matches(loc, '^.*:[0-9]+$') THEN regexp_extract(loc, '^(.*):([0-9]+)$', 1) ELSE loc END AS file,
    CASE WHEN regexp_matches(loc, '^.*:[0-9]{{1,9}}$') THEN regexp_extract(loc, '^.*:([0-9]{{1,9}})$', 1)::INT END AS line FROM {dims.values_sql('loc', _LOCATIONS)}"""
)
def prj03_prj04_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.col("loc")
    return dims.values(spark, "loc", _LOCATIONS).select("loc", text.location_file(loc).alias("file"), text.location_line(loc).alias("line"))


@register(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), t AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM l)
    SELECT doc_id, len(p)::BIGINT AS lines, coalesce(p[1], '') AS head, coalesce(p[len(p)], '') AS tail FROM t"""
)
def st07_wn06_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("p"))
    first, last = F.get("p", F.lit(0)), F.get("p", F.size("p") - 1)
    return own.select("doc_id", F.size("p").cast("long").alias("lines"), F.coalesce(first, F.lit("")).alias("head"), F.coalesce(last, F.lit("")).alias("tail"))


@register(
    """SELECT doc_id, (length(text) - length(replace(text, 'the ', ''))) // 4 AS the, (length(text) - length(replace(text, 'nn', ''))) // 2 AS nn,
    contains(text, 'token') AS token, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers, least(len(regexp_extract_all(text, '!!'))::BIGINT, 10) AS capped FROM documents"""
)
def st01_st05_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.literal_count(c, "the ").alias("the"), text.literal_count(c, "nn").alias("nn"), F.contains(c, F.lit("token")).alias("token"),
        F.regexp_count(c, F.lit("[0-9]+")).cast("long").alias("numbers"), F.least(F.regexp_count(c, F.lit("!!")).cast("long"), F.lit(10)).alias("capped"),
    )


@register()
def st06_rust_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), rust_strings.stripped()("text").alias("stripped"))


@register("SELECT p_partkey, p_name, levenshtein(p_name, 'blue bolt') AS distance FROM part WHERE levenshtein(p_name, 'blue bolt') <= 4")
def st12_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("distance", F.levenshtein("p_name", F.lit("blue bolt"), 4))
    return parts.where("distance >= 0").select("p_partkey", "p_name", "distance")


_LOGS = [("x", "all fine\nPermision denied\nsegmentation falt here\nwarning: memory leek\n"), ("y", "Permission Denied!\n\nfatal eror"), ("z", "")]
_WORDS = ["permission denied", "error", "memory leak"]
CONVERSATION_WORDS = [*_WORDS, "question"]
_SIZES = sorted({max(1, len(w) + d) for w in _WORDS for d in range(-2, 3)})


@register(
    f"""WITH raw AS (SELECT id, string_split(content, chr(10)) AS p FROM {dims.values_sql('id, content', _LOGS)}),
    t AS (SELECT id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM raw), l AS (SELECT id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM t),
    w AS (SELECT unnest([{', '.join(f"'{w}'" for w in _WORDS)}]) AS pattern)
    SELECT id, 'grep' AS mode, pattern, line_no::INT AS line_no, line, 0 AS distance FROM l, w WHERE contains(lower(line), lower(pattern))"""
)
def st14_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(dims.values(spark, "id, content", _LOGS), _WORDS)


@register(
    f"""WITH raw AS (SELECT id, string_split(content, chr(10)) AS p FROM {dims.values_sql('id, content', _LOGS)}),
    t AS (SELECT id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM raw), l AS (SELECT id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM t),
    w AS (SELECT unnest([{', '.join(f"'{w}'" for w in _WORDS)}]) AS pattern),
    s AS (SELECT id, line_no, line, pattern, unnest(range(length(pattern) - 2, length(pattern) + 3)) AS n FROM l, w),
    k AS (SELECT *, unnest(range(1, greatest(length(line) - n + 1, 1) + 1)) AS start FROM s),
    d AS (SELECT id, line_no, line, pattern, levenshtein(substring(lower(line), start::INT, n::INT), pattern) AS distance FROM k
      UNION ALL SELECT id, line_no, line, pattern, levenshtein(token, pattern) FROM (SELECT id, line_no, line, pattern, unnest(string_split(lower(line), ' ')) AS token FROM l, w) WHERE token <> '')
    SELECT id, 'agrep' AS mode, pattern, line_no::INT AS line_no, line, min(distance) AS distance FROM d GROUP BY ALL HAVING min(distance) <= 2"""
)
def st13_agrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.agrep(dims.values(spark, "id, content", _LOGS), _WORDS, 2)


@register()
def st13_agrep_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy grep over every line of the conversations."""
    logs = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("content"))
    return search.agrep(logs, CONVERSATION_WORDS, 2).select("id.conv_id", "id.turn", "mode", "pattern", "line_no", "line", "distance")


@register(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)
    SELECT conv_id, turn, count(*) AS hits FROM l WHERE contains(lower(line), 'ing') OR contains(lower(line), 'ung') GROUP BY ALL"""
)
def st14_grep_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("content"))
    hits = search.grep(logs, ["ing", "ung"]).select("id", "line_no").distinct()
    return hits.groupBy("id").agg(F.count("*").alias("hits")).select("id.conv_id", "id.turn", "hits")


@register("SELECT doc_id, length(CASE WHEN strlen(text) > 4096 THEN text[1:4096] || '...[cut]' ELSE text END) AS kept, strlen(text) > 4096 AS cut FROM documents")
def st15_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = text.clamp(F.col("text"), 4096, "...[cut]")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clamped).cast("long").alias("kept"), (F.octet_length("text") > 4096).alias("cut"))


_STDERR = [("a", "killed by SIGSEGV after SIGABRT"), ("b", "SIGABRT\nstack backtrace: 0: x"), ("c", "SIGILL"), ("d", "clean"), ("e", "")]


@register(
    f"""SELECT id, CASE WHEN contains(o, 'SIGSEGV') THEN 'SIGSEGV' WHEN contains(o, 'SIGABRT') THEN 'SIGABRT' WHEN contains(o, 'SIGILL') THEN 'SIGILL' END AS signal,
    CASE WHEN contains(o, 'backtrace') THEN o END AS backtrace FROM {dims.values_sql('id, o', _STDERR)}"""
)
def st16_st17_crash_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o")
    return dims.values(spark, "id, o", _STDERR).select("id", signatures.signal_of(o).alias("signal"), F.when(F.contains(o, F.lit("backtrace")), o).alias("backtrace"))


# fixed values: the built-in mutation combinations
COMBOS = {
    "boolean-flip": [Operation("replace_first", "true", "false"), Operation("replace_first", "false", "true")],
    "comparison-flip": [Operation("replace_first", "==", "!="), Operation("replace_first", ">=", "<=")],
    "mutation-marker": [Operation("prepend", new="/* amuck: mutated file */\n"), Operation("append", new="\n/* amuck: end marker */\n")],
    "guard-removal": [Operation("delete_lines", "if "), Operation("delete_lines", "guard")],
    "auth-bypass-token-swap": [Operation("swap", "allow", "deny"), Operation("swap", "permit", "reject")],
    "dup-dangerous-calls": [Operation("duplicate_lines", "exec", times=1), Operation("duplicate_lines", "eval", times=1)],
}


@register()
def st20_st21_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.mutate(bindings.files(spark, sf_dir).select(F.col("path").alias("file"), "content"), COMBOS)


@register("SELECT doc_id, replace(text, 'the', 'THE') AS mutated, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS changes FROM documents WHERE contains(text, 'the')")
def st20_flt09_replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    mutated, changes = mutations.apply(F.col("text"), Operation("replace_all", "the", "THE"))
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", mutated.alias("mutated"), changes.alias("changes"))


@register("SELECT s_suppkey, CASE WHEN s_acctbal::BIGINT > 0 THEN '+' || s_acctbal::BIGINT ELSE (s_acctbal::BIGINT)::VARCHAR END AS delta FROM (SELECT s_suppkey, floor(s_acctbal) AS s_acctbal FROM supplier)")
def st23_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.signed(F.floor("s_acctbal")).alias("delta"))


@register(
    """SELECT p_partkey, '[' || repeat('#', f) || repeat('-', 20 - f) || ']' AS bar FROM (SELECT p_partkey, least(greatest(round(p_size / 50.0::DOUBLE * 20), 0), 20)::INT AS f FROM part)"""
)
def st24_health_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.health_bar(F.col("p_size") / 50.0).alias("bar"))


_CATALOG = [("en", "done", "Done"), ("en", "fail", "Failed"), ("de", "done", "Fertig"), ("fr", "fail", "Échec")]


@register(
    f"""WITH c AS (SELECT * FROM {dims.values_sql('lang, key, word', _CATALOG)}), w AS (SELECT l.lang, k.key FROM (SELECT DISTINCT lang FROM documents) l, (VALUES ('done'), ('fail'), ('other')) AS k(key))
    SELECT w.lang, w.key, coalesce(a.word, b.word, w.key) AS word FROM w LEFT JOIN c a ON a.lang = w.lang AND a.key = w.key LEFT JOIN c b ON b.lang = 'en' AND b.key = w.key"""
)
def st25_i18n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in a language, else in English, else the key."""
    catalog = dims.values(spark, "lang, key, word", _CATALOG)
    wanted = table(spark, sf_dir, "documents").select("lang").distinct().select("lang", F.explode(F.array(*[F.lit(k) for k in ("done", "fail", "other")])).alias("key"))
    english = catalog.where("lang = 'en'").select("key", F.col("word").alias("english"))
    return wanted.join(F.broadcast(catalog), ["lang", "key"], "left").join(F.broadcast(english), "key", "left").select("lang", "key", F.coalesce("word", "english", "key").alias("word"))


_DURATIONS = [("5s",), ("500ms",), ("2m",), ("1h",), ("30",), ("",), ("-3s",), ("1.5s",), (" 7s ",), ("x",), ("0.4ms",)]


@register(
    f"""WITH p AS (SELECT raw, regexp_extract(trim(raw), '^([0-9]+(?:\\.[0-9]+)?)(ms|s|m|h)?$', 1) AS n, regexp_extract(trim(raw), '^([0-9]+(?:\\.[0-9]+)?)(ms|s|m|h)?$', 2) AS u FROM {dims.values_sql('raw', _DURATIONS)})
    SELECT raw, CASE WHEN n <> '' THEN round(n::DOUBLE * CASE u WHEN 'ms' THEN 1 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 1000 END)::BIGINT END AS ms FROM p"""
)
def dt01_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.values(spark, "raw", _DURATIONS).select("raw", text.duration_ms(F.col("raw")).alias("ms"))


@register("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, lpad(lower(to_hex(epoch_us(ts) // 1000)), 16, '0') AS uuid, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS later FROM events")
def dt02_dt04_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.lpad(F.lower(F.hex(ms)), 16, "0").alias("uuid"), F.date_format(F.date_add(F.to_date("ts"), 3), "yyyy-MM-dd").alias("later")
    )


_SCORES = [("9.8",), ("7.0",), ("4",), ("3.9",), ("CVSS:3.1/AV:N",), ("",), (" 8.1 ",)]


@register(
    f"""WITH s AS (SELECT raw, CASE WHEN regexp_matches(raw, '^\\s*[0-9]+(\\.[0-9]+)?\\s*$') THEN trim(raw)::DOUBLE END AS score FROM {dims.values_sql('raw', _SCORES)})
    SELECT raw, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS label FROM s"""
)
def ma08_prj07_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = dims.values(spark, "raw", _SCORES).withColumn("score", bridge.cvss_score(F.col("raw")))
    return scored.select("raw", "score", bridge.severity_label(F.col("score")).alias("label"))


@register("SELECT s_suppkey, round(1.0 / (1.0 + exp(-(s_acctbal / 1000 - 5.0) * 0.5)), 6) AS risk, CASE WHEN s_acctbal / 10000 < 0.2 THEN 'healthy' WHEN s_acctbal / 10000 < 0.4 THEN 'low' WHEN s_acctbal / 10000 < 0.6 THEN 'moderate' WHEN s_acctbal / 10000 < 0.8 THEN 'high' ELSE 'critical' END AS bucket FROM supplier")
def ma01_prj08_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.scoring import bucket

    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(text.sigmoid(F.col("s_acctbal") / 1000), 6).alias("risk"), bucket(F.col("s_acctbal") / 10000).alias("bucket"))


@register(
    f"SELECT name, multiplier, 1000 * multiplier AS cpu, 1024 * multiplier AS memory_mb, 100 * multiplier AS files, 50 * multiplier AS threads FROM {dims.values_sql('name, multiplier', list(dims.INTENSITIES.items()))}"
)
def ma09_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("multiplier")
    return dims.values(spark, "name, multiplier", list(dims.INTENSITIES.items())).select("name", "multiplier", (1000 * m).alias("cpu"), (1024 * m).alias("memory_mb"), (100 * m).alias("files"), (50 * m).alias("threads"))


@register("SELECT k, count(*) AS n, sum(value) AS total FROM (SELECT (props->>'k')::INT AS k, round(value) AS value FROM events) GROUP BY k")
def js01_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k"), F.round("value").alias("value"))
    return parsed.groupBy("k").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register("SELECT doc_id, sha256(text) AS content_hash, sha256('nonce' || chr(8214) || source || chr(8214) || '1.0') AS commitment FROM documents")
def hs01_hs02_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    commitment = F.concat(F.lit("nonce‖"), F.col("source"), F.lit("‖1.0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.sha2(commitment.cast("binary"), 256).alias("commitment"))


_TIMELINES = [
    ('{"program":"p","tracks":[{"axis":"cpu","events":[{"id":"x","at":"5s","for":"10s","intensity":"Heavy"},{"at":"500ms","for":"1m"}]},{"axis":"disk","events":[{"at":"30","for":"2s"}]}]}',),
]


@register("SELECT * FROM (VALUES ('p', 'cpu', 'x', 5000::BIGINT, 10000::BIGINT, 'Heavy'), ('p', 'cpu', 'cpu-2', 500, 60000, NULL), ('p', 'disk', 'disk-1', 30000, 2000, NULL)) AS t(program, axis, id, start_ms, duration_ms, intensity)")
def src14_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.timeline(dims.values(spark, "raw", _TIMELINES))


_RESULTS = [('[{"program":"a","axis":"cpu","success":true,"skipped":false}]',), ('{"attack_results":[{"program":"b","axis":"disk","success":false},{"program":"c","skipped":true}]}',)]


@register("SELECT * FROM (VALUES ('a', 'cpu', TRUE, FALSE), ('b', 'disk', FALSE, FALSE), ('c', NULL, FALSE, TRUE)) AS t(program, axis, success, skipped)")
def src09_attack_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.attack_results(dims.values(spark, "raw", _RESULTS))


_KINDS = [('{"attack_results":[]}',), ('{"outcomes":[]}',), ('{"selected_files":[]}',), ('{"x":1}',), ("nope",)]


@register(f"SELECT raw, CASE WHEN contains(raw, 'attack_results') THEN 'assault' WHEN contains(raw, 'outcomes') THEN 'amuck' WHEN contains(raw, 'selected_files') THEN 'abduct' END AS kind FROM {dims.values_sql('raw', _KINDS)}")
def src08_report_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.values(spark, "raw", _KINDS).select("raw", readers.report_kind("raw").alias("kind"))


_MANIFEST = [("# repos",), ("/a/x",), ("",), ("  /b/y  ",), ("#/c",)]


@register(f"SELECT trim(line) AS repo FROM {dims.values_sql('line', _MANIFEST)} WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def src06_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.trim("line")
    return dims.values(spark, "line", _MANIFEST).where((own != "") & ~F.startswith(own, F.lit("#"))).select(own.alias("repo"))


@register(
    """WITH a AS (SELECT array_agg(DISTINCT lang) AS x FROM documents WHERE source = 'src1'), b AS (SELECT array_agg(DISTINCT role) AS y FROM conversations)
    SELECT 'kept' AS side, unnest(list_sort(x)) AS item FROM a UNION ALL SELECT 'added', unnest(list_sort(y)) FROM b"""
)
def se01_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of either set that the other lacks."""
    a = table(spark, sf_dir, "documents").where("source = 'src1'").agg(F.collect_set("lang").alias("x"))
    b = table(spark, sf_dir, "conversations").agg(F.collect_set("role").alias("y"))
    both = a.crossJoin(b)
    side = lambda name, left, right: both.select(F.lit(name).alias("side"), F.explode(F.array_except(left, right)).alias("item"))
    return side("kept", "x", "y").union(side("added", "y", "x"))


@register("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm3_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extension's plan over the batch table."""
    counted = streaming.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counted.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@register(
    """SELECT coalesce(p_brand, '*') AS brand, coalesce(p_type, '*') AS kind, count(*) AS n, max(p_size) AS largest FROM part GROUP BY CUBE (p_brand, p_type)"""
)
def x_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the matrix with all its margins."""
    cube = table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))
    return cube.select(F.coalesce("p_brand", F.lit("*")).alias("brand"), F.coalesce("p_type", F.lit("*")).alias("kind"), "n", "largest")
