"""Crash signatures and reaction signals from program output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# fixed values: words of the facts about a crash; case matters
FACT_WORDS = {
    "alloc": ("malloc", "alloc", "new "), "free": ("free", "drop", "dealloc"), "free_again": ("double free", "freed twice"), "use": ("use", "access", "dereference"),
    "lock": ("lock", "mutex", "Mutex"), "lock_again": ("deadlock", "waiting"), "unlock": ("unlock",), "spawn": ("thread", "spawn", "goroutine"),
    "write": ("write", "store", "modify"), "read": ("read", "load", "fetch"),
}

# fixed values: rules over those facts, with their confidence
FACT_RULES = {
    "UseAfterFree": (("free", "use"), 0.85), "DoubleFree": (("free", "free_again"), 0.90), "Deadlock": (("lock", "lock_again"), 0.70), "DataRace": (("write", "read"), 0.65),
    "NullPointerDeref": (("use",), 0.80), "BufferOverflow": (("alloc",), 0.75),
}

# fixed values: patterns that name a signature outright: any word, or all words of a tuple
PATTERNS = {
    "UseAfterFree": (("use after free", "use-after-free", ("freed", "accessed")), 0.95), "DoubleFree": (("double free", "double-free", "freed twice"), 0.95),
    "Deadlock": (("deadlock", "deadlocked", ("waiting", "lock")), 0.90), "DataRace": (("data race", "race condition", "ThreadSanitizer"), 0.95),
    "NullPointerDeref": (("null pointer", "nullptr", "nil pointer", "address 0x0"), 0.90),
    "BufferOverflow": (("buffer overflow", "stack smashing", "heap corruption", "AddressSanitizer"), 0.95),
    "MemoryLeak": (("memory leak", "LeakSanitizer", "lost: "), 0.85), "IntegerOverflow": (("integer overflow", "arithmetic overflow", "overflow on"), 0.90),
}

# fixed values: reaction signals with their severity and words, in lower case
SIGNALS = {
    "crash_signal": ("high", ("sigsegv", "segmentation fault", "access violation")), "panic_signal": ("high", ("panic", "fatal", "sigabrt", "assertion failed")),
    "lock_reaction_signal": ("info", ("permission denied", "read-only file system", "operation not permitted")),
    "interface_mismatch_signal": ("low", ("unknown option", "unknown argument", "unexpected argument")),
}


def matches(content: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | (text.has_any(content, [word]) if isinstance(word, str) else text.has_all(content, word))
    return found


def signatures(crashes: DataFrame, id_col: str = "id", content: str = "stderr", signal: str | None = "signal") -> DataFrame:
    """(id, signature, confidence, origin) of each crash: rules over its facts, and patterns in its output; a bag."""
    found = []
    for name, (facts, confidence) in FACT_RULES.items():
        holds = F.lit(True)
        for fact in facts:
            holds = holds & matches(F.col(content), FACT_WORDS[fact])
        found.append(F.when(holds, F.struct(F.lit(name).alias("signature"), F.lit(confidence).alias("confidence"), F.lit("rule").alias("origin"))))
    for name, (words, confidence) in PATTERNS.items():
        holds = matches(F.col(content), words)
        if name == "NullPointerDeref" and signal:
            holds = holds | F.coalesce(F.col(signal) == "SIGSEGV", F.lit(False))
        found.append(F.when(holds, F.struct(F.lit(name).alias("signature"), F.lit(confidence).alias("confidence"), F.lit("pattern").alias("origin"))))
    return crashes.select(id_col, F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s")).select(id_col, "s.*")


def signal_of(output: Column) -> Column:
    chain = F.when(F.contains(output, F.lit("SIGSEGV")), "SIGSEGV")
    return chain.when(F.contains(output, F.lit("SIGABRT")), "SIGABRT").when(F.contains(output, F.lit("SIGILL")), "SIGILL")


def reactions(runs: DataFrame, id_col: str, output: Column, timed_out: Column, exit_code: Column) -> DataFrame:
    """(id, signal, severity); a non-zero exit counts only if nothing else was seen."""
    low = F.lower(output)
    struct = lambda name, severity: F.struct(F.lit(name).alias("signal"), F.lit(severity).alias("severity"))
    seen = [F.when(timed_out, struct("timeout_signal", "high"))]
    seen += [F.when(matches(low, words), struct(name, severity)) for name, (severity, words) in SIGNALS.items()]
    some = F.filter(F.array(*seen), lambda s: s.isNotNull())
    last = F.when((F.size(some) == 0) & F.coalesce(exit_code != 0, F.lit(False)), F.array(struct("nonzero_exit_signal", "low"))).otherwise(some)
    return runs.select(id_col, F.explode(last).alias("s")).select(id_col, "s.*")


def event_pairs(events: DataFrame) -> DataFrame:
    """(crash, signature) of ordered memory and lock events (crash, kind, name, pos): equi-joins with a residual comparison."""
    of = lambda kind, at: events.where(F.col("kind") == kind).select("crash", "name", F.col("pos").alias(at))
    uaf = of("free", "x").join(of("use", "y"), ["crash", "name"]).where("x < y").select("crash", F.lit("UseAfterFree").alias("signature"))
    twice = of("free", "x").join(of("free", "y"), ["crash", "name"]).where("x <> y").select("crash", F.lit("DoubleFree").alias("signature"))
    locks = of("lock", "x").groupBy("crash").agg(F.count_distinct("name").alias("n")).where("n > 1").select("crash", F.lit("Deadlock").alias("signature"))
    race = of("write", "x").join(of("read", "y"), ["crash", "name"]).select("crash", F.lit("DataRace").alias("signature"))
    return uaf.union(twice).union(locks).union(race).distinct()
