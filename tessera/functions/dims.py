"""Fixed dimensions and the DataFrames made of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# fixed values: file extensions of each language
EXTENSIONS = {
    "rust": ["rs"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"], "go": ["go"], "java": ["java"], "python": ["py", "pyw"],
    "javascript": ["js", "mjs", "cjs", "ts", "tsx", "jsx"], "ruby": ["rb"],
    "elixir": ["ex", "exs"], "erlang": ["erl", "hrl"], "gleam": ["gleam"],
    "rescript": ["res", "resi"], "ocaml": ["ml", "mli"], "standardml": ["sml", "sig", "fun"],
    "scheme": ["scm", "ss", "sld"], "racket": ["rkt", "scrbl"], "haskell": ["hs", "lhs"], "purescript": ["purs"],
    "idris": ["idr", "ipkg"], "lean": ["lean"], "agda": ["agda", "lagda"],
    "prolog": ["pl", "pro", "P"], "logtalk": ["lgt", "logtalk"], "datalog": ["dl"],
    "zig": ["zig"], "ada": ["adb", "ads", "gpr"], "odin": ["odin"], "nim": ["nim", "nims", "nimble"], "pony": ["pony"], "dlang": ["d", "di"],
    "nickel": ["ncl"], "nix": ["nix"], "shell": ["sh", "bash", "zsh", "fish"], "julia": ["jl"], "lua": ["lua", "luau"],
    "wokelang": ["woke"], "eclexia": ["ecl"], "mylang": ["my", "solo", "duet", "ensemble"], "juliatheviper": ["jtv"], "oblibeny": ["obli"],
    "anvomidav": ["anvom"], "affinescript": ["aff"], "ephapax": ["ephapax", "eph"], "betlang": ["bet"], "errorlang": ["err"], "vql": ["vql"], "fbql": ["fbql"],
}

# fixed values: languages of each family
FAMILIES = {
    "beam": ["elixir", "erlang", "gleam"], "ml": ["rescript", "ocaml", "standardml"], "lisp": ["scheme", "racket"], "functional": ["haskell", "purescript"],
    "proof": ["idris", "lean", "agda"], "logic": ["prolog", "logtalk", "datalog"], "systems": ["zig", "ada", "odin", "nim", "pony", "dlang"],
    "config": ["nickel", "nix"], "shell": ["shell"], "julia": ["julia"], "lua": ["lua"], "rust": ["rust"], "c-family": ["c", "cpp"], "go": ["go"],
    "java": ["java"], "python": ["python"], "javascript": ["javascript"], "ruby": ["ruby"],
    "nextgen-dsl": ["wokelang", "eclexia", "mylang", "juliatheviper", "oblibeny", "anvomidav", "affinescript", "ephapax", "betlang", "errorlang", "vql", "fbql"],
}

# fixed values: categories in the order of their rule numbers, and their rule names
CATEGORIES = {
    "UncheckedAllocation": "unchecked-allocation", "UnboundedLoop": "unbounded-loop", "BlockingIO": "blocking-io", "UnsafeCode": "unsafe-code",
    "PanicPath": "panic-path", "RaceCondition": "race-condition", "DeadlockPotential": "deadlock-potential", "ResourceLeak": "resource-leak",
    "CommandInjection": "command-injection", "UnsafeDeserialization": "unsafe-deserialization", "DynamicCodeExecution": "dynamic-code-execution",
    "UnsafeFFI": "unsafe-ffi", "AtomExhaustion": "atom-exhaustion", "InsecureProtocol": "insecure-protocol", "ExcessivePermissions": "excessive-permissions",
    "PathTraversal": "path-traversal", "HardcodedSecret": "hardcoded-secret", "UncheckedError": "unchecked-error", "InfiniteRecursion": "infinite-recursion",
    "UnsafeTypeCoercion": "unsafe-type-coercion",
}

# fixed values: severities with their rank, value and level in exports
SEVERITIES = {"Low": (0, 1.0, "note"), "Medium": (1, 2.5, "warning"), "High": (2, 3.5, "error"), "Critical": (3, 5.0, "error")}

AXES = ["cpu", "memory", "disk", "network", "concurrency", "time"]

# fixed values: intensities and their multipliers
INTENSITIES = {"Light": 1, "Medium": 5, "Heavy": 10, "Extreme": 50}

# fixed values: taint sources and sinks that a category implies
TAINT_SOURCES = {
    "CommandInjection": "UserInput", "UnsafeDeserialization": "Deserialization", "DynamicCodeExecution": "UserInput", "UnsafeFFI": "ForeignReturn",
    "AtomExhaustion": "NetworkRead", "PathTraversal": "UserInput", "InsecureProtocol": "NetworkRead", "HardcodedSecret": "EnvVar",
}
TAINT_SINKS = {
    "CommandInjection": "ShellCommand", "UnsafeDeserialization": "DeserializeSink", "DynamicCodeExecution": "CodeExecution", "UnsafeFFI": "MemoryOperation",
    "AtomExhaustion": "AtomCreation", "PathTraversal": "FilePath", "InsecureProtocol": "NetworkWrite", "UnsafeCode": "MemoryOperation",
    "HardcodedSecret": "LogOutput", "UnsafeTypeCoercion": "UnsafeCast",
}

# fixed values: contexts that suppress a category, with the rule's confidence
SUPPRESSIONS = [
    ("UncheckedAllocation", "null_checked", 0.95), ("PanicPath", "result_returning_fn", 0.90), ("UnsafeDeserialization", "schema_validated", 0.85),
    ("CommandInjection", "enum_args", 0.90), ("RaceCondition", "mutex_guarded", 0.95), ("DeadlockPotential", "timeout_protected", 0.85),
    ("PathTraversal", "path_canonicalized", 0.90), ("CommandInjection", "constant_args", 0.95), ("*", "test_file", 0.99), ("ResourceLeak", "raii_managed", 0.90),
]

# fixed values: languages with a foreign-function mechanism of their own; others run subprocesses
FFI_MECHANISMS = {
    "elixir": "BeamNif", "erlang": "BeamNif", "rescript": "JsFfi", "purescript": "JsFfi",
    "zig": "CFfi", "ada": "CFfi", "nim": "CFfi", "dlang": "CFfi", "rust": "CFfi", "c": "CFfi", "cpp": "CFfi",
}


def language_rows() -> list[tuple[str, str, str]]:
    """(extension, language, family)"""
    family = {language: name for name, members in FAMILIES.items() for language in members}
    return [(ext, language, family[language]) for language, exts in EXTENSIONS.items() for ext in exts]


def category_rows() -> list[tuple[str, str, str]]:
    """(category, rule id, rule name)"""
    return [(c, f"PA{n:03d}", name) for n, (c, name) in enumerate(CATEGORIES.items(), 1)]


def severity_rows() -> list[tuple[str, int, float, str]]:
    return [(s, *own) for s, own in SEVERITIES.items()]


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as a local relation, so that plans see its size."""
    return spark.sql(f"SELECT * FROM {values_sql(columns, rows)}")


def literal_sql(value) -> str:
    """An SQL literal that both dialects read alike."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    pieces = []
    for part in re.split(r"([\n\t\\])", str(value)):
        if part in ("\n", "\t", "\\"):
            pieces.append(f"chr({ord(part)})")
        elif part:
            pieces.append("'" + part.replace("'", "''") + "'")
    return "''" if not pieces else pieces[0] if len(pieces) == 1 else "concat(" + ", ".join(pieces) + ")"


def values_sql(columns: str, rows: list[tuple], name: str = "v") -> str:
    body = ", ".join("(" + ", ".join(map(literal_sql, row)) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({columns})"
