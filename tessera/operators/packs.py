"""Rule packs: what to count and what to report.

The code pack's categories, severities, axes, needles and thresholds are fixed
values. A pack can also be read from JSON (``tessera.sources.readers``).
"""

from __future__ import annotations

from tessera.functions.dims import FAMILIES
from tessera.operators.findings import Count, Rule, Test

C, M, D, N, P, T = "cpu", "memory", "disk", "network", "concurrency", "time"

_C = {"allocation_sites": ("malloc(", "calloc(", "new "), "io_operations": ("fopen(", "read(", "write("), "threading_constructs": ("pthread_", "std::thread")}
_LISP = {"io_operations": ("open-input-file", "open-output-file", "call-with-input-file", "call-with-output-file")}
_LOGIC = {
    "allocation_sites": ("assert(", "assertz(", "asserta(", "retract(", "retractall(", "call("), "io_operations": ("open(", "read_term(", "write_term("),
}
_NEXTGEN = {
    "unsafe_blocks": ("foreign", "external", "@ffi", "@native", "unsafe", "unchecked"), "io_operations": (Count("read", most=10), Count("write", most=10)),
}

# fixed values: needles of the counters by language
CODE_COUNTERS: dict[str, dict[str, tuple[str | Count, ...]]] = {
    "rust": {
        "unsafe_blocks": (Count("unsafe {", code=True), Count("unsafe fn", code=True)), "panic_sites": (Count("panic!(", code=True), Count("unreachable!(", code=True)),
        "unwrap_calls": (Count(".unwrap()", code=True), Count(".expect(", code=True)), "allocation_sites": ("Vec::new()", "Box::new(", "String::new()"),
        "io_operations": ("std::fs::", "std::io::"), "threading_constructs": ("std::thread::", "std::sync::"),
    },
    "c": _C,
    "cpp": _C,
    "go": {"allocation_sites": ("make(",), "threading_constructs": ("go func", "go ")},
    "python": {"io_operations": ("open(",), "threading_constructs": ("threading.",)},
    "javascript": {"io_operations": ("fs.read", "fs.write", "fetch("), "threading_constructs": ("Worker(", "new Worker")},
    "ruby": {"io_operations": ("File.open", "IO.read"), "threading_constructs": ("Thread.new",)},
    "java": {"allocation_sites": ("new ",), "io_operations": ("FileInputStream", "FileOutputStream"), "threading_constructs": ("new Thread", "ExecutorService")},
    "elixir": {
        "threading_constructs": ("spawn(", "spawn_link(", "Task.async(", "Task.start(", "GenServer.start"),
        "io_operations": ("File.read", "File.write", "IO.read", "HTTPoison", "Req."), "allocation_sites": (":ets.new", "Agent.start"),
    },
    "erlang": {"threading_constructs": ("spawn(", "spawn_link(", "spawn_monitor("), "io_operations": ("file:read", "file:write", "httpc:request"), "allocation_sites": ("ets:new",)},
    "gleam": {"unsafe_blocks": ("@external(",), "io_operations": ("simplifile", "gleam/http")},
    "rescript": {
        "unsafe_blocks": ("@val external", "@module external", "@send external", "@get external"), "panic_sites": ("JSON.parseExn",), "allocation_sites": ("ref(",),
        "unwrap_calls": ("getUnsafe", "getExn", "getOrExn"), "io_operations": ("Deno.readTextFile", "Deno.writeTextFile", "fetch("),
    },
    "ocaml": {"unsafe_blocks": ("Obj.magic",), "io_operations": ("open_in", "open_out"), "threading_constructs": ("Thread.create", "Mutex.")},
    "standardml": {"io_operations": ("TextIO.", "BinIO."), "unsafe_blocks": ("Unsafe.", "MLton.Pointer"), "panic_sites": ("raise ",)},
    "scheme": _LISP,
    "racket": _LISP,
    "haskell": {
        "unsafe_blocks": ("unsafePerformIO", "unsafeCoerce"), "unwrap_calls": (" head ", "(head ", " tail ", "(tail ", "fromJust"),
        "panic_sites": ('error "', 'error "', "undefined"), "io_operations": ("readFile", "writeFile"), "threading_constructs": ("forkIO", "MVar", "STM"),
    },
    "purescript": {"unsafe_blocks": ("foreign import",)},
    "idris": {"unsafe_blocks": ("believe_me", "%foreign")},
    "lean": {"unsafe_blocks": ("sorry",)},
    "agda": {"unsafe_blocks": (Count("trustMe", most=1), "{-# COMPILED", "{-# FOREIGN")},
    "prolog": _LOGIC,
    "logtalk": _LOGIC,
    "datalog": _LOGIC,
    "zig": {
        "unsafe_blocks": ("@intToPtr", "@ptrToInt", "@ptrCast"), "panic_sites": ("unreachable",), "allocation_sites": ("allocator.alloc", "allocator.create"),
        "io_operations": ("std.fs.", "std.net."), "threading_constructs": ("std.Thread", '@import("std").Thread'),
    },
    "ada": {
        "unsafe_blocks": ("Unchecked_Conversion", "Unchecked_Deallocation", "Unchecked_Access"), "allocation_sites": ("new ",),
        "threading_constructs": ("task type", "task body", "protected type"), "io_operations": ("Ada.Text_IO", "Ada.Streams"),
    },
    "odin": {
        "unsafe_blocks": ("rawptr", Count("#force_inline", "#force_no_inline", most=1), "foreign import"), "allocation_sites": ("make(", "new("),
        "io_operations": ("os.read", "os.write"), "threading_constructs": ("thread.create",),
    },
    "nim": {"unsafe_blocks": (Count("unsafeAddr", most=1),), "allocation_sites": ("new(", "alloc("), "io_operations": ("readFile(", "writeFile("), "threading_constructs": ("spawn ", "createThread")},
    "pony": {"unsafe_blocks": (Count(regex=r"@[a-zA-Z_]\w*\["), "recover"), "threading_constructs": ("actor ",)},
    "dlang": {
        "unsafe_blocks": ("@system", "@trusted", "__traits"), "allocation_sites": ("new ",), "io_operations": ("std.stdio",), "threading_constructs": ("spawn(", "std.concurrency"),
    },
    "nix": {"io_operations": ("import ", "fetchurl", "fetchGit", "fetchFromGitHub")},
    "nickel": {"io_operations": ("import ",)},
    "shell": {"io_operations": ("cat ", "curl ", "wget ")},
    "julia": {
        "unsafe_blocks": ("pointer_from_objref", "unsafe_load", "unsafe_store!"), "io_operations": ("open(", "read(", "write(", "download("),
        "threading_constructs": ("@spawn", "Threads.@threads", "@distributed"), "allocation_sites": ("Array{",),
    },
    "lua": {"io_operations": ("io.open(", "io.read("), "threading_constructs": ("coroutine.",)},
    **{language: _NEXTGEN for language in FAMILIES["nextgen-dsl"] if language != "eclexia"},
    "eclexia": {**_NEXTGEN, "allocation_sites": ("budget",)},
    "unknown": {"allocation_sites": ("alloc",), "io_operations": ("open",), "threading_constructs": ("thread",)},
}

_SYSTEM = ("prolog", "logtalk", "datalog")
_DSL = tuple(FAMILIES["nextgen-dsl"])

# fixed values: the shapes of secrets, plain and local addresses
SECRET = r"""(?i)(api[_-]?key|api[_-]?secret|password|passwd|secret[_-]?key|access[_-]?token|private[_-]?key)\s*[=:]\s*["'][^"']{8,}"""
HTTP, LOCAL = r"http://[a-zA-Z0-9]", r"http://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])"

# fixed values: the finding rules
CODE_RULES = [
    Rule("W01", ("rust",), Test(counter="unsafe_blocks"), "UnsafeCode", "High", (M, P), "{n} unsafe blocks"),
    Rule("W02", ("rust",), Test(counter="unwrap_calls", above=5), "PanicPath", "Medium", (M, D), "{n} unwrap/expect calls"),
    Rule("W03", ("rust",), Test(any_of=("transmute(", "transmute::<"), code=True), "UnsafeCode", "Critical", (M,), "mem::transmute usage"),
    Rule("W04", ("rust",), Test(any_of=("mem::forget(",), or_all=("forget(", "use std::mem"), code=True), "ResourceLeak", "High", (M,), "mem::forget usage (resource leak)"),
    Rule("W05", ("rust",), Test(any_of=("as *const ", "as *mut "), code=True), "UnsafeCode", "High", (M, P), "Raw pointer cast"),
    Rule("W06", ("c", "cpp"), Test(regex=r"malloc\([^)]+\)\s*;"), "UncheckedAllocation", "Critical", (M,), "Unchecked malloc"),
    Rule("W07", ("c", "cpp"), Test(any_of=("gets(",)), "UnsafeCode", "Critical", (M,), "gets() usage (unbounded buffer write)"),
    Rule("W08", ("c", "cpp"), Test(any_of=("system(",)), "CommandInjection", "Critical", (C, D), "system() call (command injection risk)"),
    Rule("W09", ("c", "cpp"), Test(any_of=("sprintf(",)), "UnsafeCode", "High", (M,), "sprintf() usage (buffer overflow risk)"),
    Rule("W10", ("c", "cpp"), Test(any_of=("strcpy(", "strcat(")), "UnsafeCode", "High", (M,), "Unbounded string operation (strcpy/strcat)"),
    Rule("W11", ("go",), Test(needles=("go ",), above=10), "ResourceLeak", "Medium", (P, M), "{n} goroutines spawned"),
    Rule("W12", ("go",), Test(any_of=("unsafe.Pointer",)), "UnsafeCode", "High", (M,), "unsafe.Pointer usage"),
    Rule("W13", ("go",), Test(any_of=("exec.Command",)), "CommandInjection", "High", (C, D), "exec.Command usage (command injection risk)"),
    Rule("W14", ("python",), Test(any_of=("while True:",)), "UnboundedLoop", "High", (C, T), "Unbounded while True loop"),
    Rule("W15", ("python",), Test(any_of=("eval(", "exec(")), "DynamicCodeExecution", "Critical", (C, M), "Dynamic code execution (eval/exec)"),
    Rule("W16", ("python",), Test(any_of=("pickle.load",)), "UnsafeDeserialization", "Critical", (C, M), "pickle deserialization (arbitrary code execution)"),
    Rule("W17", ("python",), Test(any_of=("os.system(", "os.popen(")), "CommandInjection", "Critical", (C, D), "Shell command execution (os.system/os.popen)"),
    Rule("W18", ("python",), Test(any_of=("subprocess.call", "subprocess.Popen", "subprocess.run"), also_any=("shell=True", "shell = True")), "CommandInjection", "High", (C, D), "subprocess with shell=True"),
    Rule("W19", ("javascript",), Test(any_of=("eval(",)), "DynamicCodeExecution", "Critical", (C, M), "eval() usage"),
    Rule("W20", ("javascript",), Test(any_of=("innerHTML", "document.write(")), "DynamicCodeExecution", "High", (M, N), "DOM manipulation (innerHTML/document.write)"),
    Rule("W21", ("javascript",), Test(any_of=("dangerouslySetInnerHTML",)), "DynamicCodeExecution", "High", (M, N), "dangerouslySetInnerHTML (XSS risk)"),
    Rule("W22", ("javascript",), Test(any_of=("deno run -A", "deno run --allow-all")), "ExcessivePermissions", "High", (N, D), "Deno -A (all permissions)"),
    Rule("W23", ("javascript",), Test(needles=("JSON.parseExn",)), "UnsafeDeserialization", "High", (M, C), "{n} JSON.parseExn calls"),
    Rule("W24", ("ruby",), Test(any_of=("eval(", "send(")), "DynamicCodeExecution", "High", (C, M), "Dynamic code execution"),
    Rule("W25", ("java",), Test(any_of=("Runtime.getRuntime().exec(",)), "CommandInjection", "Critical", (C, D), "Runtime.exec()"),
    Rule("W26", ("elixir",), Test(any_of=("Code.eval_string", "Code.eval_quoted")), "DynamicCodeExecution", "Critical", (C, M), "Code.eval_string/eval_quoted"),
    Rule("W27", ("elixir",), Test(needles=("String.to_atom",)), "AtomExhaustion", "High", (M,), "{n} String.to_atom calls", " (use String.to_existing_atom)"),
    Rule("W28", ("elixir",), Test(any_of=("Port.open", "System.cmd")), "CommandInjection", "Medium", (C, D), "System command execution"),
    Rule("W29", ("elixir",), Test(regex=r"apply\([^,]+,\s*[^,]+,"), "DynamicCodeExecution", "Medium", (C,), "Dynamic apply/3"),
    Rule("W30", ("erlang",), Test(needles=("list_to_atom", "binary_to_atom")), "AtomExhaustion", "High", (M,), "{n} unchecked atom creation", " (use list_to_existing_atom)"),
    Rule("W31", ("erlang",), Test(any_of=("os:cmd",)), "CommandInjection", "High", (C, D), "os:cmd call"),
    Rule("W32", ("gleam",), Test(needles=("@external(",), above=5), "UnsafeFFI", "Medium", (M,), "{n} @external FFI calls"),
    Rule("W33", ("rescript",), Test(needles=("JSON.parseExn",)), "UnsafeDeserialization", "High", (M, C), "{n} JSON.parseExn calls", " (use JSON.parse for safe Result)"),
    Rule("W34", ("rescript",), Test(needles=("ignore(",), above=3), "UncheckedError", "Medium", (M,), "{n} ignore() calls", " (may discard important results)"),
    Rule("W35", ("rescript",), Test(needles=("getUnsafe", "getExn", "getOrExn")), "PanicPath", "Medium", (M,), "{n} unsafe get calls"),
    Rule("W36", ("ocaml",), Test(any_of=("Obj.magic",)), "UnsafeTypeCoercion", "Critical", (M,), "Obj.magic (unsafe type coercion)"),
    Rule("W37", ("ocaml",), Test(any_of=("Obj.repr",)), "UnsafeCode", "High", (M,), "Obj.repr (unsafe representation access)"),
    Rule("W38", ("ocaml",), Test(any_of=("Marshal.from_string", "Marshal.from_channel")), "UnsafeDeserialization", "Critical", (M, C), "Unsafe Marshal deserialization"),
    Rule("W39", ("ocaml",), Test(any_of=("Unix.system", "Unix.execvp")), "CommandInjection", "High", (C, D), "Unix.system/execvp command execution"),
    Rule("W40", ("standardml",), Test(needles=("Unsafe.", "MLton.Pointer")), "UnsafeCode", "High", (M,), "{n} unsafe operations"),
    Rule("W41", ("scheme", "racket"), Test(any_of=("(eval ", "(eval\n")), "DynamicCodeExecution", "High", (C, M), "eval usage"),
    Rule("W42", ("scheme", "racket"), Test(any_of=("(system ", "(process ")), "CommandInjection", "High", (C, D), "System/process call"),
    Rule("W43", ("scheme", "racket"), Test(needles=("call-with-current-continuation", "call/cc"), above=3), "ResourceLeak", "Medium", (M, C), "{n} call/cc usage"),
    Rule("W44", ("haskell",), Test(needles=("unsafePerformIO",)), "UnsafeCode", "Critical", (P, M), "{n} unsafePerformIO"),
    Rule("W45", ("haskell",), Test(needles=("unsafeCoerce",)), "UnsafeTypeCoercion", "Critical", (M,), "{n} unsafeCoerce"),
    Rule("W46", ("haskell",), Test(needles=(" head ", "(head ", " tail ", "(tail ", "fromJust"), above=3), "PanicPath", "Medium", (M,), "{n} partial function calls (head/tail/fromJust)"),
    Rule("W47", ("haskell",), Test(needles=('error "', 'error "', "undefined")), "PanicPath", "High", (C,), "{n} error/undefined"),
    Rule("W48", ("purescript",), Test(needles=("foreign import",), above=5), "UnsafeFFI", "Medium", (M,), "{n} foreign imports"),
    Rule("W49", ("purescript",), Test(any_of=("unsafeCoerce", "unsafePartial")), "UnsafeTypeCoercion", "High", (M,), "Unsafe coercion"),
    Rule("W50", ("idris",), Test(needles=("believe_me",)), "UnsafeCode", "Critical", (M,), "{n} believe_me (type checker bypass)"),
    Rule("W51", ("idris",), Test(any_of=("unsafePerformIO",)), "UnsafeCode", "High", (P,), "unsafePerformIO"),
    Rule("W52", ("lean",), Test(needles=("sorry",)), "UnsafeCode", "High", (C,), "{n} sorry (unproven proposition)"),
    Rule("W53", ("lean",), Test(any_of=("native_decide",)), "PanicPath", "Medium", (C, M), "native_decide"),
    Rule("W54", ("lean",), Test(any_of=("unsafeCast", "implementedBy")), "UnsafeTypeCoercion", "High", (M,), "Unsafe cast/implementedBy"),
    Rule("W55", ("agda",), Test(any_of=("trustMe", "primTrustMe")), "UnsafeCode", "High", (C,), "trustMe/primTrustMe (proof bypass)"),
    Rule("W56", _SYSTEM, Test(needles=("assert(", "assertz(", "asserta(", "retract(", "retractall("), above=5), "RaceCondition", "Medium", (P,), "{n} dynamic predicate modifications"),
    Rule("W57", _SYSTEM, Test(any_of=("shell(", "process_create(")), "CommandInjection", "High", (C, D), "Shell/process_create"),
    Rule("W58", ("zig",), Test(needles=("@intToPtr", "@ptrToInt", "@ptrCast")), "UnsafeCode", "High", (M,), "{n} unsafe pointer casts"),
    Rule("W59", ("ada",), Test(needles=("Unchecked_Conversion", "Unchecked_Deallocation", "Unchecked_Access")), "UnsafeCode", "High", (M,), "{n} Unchecked_* operations"),
    Rule("W60", ("ada",), Test(any_of=("pragma Suppress",)), "UnsafeCode", "High", (M, C), "pragma Suppress (runtime checks disabled)"),
    Rule("W61", ("odin",), Test(needles=("rawptr",)), "UnsafeCode", "Medium", (M,), "{n} rawptr usage"),
    Rule("W62", ("nim",), Test(any_of=("{.emit:", "{.emit.}")), "UnsafeCode", "Critical", (M, C), "emit pragma (raw code injection)"),
    Rule("W63", ("nim",), Test(needles=("cast[",)), "UnsafeTypeCoercion", "High", (M,), "{n} cast[] (unsafe coercion)"),
    Rule("W64", ("pony",), Test(pattern=r"@[a-zA-Z_]\w*\[", above=3), "UnsafeFFI", "Medium", (M,), "{n} FFI calls"),
    Rule("W65", ("dlang",), Test(needles=("@system",), above=5), "UnsafeCode", "Medium", (M,), "{n} @system functions"),
    Rule("W66", ("nix",), Test(any_of=("builtins.exec",)), "CommandInjection", "Critical", (C, D), "builtins.exec (command execution)"),
    Rule("W67", ("shell",), Test(any_of=("eval ", "eval\t")), "CommandInjection", "Critical", (C, D), "eval usage"),
    Rule("W68", ("shell",), Test(pattern=r"\$[A-Za-z_]\w*", above=20), "CommandInjection", "Medium", (C,), "{n} potentially unquoted variable expansions"),
    Rule("W69", ("shell",), Test(any_of=("chmod 777", "chmod a+w")), "ExcessivePermissions", "High", (D,), "World-writable permissions"),
    Rule("W70", ("shell",), Test(any_of=("deno run -A", "deno run --allow-all")), "ExcessivePermissions", "High", (N, D), "Deno -A (all permissions)"),
    Rule("W71", ("shell",), Test(any_of=("/tmp/",), unless=("mktemp",)), "PathTraversal", "Medium", (D,), "Hardcoded /tmp/ path without mktemp"),
    Rule("W72", ("julia",), Test(any_of=("eval(", "Meta.parse(")), "DynamicCodeExecution", "High", (C, M), "eval/Meta.parse"),
    Rule("W73", ("julia",), Test(needles=("ccall(", "@ccall")), "UnsafeFFI", "Medium", (M,), "{n} ccall/FFI calls"),
    Rule("W74", ("lua",), Test(any_of=("loadstring(", "dofile(")), "DynamicCodeExecution", "High", (C, M), "loadstring/dofile"),
    Rule("W75", ("lua",), Test(any_of=("os.execute(", "io.popen(")), "CommandInjection", "High", (C, D), "os.execute/io.popen"),
    Rule("W76", _DSL, Test(needles=("foreign", "external", "@ffi", "@native"), above=3), "UnsafeFFI", "Medium", (M,), "{n} FFI/external bindings"),
    Rule("W77", (), Test(pattern=HTTP, minus=LOCAL), "InsecureProtocol", "Medium", (N,), "{n} HTTP (non-HTTPS) URLs"),
    Rule("W78", (), Test(regex=SECRET), "HardcodedSecret", "Critical", (N,), "Possible hardcoded secret"),
    Rule("W79", (), Test(needles=("TODO", "FIXME", "HACK", "XXX"), above=10), "UncheckedError", "Low", (C,), "{n} TODO/FIXME/HACK markers"),
]

#: The same kinds of rules with needles that prose corpora hold.
CORPUS_COUNTERS: dict[str, dict[str, tuple[str, ...]]] = {
    "*": {"unsafe_blocks": ("!!",), "panic_sites": ("###",), "unwrap_calls": ("token", "secret"), "allocation_sites": ("%%%", "&&&"), "io_operations": ("http", "@"), "threading_constructs": (" | ",)},
    "rust": {"allocation_sites": ("thetion",)},
    "c": {"allocation_sites": ("ung ",)},
    "python": {"allocation_sites": ("eux ",), "threading_constructs": ("ment ",)},
    "elixir": {"threading_constructs": ("ción ",)},
}

CORPUS_RULES = [
    Rule("C01", (), Test(counter="unsafe_blocks"), "UnsafeCode", "High", (M, P), "{n} shouts"),
    Rule("C02", (), Test(counter="panic_sites", above=2), "PanicPath", "Medium", (M, D), "{n} hash runs"),
    Rule("C03", (), Test(any_of=("password", "passwd", "secret")), "HardcodedSecret", "Critical", (N,), "Secret word"),
    Rule("C04", (), Test(any_of=("token",), unless=("secret",)), "UnsafeDeserialization", "Low", (C, M), "Token without schema"),
    Rule("C05", (), Test(regex=r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), "InsecureProtocol", "Medium", (N,), "Address"),
    Rule("C06", ("rust",), Test(needles=("idiot", "stupid", "pathetic", "clown"), above=1), "UncheckedError", "Low", (C,), "{n} insults, known values"),
    Rule("C07", ("c", "python"), Test(counter="threading_constructs", above=5), "RaceCondition", "High", (P,), "{n} separators, no timeout"),
    Rule("C08", (), Test(regex=r"[a-z0-9.]+@[a-z0-9.]+"), "PathTraversal", "Medium", (D, N), "Mail address, no absolute path"),
    Rule("C09", (), Test(any_of=("license", "License", "Licence"), also_any=("copy", "Copy")), "ResourceLeak", "Low", (D,), "License lines, hardcoded"),
    Rule("C11", (), Test(any_of=("&&&",)), "CommandInjection", "High", (C,), "Predefined command mark"),
    Rule("C12", ("elixir",), Test(any_of=("###",)), "DeadlockPotential", "Medium", (P,), "Mark with a deadline"),
    Rule("C10", (), Test(counter="allocation_sites", above=4), "UncheckedAllocation", "Critical", (M,), "{n} marks, no null check"),
]
