"""Each finding rule and counter against rows written by hand: one hit and one near miss a rule."""

from __future__ import annotations

import time

import pytest

from tessera.functions import dims
from tessera.operators import findings as FD
from tessera.operators.packs import CODE_COUNTERS, CODE_RULES
from tessera.operators.rust_strings import stripper
from tessera.sources import bindings

# (rule, file name, text that breaks the rule, text that nearly does, description before " in ")
GOLDEN = [
    ("W01", "a.rs", "unsafe { x } unsafe fn f() {}", 'let s = "unsafe { x }"; // unsafe', "2 unsafe blocks"),
    ("W02", "a.rs", "a.unwrap().b.unwrap(); c.expect(1).expect(2).expect(3).unwrap()", 'a.unwrap().unwrap().unwrap().unwrap().unwrap(); ".unwrap()"', "6 unwrap/expect calls"),
    ("W03", "a.rs", "let y = transmute::<u8, i8>(x);", 'text.contains("transmute(")', "mem::transmute usage"),
    ("W04", "a.rs", "use std::mem; fn f() { forget(x) }", "forget(x)", "mem::forget usage (resource leak)"),
    ("W05", "a.rs", "x as *mut u8", 'r#"x as *mut u8"#', "Raw pointer cast"),
    ("W06", "a.c", "p = malloc(10) ;", "if (!(p = malloc(10))) return;", "Unchecked malloc"),
    ("W07", "a.h", "gets(line)", "get(line)", "gets() usage (unbounded buffer write)"),
    ("W08", "a.cc", "system(cmd)", "systems", "system() call (command injection risk)"),
    ("W09", "a.c", "sprintf(a, b)", "snprint(a)", "sprintf() usage (buffer overflow risk)"),
    ("W10", "a.c", "strcat(a, b)", "strncat(a, b)", "Unbounded string operation (strcpy/strcat)"),
    ("W11", "a.go", "go f()\n" * 11, "go f()\n" * 10, "11 goroutines spawned"),
    ("W12", "a.go", "unsafe.Pointer(p)", "unsafe.pointer", "unsafe.Pointer usage"),
    ("W13", "a.go", "exec.Command(x)", "exec.command", "exec.Command usage (command injection risk)"),
    ("W14", "a.py", "while True:\n pass", "while true:", "Unbounded while True loop"),
    ("W15", "a.py", "exec(x)", "exec (x)", "Dynamic code execution (eval/exec)"),
    ("W16", "a.py", "pickle.loads(x)", "pickle.dumps(x)", "pickle deserialization (arbitrary code execution)"),
    ("W17", "a.py", "os.popen(x)", "os.popen", "Shell command execution (os.system/os.popen)"),
    ("W18", "a.py", "subprocess.run(x, shell = True)", "subprocess.run(x, shell=False)", "subprocess with shell=True"),
    ("W19", "a.js", "eval(x)", "evals", "eval() usage"),
    ("W20", "a.js", "document.write(x)", "document.writeln(x)", "DOM manipulation (innerHTML/document.write)"),
    ("W21", "a.tsx", "dangerouslySetInnerHTML", "SetInnerHTML", "dangerouslySetInnerHTML (XSS risk)"),
    ("W22", "a.js", "deno run --allow-all x", "deno run --allow-net x", "Deno -A (all permissions)"),
    ("W23", "a.js", "JSON.parseExn(a); JSON.parseExn(b)", "JSON.parse(a)", "2 JSON.parseExn calls"),
    ("W24", "a.rb", "x.send(y)", "x.sends", "Dynamic code execution"),
    ("W25", "a.java", "Runtime.getRuntime().exec(x)", "Runtime.getRuntime()", "Runtime.exec()"),
    ("W26", "a.ex", "Code.eval_quoted(x)", "Code.eval", "Code.eval_string/eval_quoted"),
    ("W27", "a.ex", "String.to_atom(x)", "String.to_existing_atom(x)", "1 String.to_atom calls"),
    ("W28", "a.exs", "Port.open(x)", "Port.close(x)", "System command execution"),
    ("W29", "a.ex", "apply(m, f, a)", "apply(f, a)", "Dynamic apply/3"),
    ("W30", "a.erl", "list_to_atom(X), binary_to_atom(Y)", "list_to_existing_atom(X)", "2 unchecked atom creation"),
    ("W31", "a.erl", "os:cmd(X)", "os:getenv(X)", "os:cmd call"),
    ("W32", "a.gleam", "@external(a) " * 6, "@external(a) " * 5, "6 @external FFI calls"),
    ("W33", "a.res", "JSON.parseExn(x)", "JSON.parse(x)", "1 JSON.parseExn calls"),
    ("W34", "a.resi", "ignore(x) " * 4, "ignore(x) " * 3, "4 ignore() calls"),
    ("W35", "a.res", "getExn(x) getOrExn(y)", "get(x) unsafe_get(y)", "2 unsafe get calls"),
    ("W36", "a.ml", "Obj.magic x", "obj.magic x", "Obj.magic (unsafe type coercion)"),
    ("W37", "a.ml", "Obj.repr x", "Obj.reachable_words x", "Obj.repr (unsafe representation access)"),
    ("W38", "a.mli", "Marshal.from_channel c", "Marshal.to_channel c", "Unsafe Marshal deserialization"),
    ("W39", "a.ml", "Unix.execvp x", "Unix.fork ()", "Unix.system/execvp command execution"),
    ("W40", "a.sml", "Unsafe.sub MLton.Pointer.t", "unsafe.sub", "2 unsafe operations"),
    ("W41", "a.scm", "(eval\nx)", "(evaluate x)", "eval usage"),
    ("W42", "a.rkt", "(process x)", "(processor x)", "System/process call"),
    ("W43", "a.ss", "call/cc " * 4, "call/cc " * 3, "4 call/cc usage"),
    ("W44", "a.hs", "unsafePerformIO x", "performIO x", "1 unsafePerformIO"),
    ("W45", "a.hs", "unsafeCoerce x", "coerce x", "1 unsafeCoerce"),
    ("W46", "a.hs", "(head x) tail y fromJust z (tail q)", "(head x) tail y fromJust z", "4 partial function calls (head/tail/fromJust)"),
    ("W47", "a.hs", 'error "no" undefined', "error no", "3 error/undefined"),
    ("W48", "a.purs", "foreign import a\n" * 6, "foreign import a\n" * 5, "6 foreign imports"),
    ("W49", "a.purs", "unsafePartial x", "partial x", "Unsafe coercion"),
    ("W50", "a.idr", "believe_me x", "believe x", "1 believe_me (type checker bypass)"),
    ("W51", "a.idr", "unsafePerformIO x", "unsafePerform x", "unsafePerformIO"),
    ("W52", "a.lean", "sorry sorry", "sory", "2 sorry (unproven proposition)"),
    ("W53", "a.lean", "native_decide", "decide", "native_decide"),
    ("W54", "a.lean", "implementedBy", "implemented_by", "Unsafe cast/implementedBy"),
    ("W55", "a.agda", "primTrustMe and trustMe", "trustme", "trustMe/primTrustMe (proof bypass)"),
    ("W56", "a.pl", "assertz(a). " * 3 + "retract(b). " * 3, "assertz(a). " * 5, "6 dynamic predicate modifications"),
    ("W57", "a.lgt", "process_create(x)", "process_wait(x)", "Shell/process_create"),
    ("W58", "a.zig", "@ptrCast(x) @ptrToInt(y)", "@intCast(x)", "2 unsafe pointer casts"),
    ("W59", "a.adb", "Unchecked_Access", "Unchecked", "1 Unchecked_* operations"),
    ("W60", "a.ads", "pragma Suppress (All)", "pragma Inline", "pragma Suppress (runtime checks disabled)"),
    ("W61", "a.odin", "p: rawptr", "p^", "1 rawptr usage"),
    ("W62", "a.nim", "{.emit: x.}", "{.inline.}", "emit pragma (raw code injection)"),
    ("W63", "a.nim", "cast[int](x)", "cast(x)", "1 cast[] (unsafe coercion)"),
    ("W64", "a.pony", "@f[U8]() @g[U8]() @h[U8]() @i[U8]()", "@f[U8]() @g[U8]() @h[U8]() @i()", "4 FFI calls"),
    ("W65", "a.d", "@system " * 6, "@system " * 5, "6 @system functions"),
    ("W66", "a.nix", "builtins.exec [ x ]", "builtins.toString x", "builtins.exec (command execution)"),
    ("W67", "a.sh", "eval\t$x", "evaluate", "eval usage"),
    ("W68", "a.sh", " ".join(f"$v{k}" for k in range(21)), " ".join(f"$v{k}" for k in range(20)), "21 potentially unquoted variable expansions"),
    ("W69", "a.bash", "chmod a+w f", "chmod 755 f", "World-writable permissions"),
    ("W70", "a.zsh", "deno run -A x", "deno run x", "Deno -A (all permissions)"),
    ("W71", "a.sh", "cat /tmp/x", "f=$(mktemp /tmp/x)", "Hardcoded /tmp/ path without mktemp"),
    ("W72", "a.jl", "Meta.parse(x)", "parse(x)", "eval/Meta.parse"),
    ("W73", "a.jl", "@ccall f()", "call(f)", "1 ccall/FFI calls"),
    ("W74", "a.lua", "dofile(x)", "loadfile(x)", "loadstring/dofile"),
    ("W75", "a.lua", "io.popen(x)", "io.lines(x)", "os.execute/io.popen"),
    ("W76", "a.woke", "foreign external @ffi @native", "foreign external @ffi", "4 FFI/external bindings"),
    ("W77", "a.txt", "http://a.b http://localhost:80/x http://[::1]/ http://c", "http://localhost:80/x http://0.0.0.0", "1 HTTP (non-HTTPS) URLs"),
    ("W78", "a.txt", "Passwd = 'hunter2hunter2", "token = 'hunter2hunter2'", "Possible hardcoded secret"),
    ("W79", "a.txt", "TODO FIXME HACK XXX " * 2 + "TODO TODO XXX", "TODO FIXME HACK XXX " * 2 + "TODO TODO", "11 TODO/FIXME/HACK markers"),
]

# (file name, text, unsafe blocks, panics, unwraps, allocations, io, threads)
COUNTED = [
    ("a.rs", 'unsafe { panic!("unsafe { }") } Vec::new() std::fs::x std::sync::y std::thread::z tokio::spawn', (1, 1, 0, 1, 1, 2)),
    ("a.scm", "open-input-file call-with-output-file", (0, 0, 0, 0, 2, 0)),
    ("a.hs", 'unsafeCoerce (head x) error "a" readFile forkIO MVar', (1, 2, 1, 0, 1, 2)),
    ("a.res", "@val external getUnsafe(x) JSON.parseExn(y) ref(z) Deno.readTextFile", (1, 1, 1, 1, 1, 0)),
    ("a.agda", "trustMe trustMe primTrustMe {-# FOREIGN", (2, 0, 0, 0, 0, 0)),
    ("a.odin", "rawptr #force_inline #force_no_inline foreign import make( os.read thread.create", (3, 0, 0, 1, 1, 1)),
    ("a.nim", "unsafeAddr unsafeAddr alloc( spawn f", (1, 0, 0, 1, 0, 1)),
    ("a.pony", "@f[U8]() recover actor X", (2, 0, 0, 0, 0, 1)),
    ("a.d", "@system @trusted __traits new X std.stdio std.concurrency spawn(f)", (3, 0, 0, 1, 1, 2)),
    ("a.nix", "import ./x fetchurl fetchGit", (0, 0, 0, 0, 3, 0)),
    ("a.ncl", "import x", (0, 0, 0, 0, 1, 0)),
    ("a.zig", "allocator.create std.fs.x std.Thread unreachable", (0, 1, 0, 1, 1, 1)),
    ("a.dl", "call(x) open(y)", (0, 0, 0, 1, 1, 0)),
    ("a.ecl", "budget unsafe " + "read " * 12, (1, 0, 0, 1, 10, 0)),
    ("a.woke", "budget external " + "write " * 3, (1, 0, 0, 0, 3, 0)),
    ("a.jl", "Array{Int} @spawn Threads.@threads unsafe_load", (1, 0, 0, 1, 0, 2)),
    ("a.xyz", "alloc open thread", (0, 0, 0, 1, 1, 1)),
]


def _files(spark, rows):
    return FD.count_constructs(FD.with_code(bindings.with_language(dims.values(spark, "repo, path, content", rows))), CODE_COUNTERS)


def test_every_rule_has_a_row():
    assert [g[0] for g in GOLDEN] == [r.id for r in CODE_RULES]


def test_rules(spark):
    rows = [(rule, f"{which}/{name}", text) for rule, name, hit, miss, _ in GOLDEN for which, text in (("hit", hit), ("miss", miss))]
    found = {(r.repo, r.file): r for r in FD.find(_files(spark, rows), CODE_RULES).collect() if r.repo == r.rule}
    adds = {r.id: r.adds for r in CODE_RULES}
    for rule, name, _, _, says in GOLDEN:
        assert found[(rule, f"hit/{name}")].description == f"{says} in hit/{name}{adds[rule]}", rule
        assert (rule, f"miss/{name}") not in found, rule


def test_counters(spark):
    found = {r.path: tuple(r[c] for c in FD.COUNTERS) for r in _files(spark, [("r", name, text) for name, text, _ in COUNTED]).collect()}
    assert found == {name: counts for name, _, counts in COUNTED}


def test_rules_take_linear_time(spark):
    """A shell file of 10,000 variables, and a file of 10,000 foreign calls."""
    began = time.perf_counter()
    files = _files(spark, [("r", "a.sh", " x ".join(f"$v{k}" for k in range(10_000))), ("r", "a.pony", " ".join("@f[U8]()" for _ in range(10_000)))])
    assert {r.rule for r in FD.find(files, CODE_RULES).collect()} >= {"W68", "W64"}
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize(
    ("source", "left"),
    [
        ('f("unsafe {")', 'f("")'), (r'a("x\"y") b', 'a("") b'), ('r#"a "quoted" b"# c', 'r#" "# c'), ('br"a" c', 'br" " c'), ("'\"' \"x\"", "'\"' \"\""),
        ("&'a str \"x\"", "&'a str \"\""), (r"'\u{41}' '\''", r"'\u{41}' '\''"), ('r#"open', 'r#"open'), ('"open', '""'), ("// it's \"a\"", "// it's \"\""), ("", ""),
    ],
)
def test_emptied_rust_strings(source, left):
    assert stripper()(source) == left
