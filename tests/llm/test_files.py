import pytest

from quillspan.llm import docpairs, handwritten, printer, syntax


def test_reasons(spark):
    rows = [
        (1, "r", "src/generated/a.ts", 100, 5), (2, "r", "src/generators/a.ts", 400, 10), (3, "r", "vendor/a/b.py", 400, 10), (4, "r", "src/vendor-portal/b.py", 400, 10), (5, "r", "public/x.min.js", 9000, 1),
        (6, "r", "src/data/x.ts", 60_000, 6_000), (7, "r", "src/a.ts", None, None), (8, "r", "src/a.md", 9000, 1), (9, "r", None, 1, 1), (10, "r", "src/y-1.2.3/a.js", 400, 10), (11, "r", "src/z.js", 90_000, 0), (2, "r", "src/generators/a.ts", 400, 10),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, bytes bigint, loc bigint").selectExpr("*", "'x' as reason", "1 as n_chars")
    got = {r.file_id: r.reason for r in handwritten.not_handwritten(df).collect()}
    assert got == {1: "generated", 2: None, 3: "vendored", 4: None, 5: "minified", 6: "data", 7: None, 10: "vendored", 11: "minified"}
    texts = spark.createDataFrame([("r", "src/a.ts", "var a=1;" * 400), ("r", "src/generators/a.ts", None)], "repo string, path string, content string")
    assert {r.file_id: r.reason for r in handwritten.not_handwritten(df, texts).collect()}[7] == "minified"
    assert handwritten.not_handwritten(df.limit(0), texts).count() == 0


SAYS = [
    ("/** Returns the cached rows that are older than a day. */", "go", True), ("/** TODO: The loader must keep its order for replays. */", "go", True), ("// Prüft, ob größere Pakete geteilt werden.", "go", True),
    ("/** Internal. Reviewers asked why this is cached. */", "go", True), ("/** @param x the value\n * @returns a thing */", "go", False), ("/** loadUserData() */", "loadUserData", False), ("/** Loads the user data. */", "loadUserData", False),
    ("// eslint-disable-next-line", "go", False), ("/** ======================== */", "go", False), ("/** TODO */", "go", False), ("/** Summary goes here */", "go", False), ("No description", "go", False), ("{@inheritDoc}", "go", False), ("", "go", False),
    (None, "go", False), ("/** @description Keeps the newest entry of every key. */", "go", True), ("/** 日本語の説明文です */", "go", True), ("n/a", "go", False),
]


@pytest.mark.parametrize("doc,name,want", SAYS)
def test_what_documentation_says(doc, name, want):
    assert docpairs.says_something(doc, name) is want


def test_pairs(spark):
    doc = "/** Keeps the newest entry of every key. */"
    rows = [
        (1, "f", doc, "export function f(a: X): Y {\n  return a;\n}", "a.ts"), (2, "f", doc, "export declare function f(a: X): Y;", "a.ts"), (3, "I", doc, "export interface I {\n a: 1;\n}", "a.ts"), (4, "g", doc, "const g = async (a): Promise<X> => {\n}", "a.ts"),
        (5, "C", doc, "export const C = 5;", "a.ts"), (6, "h", None, doc + "\n@dec()\nprivate async h() {\n  go();\n}", "a.ts"), (7, "p", None, 'def p(x):\n    """Keeps the newest entry of every key."""\n    return x\n', "a.py"), (8, "p", doc, "def p(x):\n    ...\n", "a.py"),
        (9, "f", " ", doc + "\nfunction f() { }", "a.ts"), (10, "f", doc, None, "a.ts"), (11, "f", doc, " \n", None), (12, None, doc, "function f() { run(); }", None), (13, "f", None, "function f() {\n  // Keeps the newest entry of every key.\n}", "a.ts"),
        (14, "f", None, doc + "\nlet x = 1;\nfunction f() { }", "a.ts"), (15, "f", doc, "function f(a: { b: string }): { c: number } {\n}", "a.ts"), (16, "f", doc, "function f(): { c: number };", "a.ts"), (1, "f", doc, "export function f(a: X): Y {\n  return a;\n}", "a.ts"),
    ]
    df = spark.createDataFrame(rows, "slice_id bigint, symbol_name string, doc string, body string, path string").selectExpr("*", "1 as comments", "2 as f")
    got = sorted(r.slice_id for r in docpairs.documented_functions(df).collect())
    assert got == [1, 1, 4, 6, 7, 12, 15]
    assert docpairs.documented_functions(df.limit(0)).count() == 0


VALID = {
    "ts": [
        "import a, { b as c, type D } from './x';\nexport * from 'y';\nexport type T<A, B = A> = { [K in keyof A]?: B } | string[] & Map<string, number>;",
        "export abstract class A<T> extends B<T> implements C {\n  private readonly x: number = 1;\n  static #y?: string;\n  constructor(private a: string, ...r: T[]) { super(a); }\n  get v(): T { return this.x as unknown as T }\n  async *g() { yield* a?.b?.[0]?.(1) ?? c; }\n  abstract z(): void;\n}",
        "for (const [a, { b, ...c }] of Object.entries(x)) if (a) go(); else { stop() }\nlabel: while (true) { break label }\ndo { i++ } while (i < 3)\nswitch (x) { case 1: a(); break; default: b() }",
        "const re = /[{(\\[]+x/g.test(s) ? `a${b ? `${c}` : '}'}d` : 1_000n;\nlet f = async <T,>(x: T): Promise<T> => x!;\nfunction isX(a: any): a is X { return a satisfies X; }",
        "enum E { A = 1, B }\ndeclare module 'm' { export const x: number; }\nnamespace N.M { let a; }\ninterface I extends J<K>, L { (x: number): string; new (): I; readonly [k: string]: any; m?(): void }",
        "﻿const a = b < c || d > (e);\nif (!a) throw new Error('x');\nreturn_\n  .then(x => ({ ...x, y }))\n  .catch(() => {});", "// <<<<<<< HEAD\nlet s = '=======';\n/* >>>>>>> x */", "",
        "let x = a ? (b) : c => d;\nlet v: typeof import('m');\nfunction assert(x: unknown): asserts x is string;\nexport default class {}",
    ],
    "js": ["export default async function* f({ a = 1, b: [c] } = {}, ...d) { try { await x } catch { } finally { } }\nvar o = { get a() { return 1 }, set a(v) { }, async *[b]() { }, 'c': 1, 2: 3, d };", "#!/usr/bin/env node\nimport x from 'y' with { type: 'json' };\nnew.target;\na = b ? c : d, e ||= f ** g"],
    "tsx": ["const a = (\n  <div className=\"x\" {...p} on={() => go(<b/>)}>\n    it's {x && <></>} text > no\n  </div>\n);".replace(" > no", ""), "function f<T,>(x: T) { return <A.B<string> a='1' /> }".replace("<string>", "")],
    "py": ["def f(a, /, b: int = 1, *c, d, **e) -> int:\n    return [x async for x in y if z], {**a, 'b': 1}, {*c}, a[1:2, ...]\n", "@d.e(1)\nclass A(B, metaclass=C):\n    x: int = 1\n    async def f(self): await x; return\n\nmatch x:\n    case [1, *_] | {'a': b} if c:\n        pass\nelse_ = lambda *a, k=1: (yield)\n", "with (open(a) as b, c): pass\ntry:\n    x = y = 1\nexcept* (A, B) as e:\n    raise E from e\nelse:\n    del a[0]\nfinally:\n    print(f'{x!r:>{w}}')\n", "type X[T] = list[T]\nif (n := 1) not in b: global q\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', "3", "[]"],
}
BROKEN = {
    "ts": ["function f( {\n", "const a = ;", "let a = 1\nlet const b", "<<<<<<< HEAD\nlet a;\n=======\nlet b;\n>>>>>>> x\n", "if (a {\n}\n", "const x = {a: 1,, b: 2};", "class A { foo( { } }", "def f(x):\n    return x\n", "let s = 'abc\n;", "a b c", "const t = `${a b}`;", "return (1"],
    "js": ["let a: string = 'x';", "interface A { }", "const a = <div/>;", "x as y"], "tsx": ["const a = <div><b></div>;", "const a = <div>{a b}</div>;"],
    "py": ["def f(:\n    pass\n", "if x\n    y\n", "def f():\nreturn 1\n", "  x = 1\n", "x = (1\n", "print 'x'\n", "else:\n    x\n", "a = = b\n", "\tif x:\n\t\ty\n    z\n"],
    "json": ["{'a': 1}", '{"a": 1,}', "[1 2]", "// x\n{}", '{"a": NaN}', "", '{"a": 01}', '{"a"'],
}


@pytest.mark.parametrize("suffix", VALID)
def test_valid_sources(suffix):
    for t in VALID[suffix]:
        assert syntax.check(t, suffix)[0] == 0, t


@pytest.mark.parametrize("suffix", BROKEN)
def test_broken_sources(suffix):
    for t in BROKEN[suffix]:
        assert syntax.check(t, suffix)[0] > 0, t


def test_python_and_json_agree_with_full_parsers():
    import ast
    import json

    import pandas as pd

    def no_constant(_):
        raise ValueError

    d = pd.read_parquet("/root/testdata/sf0.01/paste_files.parquet", columns=["path", "content"])
    n = 0
    for path, text in zip(d.path, d.content, strict=True):
        suffix = path.rsplit(".", 1)[-1]
        if text and suffix in ("py", "json"):
            try:
                ast.parse(text) if suffix == "py" else json.loads(text, parse_constant=no_constant)
                valid = True
            except (SyntaxError, ValueError):
                valid = False
            assert (syntax.check(text, suffix)[0] == 0) == valid, path
            n += 1
    assert n > 100


def test_causes_and_rates(spark):
    rows = [(1, "r", "a.ts", "let a = 1;\nfunction f() {\n  if (x) {\n"), (2, "r", "a.ts", "let a;\n<<<<<<< HEAD\nlet b;\n=======\nlet c;\n>>>>>>> q\n"), (3, "r", "b.TS", "let a"), (4, "r", "c.md", "x"), (5, None, "d.json", "{}"), (6, "r", "e.ts", None), (7, "r", "e.ts", ""), (8, "r", None, "x")]
    df = spark.createDataFrame(rows, "paste_id bigint, repo string, path string, content string").selectExpr("*", "1 as valid", "2 as i")
    c = syntax.unparsable(df)
    got = {r.paste_id: (r.valid, r.cause) for r in c.collect()}
    assert got == {1: (False, "truncated"), 2: (False, "conflict"), 5: (True, None)}
    assert {(r.repo, r.language): r.rate for r in syntax.invalid_rates(c).collect()} == {("r", "ts"): 1.0, (None, "json"): 0.0}


def test_conflicts_show_by_where_the_edits_stand():
    marked = "let a;\n<<<<<<< HEAD\nlet b;\n=======\nlet c;\n>>>>>>> q\n"
    assert syntax.cause(marked, *syntax.check(marked, "ts")) == "conflict"
    quoted = "/*\n<<<<<<< HEAD\n*/\n" + "let y = z;\n" * 60 + "function f() {\n"
    assert syntax.cause(quoted, *syntax.check(quoted, "ts")) == "truncated"


def test_partners_are_sought_at_any_depth():
    deep = "f(" * 400 + "[" + "{ a: " * 0 + "1" + ")" * 400 + ";"
    assert syntax.check(deep, "js")[0] >= 1
    assert syntax.check("(" * 300 + "a" + ")" * 300 + ";", "js") == (0, [])
    stray = "g({\n" + "  h(\n" * 80 + "}\n);\n"
    assert syntax.check(stray, "js")[0] >= 1


def test_least_cost():
    assert syntax.check("foo(1;\n", "ts")[0] >= 1 and syntax.check("const a = b c;\n", "ts")[0] == 1


def test_cost_and_place_inside_brackets():
    pad = "let y = z;\n" * 30
    for text, suffix, cost, low, high in [
        ("function f() {\n  const a = ;\n  let x = {a: 1,, b: 2};\n}\n", "ts", 2, 0.3, 0.4), (f"function f() {{\n{pad}  const a = ;\n}}\n", "ts", 1, 0.95, 0.999), (f"function f() {{\n  a b;\n{pad}}}\n", "js", 1, 0.0, 0.1),
        ("a = " + "b + " * 300 + "c c;\nd();\n", "js", 1, 0.98, 0.999), ("a = " + "b + " * 200 + "c c\n", "py", 1, 0.99, 1), ('{"a": [1 2, {"b": }]}', "json", 2, 0.3, 0.5), (f"{pad}const t = `${{a b c}}`;\n{pad}", "ts", 1, 0.4, 0.6),
        ("a(" + "b, " * 300 + "(c d e f g));", "js", 2, 0.98, 1), ("def f(:\n    pass\nx = 1\n", "py", 1, 0.2, 0.4), (f"if (a {{\n}}\n{pad}", "ts", 1, 0, 0.1),
    ]:
        got, places = syntax.check(text, suffix)
        assert got == cost and low <= min(places) <= high, (text, got, places)
    spread = "function f() {\n" + "  a b;\n" * 5 + pad + "  c d;\n}\n"
    assert syntax.cause(spread, *syntax.check(spread, "ts")) == "mismatch"


def test_long_bodies_are_parsed_whole():
    row = "if (a) b(); else c();\n"
    for text, suffix in [
        ("function f() {\n" + row * 1000 + "}\n", "js"), (row * 1000, "ts"), ("f(" + "a + b, " * 1500 + "new Map<a, b>(),\n);", "ts"), ("class A {\n" + "x = 1;\n" * 1500 + "m() { }\n}\n", "ts"), ("x = [" + "a + b, " * 1500 + "lambda a, b: c, ]\n", "py"),
    ]:
        assert syntax.check(text, suffix) == (0, []), text[:40]
        assert syntax.check(text.replace("a", "a a", 1) if suffix != "py" else text.replace("c, ]", "c c, ]"), suffix)[0] > 0, text[:40]


def test_statements_do_not_begin_with_objects():
    for text in ['{\n  "name": "x",\n  "deps": { "a": [1, true] }\n}\n', "a => { 'b': 1, c: 2 };", "{ a: 1, b: 2 }.c;", "if (x) { 'a': 1 }"]:
        assert syntax.check(text, "ts")[0] > 0 and syntax.check(text, "js")[0] > 0, text
    for text in ["({ 'a': 1 });", "a = { 'b': 1, c };", "a => ({ 'b': 1 });", "export default { 'a': 1, b() { } };", "{ a; { b: c } }", "x => { b: c };", "return_ = x || { a: 1, b: 2 };", "a[{ b: 1, c: 2 }.b]++, { d: 1, e: 2 };", "label: { a(); break label }"]:
        assert syntax.check(text, "ts")[0] == 0 and syntax.check(text, "js")[0] == 0, text


def test_canonical_layout_does_not_depend_on_the_original():
    wide = "import { a, b } from 'x';\nexport function f(a: B): C {\n  // why\n  if (a) {\n    b();\n  } else {\n    c();\n  }\n  for (let i = 0; i < n; i++) go(i, { a: 1 });\n  return { a: 1, b };\n}\n"
    flat = " ".join(x.strip() for x in wide.replace("  // why\n", "").split("\n"))
    a, b = printer.canonical(wide, False), printer.canonical(flat, False)
    assert a.lines == b.lines and len(a.lines) == 10 and (a.n_lines, b.n_lines) == (10, 1)
    assert a.expansion == 1 and b.expansion == 10
    spread = "const x = [\n" + "".join(f"  {i},\n" for i in range(90)) + "];\n"
    assert printer.canonical(spread, False).lines == printer.canonical(spread.replace("\n", " "), False).lines and printer.canonical(spread, False).literal_share > 0.95
    py = printer.canonical("def f(a):\n    x = [1,\n      2]\n    return a; b\n", True)
    assert len(py.lines) == 4 and py.n_lines == 4
    for text in ["", "((({", "}})", "'", "/* a", "\x00", "`${", "a" * 100_000, "{" * 3000, "é = ü\n" * 50]:
        for python in (False, True):
            x = printer.canonical(text, python)
            assert x.expansion >= 0 and 0 <= x.uniformity <= 1 and 0 <= x.literal_share <= 1


def test_layout_is_compared_over_the_whole_text():
    head = "".join(f"export function go() {{ return a{'.b' * i}; }}\n" for i in range(410))
    table = "row(1, 'a');\nput(x);\n"
    assert printer.canonical(head + table * 4000, False).uniformity > 0.8
    assert printer.canonical(table * 200 + head, False).uniformity < 0.8


def test_reasons_by_layout(spark):
    hand = "export function f(a: B): C {\n  if (!a.b) throw new Error('x');\n  const c = a.d.filter((x) => g(x, 3));\n  return c.length > 4 ? h(c) : null;\n}\n\nexport class K {\n  m(x: number) {\n    return x * 2;\n  }\n}\n"
    texts = [
        ("r", "src/hand.ts", hand + "// a longer remark about the code, which says why it stands here\n" * 10), ("r", "src/chained.js", "var a=1," + ",".join(f"b{i}=function(q){{return q*{i},q}}" for i in range(60))),
        ("r", "src/types.ts", "".join(f"export type A{i} = {{\n  kind: 'A{i}';\n  value: string | null;\n}};\n" for i in range(30))), ("r", "src/table.ts", "export const T = [\n" + "  12345, 67890,\n" * 300 + "];\n"),
        ("r", "lib/table.py", "T = (" + "'abcdef', 0x12, " * 300 + ")\n"), ("r", "src/short.ts", "a(1);a(1);a(1);"), ("r", "dist/hand.js", hand.replace(": B", "").replace(": C", "")), ("r", "vendor/types.ts", "x"),
    ]
    texts += [("r", "src/hand.ts", "a"), ("r", "src/none.ts", None), ("r", None, "x")]
    t = spark.createDataFrame(texts, "repo string, path string, content string").selectExpr("*", "1 as n_chars", "'x' as reason")
    f = spark.createDataFrame([(i, "r", p, 1000, 30) for i, p in enumerate(sorted({p for _, p, _ in texts if p}))], "file_id bigint, repo string, path string, bytes bigint, loc bigint")
    got = {r.path: (r.reason, r.evidence, r.has_text) for r in handwritten.not_handwritten(f, t).collect()}
    assert got == {
        "src/hand.ts": (None, None, True), "src/chained.js": ("minified", "layout", True), "src/types.ts": ("generated", "layout", True), "src/table.ts": ("data", "layout", True), "lib/table.py": ("data", "layout", True),
        "src/short.ts": (None, None, True), "dist/hand.js": ("minified", "path", True), "vendor/types.ts": ("vendored", "path", True), "src/none.ts": (None, None, False),
    }
    assert sum(r.n_files for r in handwritten.evidence_counts(handwritten.not_handwritten(f, t)).collect()) == 9


def test_directives_do_not_hide_the_comment_before_them(spark):
    doc = "/** Keeps the newest entry of every key. */\n"
    idle = ["// eslint-disable-next-line no-x\n", "// @ts-ignore\n", "/* prettier-ignore */\n", "/* ======== */\n", "/* TODO */\n"]
    rows = [(i, "f", None, doc + x + "function f() {\n  go();\n}", "a.ts") for i, x in enumerate(idle)]
    rows += [(10, "f", None, doc + "/** @param a the value */\nfunction f(a) {\n  go();\n}", "a.ts"), (11, "f", None, doc + "let x = 1;\n// @ts-ignore\nfunction f() {\n  go();\n}", "a.ts")]
    df = spark.createDataFrame(rows, "slice_id bigint, symbol_name string, doc string, body string, path string")
    assert sorted(r.slice_id for r in docpairs.documented_functions(df).collect()) == [0, 1, 2, 3, 4]


def test_every_function_of_a_text_is_paired(spark):
    doc, other = "/** Keeps the newest entry of every key. */\n", "/** Drops the entries that nobody has read. */\n"
    script = (
        f"// Notes on the module, which no function owns.\nimport x from 'y';\n\n{doc}export const keep = async (a): Promise<X> => {{\n  // Sorts before the entries are kept.\n  function inner() {{ return 1; }}\n}};\n\n"
        f"@Dec({{\n  a: 1,\n}})\nexport class Store {{\n  {other}  @Log()\n  private drop<T>(a: {{ b: T }}): {{ c: T }} {{\n    return /[{{]/.test(a) ? `${{a}}}}` : a;\n  }} // Says why after the brace has closed.\n\n  plain() {{ }}\n\n"
        f"  {doc}  value = 1;\n  late() {{ return 2; }}\n  // Tells which of the entries is the last one.\n  // It is read from the index.\n  last() {{ }}\n}}\nlet z = 1; {doc}function tail() {{ }}\n{other}function declared(): void;\nfunction free() {{ }}\n"
    )
    python = (
        "import os\n\n# Keeps the newest entry of every key.\n@wrap(\n    a=1,\n)\ndef keep(x):\n    # Sorts before the entries are kept.\n    def inner(): return 1\n    return x\n\nclass A:\n    '''Holds the entries that are kept.'''\n\n"
        "    def drop(self):\n        '''Drops the entries that nobody has read.'''\n        return {'a': '''\ndef no(): pass'''}\n\n    def empty(self):\n        '''Drops the entries that nobody has read.'''\n        ...\n\n    x = 1  # Counts the entries that were read.\n    def plain(self): return 2\n"
    )
    rows = [(1, "given", "/** Says more about what is given here. */", script, "a.ts"), (2, None, None, python, "b.py"), (3, "f", None, script.replace("\n", "\r\n"), "a.ts"), (4, "f", None, doc + "function f() { }\n" + other + "function g() { }", "a.js"), (5, "f", None, "/* a", "a.js")]
    df = spark.createDataFrame(rows, "slice_id bigint, symbol_name string, doc string, body string, path string").selectExpr("*", "1 as row", "'x' as code")
    got = sorted((r.slice_id, r.symbol_name, r.symbol_kind, r.is_slice, r.description) for r in docpairs.documented_functions(df).collect())
    a, b, c = "Keeps the newest entry of every key.", "Drops the entries that nobody has read.", "Tells which of the entries is the last one.\nIt is read from the index."
    script_pairs = [("drop", "method", False, b), ("keep", "const", False, a), ("last", "method", False, c)]
    assert got == [(1, *x) for x in script_pairs] + [(2, "drop", "method", False, b), (2, "keep", "function", False, a)] + [(3, *x) for x in script_pairs] + [(4, "f", "function", True, a), (4, "g", "function", False, b)]
    code = {r.symbol_name: r.code for r in docpairs.documented_functions(df).orderBy("slice_id", ascending=False).where("slice_id < 3").collect()}
    code["keep"] = next(r.code for r in docpairs.documented_functions(df.where("slice_id = 2")).where("symbol_name = 'keep'").collect())
    assert code["last"] == "last() { }" and code["keep"].startswith("def keep(x):\n") and code["keep"].rstrip().endswith("return x")


def test_spans_are_linear_in_the_text():
    import time

    text = "/** Keeps the newest entry of every key. */\nfunction f(a: { b: string }) {\n  if (a) { b(); }\n}\n" * 20_000
    began = time.perf_counter()
    c, f, s = docpairs.extract(text, False)
    assert len(c) == len(f) == 20_000 and time.perf_counter() - began < 20
    c, f, s = docpairs.extract("# Keeps it.\ndef f(a):\n    return a\n" * 20_000, True)
    assert len(c) == len(f) == 20_000


def test_batches_without_functions_or_comments(spark):
    schema = "slice_id bigint, symbol_name string, doc string, body string, path string"
    says = "/** Keeps the newest entry of every key. */"
    for rows, want in [
        ([(1, None, None, "/* a", "a.ts")], []), ([(1, None, says, "x", None)], []), ([(1, None, says, "function f() { go(); }", "a.ts")], [1]), ([(1, None, None, "interface I { a: string; }", "a.ts"), (2, None, says, "export interface I { }", "a.ts")], []),
        ([(1, None, None, "# only words\n", "a.py"), (None, None, None, "def f(): return 1", "a.py")], []), ([(1, "f", None, says + "\n" + "x" * 200_000 + "\nfunction f() { go(); }", "a.ts"), (2, "f", says, "function f() { go(); }" + " " * 200_000, "a.ts")], [2]),
    ]:
        df = spark.createDataFrame(rows, schema).coalesce(1)
        assert [r.slice_id for r in docpairs.documented_functions(df).collect()] == want, rows[0][3][:30]
