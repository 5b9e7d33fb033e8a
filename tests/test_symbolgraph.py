import random

from quillspan.operators import scoped, symbolgraph

EDGE = "repo string, src string, dst string, kind string"


def test_symbols_and_references(spark):
    text = (
        "import { a as b } from './x';\n\nexport default async function load(x: T): Promise<Rows> {\n  // ghost();\n  const y = 'call(me)';\n  b(y).then(keep);\n  if (y) return make(y);\n}\n/**\n * other();\n */\n"
        "export abstract class Store<T> extends Base<T> implements One, Two<A, B> {\n  get() { return load(1); }\n}\ninterface Rows extends One, Three { }\r\nconst inner = 1;\n  const nested = 2;\n"
    )
    df = spark.createDataFrame([("r", "a.ts", text), ("r", "b.ts", None), ("r", "c.ts", ""), ("r", "d.ts", "no(symbols)")], "repo string, path string, content string").selectExpr("*", "1 as line", "'x' as symbol")
    got = {r.symbol: r for r in symbolgraph.symbols(df, ["repo", "path"]).collect()}
    assert {k: (r.kind, r.line, r.end_line, r.exported) for k, r in got.items()} == {"load": ("function", 3, 11, True), "Store": ("class", 12, 14, True), "Rows": ("interface", 15, 15, False), "inner": ("const", 16, 18, False)}
    refs = {k: {(x.kind, x.name) for x in r.refs} for k, r in got.items()}
    assert refs["load"] == {("typeRef", "Promise"), ("typeRef", "Rows"), ("calls", "b"), ("calls", "then"), ("calls", "make")} - {("calls", "then")}
    assert refs["Store"] == {("extends", "Base"), ("implements", "One"), ("implements", "Two"), ("calls", "get"), ("calls", "load")} and refs["Rows"] == {("extends", "One"), ("extends", "Three")}
    assert symbolgraph.symbols(df.limit(0), ["repo", "path"]).count() == 0


def test_names_lead_through_imports(spark):
    f = spark.createDataFrame([("r", "src/x.ts", "export const a = 1;\nfunction own() { }\n"), ("r", "src/y.ts", "import { a as b } from './x';\nimport * as all from './x.js';\nfunction go() {\n  b();\n  own();\n  go();\n}\nfunction own() { }\n")], "repo string, path string, content string")
    e = symbolgraph.symbol_edges(symbolgraph.symbols(f, ["repo", "path"]), symbolgraph.import_bindings(f))
    assert sorted((r.src, r.dst, r.kind, r.weight, r.reason) for r in e.collect()) == [("src/y.ts#go", "src/x.ts#a", "calls", 3.0, "direct-call"), ("src/y.ts#go", "src/y.ts#own", "calls", 3.0, "direct-call")]
    both = symbolgraph.both_ways(e)
    assert {(r.src, r.dst, r.weight) for r in both.where("kind = 'referencedBy'").collect()} == {("src/x.ts#a", "src/y.ts#go", 2.0), ("src/y.ts#own", "src/y.ts#go", 2.0)}


def test_graph_limits_and_skips(spark):
    e = symbolgraph.with_weights(spark.createDataFrame([("r", "a#s", f"f{i}#x", "calls") for i in range(6)] + [("r", "f1#x", "a/test/t#y", "calls"), ("r", "a/test/t#y", "z#z", "typeRef"), ("r", "a#s", "a#q", "typeRef")], EDGE))
    seeds = spark.createDataFrame([("r", "a#s")], "repo string, node string")
    nodes = lambda **k: sorted(r.node for r in symbolgraph.symbol_graph(e, seeds, **k).collect())
    assert nodes(depth=1) == ["a#s"] and len(nodes(depth=2)) == 8 and nodes(depth=4)[-1] == "z#z"
    assert "z#z" not in nodes(depth=4, skip=symbolgraph.F.col("node").contains("/test/"))
    assert nodes(depth=2, most_files=2) == ["a#q", "a#s", "f0#x"] and nodes(depth=2, most_nodes=3) == ["a#q", "a#s", "f0#x"]
    s = symbolgraph.graph_stats(symbolgraph.symbol_graph(e, seeds, 2), e).first()
    assert (s.n_nodes, s.n_edges, s.n_files, s.eccentricity) == (8, 7, 7, 1)


def walk(edges, seeds, nodes, depth, most_files, most_bytes):
    """The search with budgets, one repository, as a loop."""
    out, files, used = {}, set(), 0
    level = [(0, n) for n in sorted(seeds)]
    for d in range(depth + 1):
        place, after = 0, {}
        for _, n in sorted(level):
            file, size = nodes[n]
            place += 1
            scoped_ = file in files or len(files) < most_files
            if scoped_:
                files.add(file)
            ok = scoped_ and used + size <= most_bytes
            used += size if ok else 0
            if ok or n not in out:
                out[n] = (d, ok)
            if ok:
                for t in edges.get(n, ()):
                    after[t] = min(after.get(t, place), place)
        level = [(p, n) for n, p in after.items() if not out.get(n, (0, False))[1] and n in nodes]
    return out


def test_budgeted_search_equals_a_loop(spark):
    rng = random.Random(8)
    for _ in range(3):
        nodes = {f"f{i % 9}#n{i}": (f"f{i % 9}", rng.randint(1, 30)) for i in range(40)}
        edges: dict[str, set] = {}
        for _ in range(110):
            edges.setdefault(rng.choice(list(nodes)), set()).add(rng.choice(list(nodes)))
        seeds = rng.sample(list(nodes), 2)
        want = walk(edges, seeds, nodes, 3, 5, 200)
        df = symbolgraph.budgeted_graph(
            spark.createDataFrame([("r", a, b) for a, bs in edges.items() for b in bs], "repo string, src string, dst string"), spark.createDataFrame([("r", s) for s in seeds], "repo string, node string"),
            spark.createDataFrame([("r", n, f, b) for n, (f, b) in nodes.items()], "repo string, node string, file string, bytes bigint"), 3, 5, 200,
        )
        got = {r.node: (r.distance, r.included) for r in df.collect()}
        assert got == want


def test_rank_equals_a_loop_at_any_size(spark):
    rng = random.Random(5)
    names = [rng.choice(["run", "Big", "IThing", "buildIt"]) + str(i) for i in range(1500)]
    dist = {n: 0 if i == 0 else rng.randint(1, 4) for i, n in enumerate(names)}
    edges = {(rng.choice(names), rng.choice(names), rng.choice(["calls", "typeRef", "extends", "imports"])) for _ in range(6000)} | {(names[0], rng.choice(names), "calls") for _ in range(40)}
    from quillspan.functions.symbols import EDGE_WEIGHTS

    base = lambda n: 50 if n[0] == "I" else 200 if n[0] == "B" else 150 if "build" in n else 100
    tokens = {n: int(base(n) * (1.5 if dist[n] == 0 else max(0.5, 1 - 0.1 * dist[n])) + 0.5) for n in names}
    for budget, size in ((3000, None), (20_000, 4000)):
        queue, seen, rows, used = {names[0]: 1000.0}, set(), [], 0
        while queue:
            x = min(queue, key=lambda n: (-queue[n], n))
            s = queue.pop(x)
            seen.add(x)
            fits = used + tokens[x] <= budget and (size is None or 4 * (used + tokens[x]) <= size)
            rows.append((x, len(rows), round(s, 9), fits or x == names[0]))
            if not rows[-1][3]:
                break
            used += tokens[x]
            for a, b, k in edges:
                if a == x and b not in seen:
                    queue[b] = max(queue.get(b, 0), EDGE_WEIGHTS[k] * 0.8 ** dist[b])
        df = scoped.rank(spark.createDataFrame([("r", n, n, dist[n]) for n in names], "repo string, node string, name string, distance bigint"), spark.createDataFrame([("r", *e) for e in edges], EDGE), budget, size)
        got = [(r.node, r["rank"], round(r.score, 9), r.included) for r in df.orderBy("rank").collect()]
        assert got == rows and len(rows) > 8
        t = scoped.rank_stats(df).first()
        assert (t.n_included, t.tokens, t.bytes, t.exhausted) == (sum(r[3] for r in rows), used, used * 4, True)
    assert scoped.rank(spark.createDataFrame([], "repo string, node string, name string, distance bigint"), spark.createDataFrame([], EDGE)).count() == 0


def test_index_and_stubs(spark):
    g = spark.createDataFrame([("r", "src/a.ts#run", 0, ["seed"]), ("r", "node_modules/@x/y/i.d.ts#Thing", 1, ["typeRef"]), ("r", "src/b.ts#IShape", 1, ["calls"])], "repo string, node string, distance bigint, reasons array<string>")
    r = spark.createDataFrame([("r", "src/a.ts#run", 1000.0, True, True), ("r", "src/b.ts#IShape", 2.0, False, False)], "repo string, node string, score double, within boolean, included boolean")
    c = spark.createDataFrame([("r", "src/a.ts#run", "src/a.ts", 9, 12, 4, 2, 3), ("r", "src/a.ts#run", "src/a.ts", 1, 2, 4, 2, 3)], "repo string, node string, path string, start_line bigint, end_line bigint, conservative bigint, optimistic bigint, average bigint")
    i = {x.node: x for x in symbolgraph.index(g, r, c).collect()}
    assert [(p.start_line, p.end_line) for p in i["src/a.ts#run"].places] == [(1, 2), (9, 12)] and i["src/a.ts#run"].conservative == 8
    assert (i["src/b.ts#IShape"].kind, i["src/b.ts#IShape"].score, i["src/b.ts#IShape"].included, i["src/b.ts#IShape"].places) == ("interface", 2.0, False, [])
    assert i["node_modules/@x/y/i.d.ts#Thing"].score == 0.0
    s = scoped.stubs(scoped.left_out(g, r))
    text = {x.owner: x.text for x in s.collect()}
    assert text["@x/y"] == 'declare module "@x/y" {\n  export class Thing {\n    constructor(...args: unknown[]);\n  }\n}' and text["src/b.ts"].startswith("// From src/b.ts\nexport interface IShape")
    whole = scoped.stub_file(s).first()
    assert whole.n == 2 and whole.text.index("declare module") < whole.text.index("// From")


def test_blocks_are_cut_as_documented():
    body = ["function f() {"] + ["  x;"] * 300
    assert scoped.expand_block(body, 1) == (1, 51)
    assert scoped.expand_block(["const a = [", *["  1,"] * 30], 1) == (1, 12)
    assert scoped.expand_block(["x", "", "export class A {", "  m() {", "  }", "}"], 4) == (3, 6)
    assert scoped.expand_block(["just words"], 1) == (1, 1) and scoped.expand_block(["a"], 7) == (7, 7)
