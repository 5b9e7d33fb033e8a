import pytest

from quillspan import api
from quillspan.operators.emit import EngineError
from quillspan.registry import Collector, choose_preset


def tables(spark):
    f = spark.createDataFrame(
        [("r", "src/a.ts", 10, None, 1, "export const a = 1;", 10), ("r", "src/b.ts", 10, None, 1, "import { a as run } from './a';\nexport function go(): Late {\n  run();\n}\nclass Late extends Base { }\nfunction lost() { }\n", 10)],
        "repo string, path string, bytes bigint, sha256 string, loc bigint, content string, size bigint",
    )
    e = spark.createDataFrame([("r", "src/b.ts", None, "import", "./a")], "repo string, src string, dst string, kind string, specifier string")
    return f, api.resolve_imports(e, f)


def test_features_compose(spark, tmp_path):
    f, e = tables(spark)
    assert e.first().dst == "src/a.ts"
    artifacts, health = api.pack({"files": f, "edges": e}, api.PackConfig(preset="ts-pnpm"), out=str(tmp_path / "o"))
    assert {h.status for h in health} == {"ok"} and (tmp_path / "o" / "metadata.json").exists() and (tmp_path / "o" / "full" / "exports.ndjson").exists()
    assert "==== FILE: src/a.ts" in api.paste_pack(f).first().text
    n = f.selectExpr("repo", "path as node")
    assert api.refactor_report(n, e).first().risk_level == "low"
    seeds = spark.createDataFrame([("r", "src/b.ts#go")], "repo string, seed string")
    got = api.scoped_pack(seeds, f)
    assert {(r.node, r.distance, *r.reasons) for r in got["graph"].collect()} == {("src/b.ts#go", 0, "referenced-by", "seed"), ("src/a.ts#a", 1, "direct-call"), ("src/b.ts#Late", 1, "return-type")}
    assert [(r.node, r.rank, r.score, r.included) for r in got["rank"].orderBy("rank").collect()] == [("src/b.ts#go", 0, 1000.0, True), ("src/a.ts#a", 1, 2.4000000000000004, True), ("src/b.ts#Late", 2, 2.0, True)]
    s = {r.symbol: (r.start_line, r.end_line) for r in got["slices"].collect()}
    assert s == {"go": (2, 4), "a": (1, 1), "Late": (5, 5)}
    i = {r.node: r for r in got["index"].collect()}
    assert i["src/b.ts#go"].places[0].start_line == 2 and i["src/a.ts#a"].kind == "function" and i["src/a.ts#a"].average > 0
    text = got["sections"].first().text
    assert text.startswith("==== SECTION: HEADER ====") and text.index("src/b.ts L2") < text.index("src/a.ts L1") and text.endswith("==== END ====")
    small = api.scoped_pack(seeds, f, budget_tokens=10)
    assert [r.included for r in small["rank"].orderBy("rank").collect()] == [True, False] and small["rank_stats"].first().exhausted
    assert {(r.owner, r.n) for r in small["stubs"].collect()} == {("src/a.ts", 1), ("src/b.ts", 1)}
    bad = spark.createDataFrame([("r", x) for x in ("src/b.ts#nobody", "src/z.ts#go", "nonsense", "src/b.ts#lost", "src/b.ts:3", "x.d.ts#A")], "repo string, seed string")
    found = api.scoped_pack(bad, f, allow_private=False, plan_only=True)["seeds"].collect()
    assert {r.seed: (r.node, r.problem) for r in found} == {
        "src/b.ts#nobody": (None, "SEED_NOT_FOUND"), "src/z.ts#go": (None, "SEED_NOT_FOUND"), "nonsense": (None, "INVALID_GRAMMAR"), "src/b.ts#lost": (None, "NOT_EXPORTED"), "src/b.ts:3": ("src/b.ts#go", None), "x.d.ts#A": (None, "AMBIENT_TYPE"),
    }


def test_the_budget_and_the_detected_preset_are_applied(spark, tmp_path):
    import json

    f, e = tables(spark)
    root = spark.createDataFrame([("r", "package.json", 9, None, 1, '{"name":"x","devDependencies":{"typescript":"5"},"dependencies":{"y":"1"}}', 9), ("r", "tsconfig.json", 9, None, 1, '{"compilerOptions":{"strict":true,"target":"es2022"}}', 9)], f.schema)
    f = f.unionByName(root)
    assert api.detect_preset(f) == ("ts-simple", 0.6)
    got, _ = api.pack({"files": f, "edges": e}, api.PackConfig(budget_bytes=400), out=str(tmp_path / "o"))
    meta = json.loads((tmp_path / "o" / "metadata.json").read_text())
    assert meta["preset"] == "ts-simple" and {d["id"] for d in meta["artifacts"]} == {"files-manifest", "topology", "exports", "type-metrics"}
    assert set(got) == {d["id"] for d in meta["artifacts"] if d["decision"] == "kept"} and len(got) < 4 and sum(d["size"] for d in meta["artifacts"] if d["decision"] == "kept") <= 400
    every, _ = api.pack({"files": f, "edges": e}, api.PackConfig(preset="ts-pnpm"))
    assert every["topology"].first().external == ["typescript", "y"] and every["ts-config"].first().options["target"] == "ES2022" and every["duplication"].count() == 0


def test_registry(spark):
    r = api.default_registry()

    class Mine:
        name = "mine"

        def collect(self, tables):
            return {"mine": tables["files"].limit(1)}

    r.register(Mine(), "ts-simple")
    assert isinstance(Mine(), Collector) and "mine" in [c.name for c in r.for_preset("ts-simple")]
    r.presets["mine"] = ("nobody",)
    with pytest.raises(EngineError):
        r.for_preset("mine")
    assert choose_preset({"typescript"}, "pnpm")[0] == "ts-pnpm" and choose_preset(set(), None)[0] == "default"
