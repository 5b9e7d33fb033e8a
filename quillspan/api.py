"""The four features as functions over tables: pack, scoped pack, paste pack, refactoring report."""

from __future__ import annotations

import functools
import os
import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import paths
from quillspan.functions import symbols as sy
from quillspan.functions import text as tx
from quillspan.operators import budget, catalog, emit, frontend, graph, manifest, paste, report, resolve, scoped, similarity, symbolgraph, validate
from quillspan.registry import Registry
from quillspan.session import cut
from quillspan.sources import files as source


@dataclass
class PackConfig:
    """Parameters of a pack; 0 or None takes a default."""

    level: str = "contracts"
    preset: str = "auto"
    budget_bytes: int | None = None
    packages: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    validate: bool = True
    validate_only: bool = False
    strict: bool = False
    deterministic: bool = True
    format: str = "ndjson"

    @property
    def total_bytes(self) -> int:
        return self.budget_bytes or budget.LEVELS[self.level]


@dataclass
class Health:
    name: str
    status: str
    seconds: float
    error: str = ""


class BuiltIn:
    """A collector made of a name and a function of the tables."""

    def __init__(self, name: str, make) -> None:
        self.name, self._make = name, make

    def collect(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {self.name: self._make(tables)}


def _topology(tables: dict[str, DataFrame]) -> DataFrame:
    """Per package its dependencies inside and outside the workspace, from the package.json files."""
    p = source.package_json(tables["files"].select("repo", "path", "content"), "content").where("name is not null")
    return resolve.workspace_dependencies(p.select("repo", F.col("name").alias("package"), F.explode_outer("dependencies").alias("dependency")), p.select("repo", "name"))


def _configs(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["files"].where(F.col("content").isNotNull())
    p = source.package_json(f.select("repo", "path", "content"), "content").select("repo", paths.directory("path").alias("dir"), F.col("name").alias("package"))
    c = f.where(paths.file_name("path").isin("tsconfig.json", "jsconfig.json")).select("repo", "path", F.col("content").alias("text"))
    return frontend.compiler_options(c, packages=p)


def _duplication(tables: dict[str, DataFrame]) -> DataFrame:
    f = source.duplication_sources(tables["files"]).select(F.concat_ws("#", "repo", "path").alias("id"), "content")
    prints = similarity.fingerprints(f, "id", "content")
    return similarity.cluster_table(similarity.greedy_clusters(similarity.similar_pairs(prints)), prints)


def default_registry() -> Registry:
    """Collectors over ``files`` (repo, path, bytes, sha256, loc, content) and ``edges`` (repo, src, dst, kind, specifier)."""
    r = Registry()
    nodes = lambda t: t["files"].select("repo", F.col("path").alias("node"))
    ts = lambda t: source.export_sources(t["files"].where(F.col("content").isNotNull()))
    for name, make in {
        "files-manifest": lambda t: manifest.manifest(t["files"].drop("content")),
        "import-graph": lambda t: graph.degrees(nodes(t), graph.internal_edges(t["edges"], nodes(t))),
        "topology": _topology,
        "exports": lambda t: catalog.exports(ts(t), ["repo", "path"], "content"),
        "schema-index": lambda t: catalog.schema_files(t["files"]).select("repo", "path", catalog.schema_class("path").alias("type")),
        "ts-config": _configs,
        "type-metrics": lambda t: catalog.type_metrics(ts(t), ["repo", "path"], "content"),
        "duplication": _duplication,
    }.items():
        r.register(BuiltIn(name, make))
    return r


def detect_preset(files: DataFrame) -> tuple[str, float]:
    """The preset of the surest detection among the repositories' root files (repo, path, content); ties by name."""
    root = files.where(~F.col("path").contains("/")).select("repo", F.col("path").alias("name"), F.col("content").alias("text"))
    found = catalog.choose_presets(catalog.detect_languages(root), catalog.detect_monorepos(root))
    best = found.groupBy("preset").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "preset").first()
    return (best.preset, best.confidence) if best else ("default", 0.0)


def within_budget(artifacts: dict[str, DataFrame], total: int, registry: Registry) -> tuple[dict[str, DataFrame], list[dict]]:
    """The artifacts that fit the budget by their bytes as NDJSON, in their order, and the decision on each."""
    if not artifacts:
        return {}, []
    sizes = [emit.canonical_json(df, "t").agg(F.coalesce(F.sum(F.octet_length("t") + 1), F.lit(0)).cast("bigint").alias("size")).select(F.lit("pack").alias("pack"), F.lit(n).alias("id"), "size") for n, df in artifacts.items()]
    chosen = {r.id: r for r in budget.choose_artifacts(functools.reduce(DataFrame.unionByName, sizes), "pack", total, None, registry.value).collect()}  # one row per artifact
    return {n: df for n, df in artifacts.items() if chosen[n].included}, [{"id": n, "size": chosen[n]["size"], "decision": chosen[n].decision} for n in artifacts]


def pack(tables: dict[str, DataFrame], config: PackConfig | None = None, out: str | None = None, registry: Registry | None = None) -> tuple[dict[str, DataFrame], list[Health]]:
    """Artifacts of the collectors of the preset that fit the budget of the level, and how each collector fared; written below ``out`` if given.

    The preset ``auto`` is what the repositories' root files show. A collector that fails is reported and, unless
    strict, the others go on. In strict mode broken file records raise after writing, with ``validate_only``
    before. The metadata states the preset, each artifact's size and decision, and the collectors' health.
    """
    config, registry = config or PackConfig(), registry or default_registry()
    files = tables["files"]
    for p in config.packages:
        files = files.where(F.col("path").startswith(p))
    for g in config.exclude:
        files = files.where(~F.col("path").rlike("(?i)" + paths.glob_to_regex(g)))
    tables = tables | {"files": files}
    found = validate.findings(manifest.manifest(files), ["path"], validate.file_rules()) if config.validate or config.validate_only else None
    if found is not None and config.validate_only:
        validate.enforce(found, config.strict, only=True)
        return {}, []
    preset, sure = detect_preset(files) if config.preset == "auto" else (config.preset, 1.0)
    made: dict[str, DataFrame] = {}
    health: list[Health] = []
    for c in registry.for_preset(preset):
        began = time.time()
        try:
            made |= c.collect(tables)
            health.append(Health(c.name, "ok", time.time() - began))
        except Exception as e:
            health.append(Health(c.name, "failed", time.time() - began, str(e)[:500]))
            if config.strict:
                raise
    artifacts, decisions = within_budget(made, config.total_bytes, registry)
    if out:
        if config.format == "ndjson":
            emit.write_variants(artifacts, out, {"full": tuple(artifacts), "short": budget.SHORT, "minimal": budget.MINIMAL})
        else:
            for n, df in artifacts.items():
                registry.formatters[config.format][1](df).write.mode("overwrite").json(os.path.join(out, "full", n + "." + config.format))
        meta = {"level": config.level, "budget_bytes": config.total_bytes, "preset": preset, "confidence": sure, "artifacts": decisions, "health": [vars(h) for h in health], "summary": health_summary(health)}
        emit.write_json(meta, os.path.join(out, "metadata.json"), config.deterministic)
    if found is not None:
        validate.enforce(found, config.strict)
    return artifacts, health


def health_summary(health: list[Health]) -> dict[str, float]:
    """How many collectors ended with each status, and the seconds of all."""
    counts = Counter(h.status for h in health)
    return {"total": len(health), "ok": counts["ok"], "failed": counts["failed"], "seconds": round(sum(h.seconds for h in health), 3)}


def paste_pack(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int = 100, max_loc: int = 50_000, max_bytes: int = 2_000_000) -> DataFrame:
    """``repo``, ``text``: the rendered pack of each repository's files (repo, path, content, size, loc)."""
    return paste.render(paste.choose(files, "repo", paste.exclude_reason("path", None, include, exclude), max_files, max_loc, max_bytes), "repo")


def refactor_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One report row per repository; ``nodes``: repo, node; ``edges``: repo, src, dst, kind, specifier."""
    inner = graph.internal_edges(edges, nodes)
    deg, hubs = graph.degrees(nodes, inner), graph.reexport_hubs(edges)
    return report.report(deg, hubs, graph.hotspots(deg, hubs), graph.components(inner))


def resolve_seeds(seeds: DataFrame, found: DataFrame, allow_private: bool = False) -> DataFrame:
    """What seeds (``repo``, ``seed``) mean: ``repo``, ``seed``, ``node`` (symbol id, null if there is none) and ``problem``.

    A named seed is the declaration of that name, a member seed that of its class, a line seed the symbol
    whose lines hold it. ``found``: rows of ``symbolgraph.symbols`` with repo, path.
    """
    s = seeds.select("repo", "seed", sy.parse_seed("seed").alias("s")).distinct()
    d = found.select("repo", F.col("path").alias("p"), "symbol", "line", "end_line", "exported")
    same = (s["repo"] == d["repo"]) & (F.col("s.path") == F.col("p"))  # one module's symbols per seed
    meant = (F.col("symbol") == F.col("s.symbol")) | F.col("s.line").between(F.col("line"), F.col("end_line"))
    j = s.join(d, same & meant, "left").groupBy(s["repo"], "seed", "s").agg(F.min(F.when(F.col("symbol").isNotNull(), F.struct("line", "symbol", "exported"))).alias("d"))
    known = found.select("repo", "path").distinct().select(F.col("repo").alias("r"), F.col("path").alias("p2"))
    j = j.join(known, (F.col("repo") == F.col("r")) & (F.col("s.path") == F.col("p2")), "left")
    # Seeds with a line are taken by position, so only named ones must be exported.
    problem = scoped.seed_problem(F.col("s"), F.col("p2").isNotNull() & F.col("d").isNotNull(), F.coalesce("s.path", F.lit("")), F.when(F.col("s.line").isNull(), F.col("d.exported")), allow_private)
    return j.select("repo", "seed", F.when(problem.isNull(), sy.symbol_id("s.path", "d.symbol")).alias("node"), problem.alias("problem"))


def scoped_pack(
    seeds: DataFrame, files: DataFrame, depth: int = 2, budget_tokens: int = 20_000, budget_bytes: int | None = None, max_files: int = 50, max_nodes: int = 1000, include_tests: bool = False, include_docs: bool = False,
    allow_private: bool = True, plan_only: bool = False, aliases: dict[str, str] | None = None, registry: Registry | None = None,
) -> dict[str, DataFrame]:
    """The symbol graph around each repository's seeds (``repo``, ``seed``), its ranking and, unless ``plan_only``, slices, stubs, index and text.

    ``files``: repo, path, content, one row per path. Tables: ``seeds`` (with problems), ``graph``, ``edges``, ``rank``, ``stats``,
    ``rank_stats``; then ``slices`` of the included symbols, ``stubs`` of the others, ``index`` (every symbol with rank and
    slices) and ``sections``. Bounds: depth 1 to 10, at least one file.
    """
    if not 1 <= depth <= 10 or max_files < 1 or budget_tokens < 1 or (budget_bytes is not None and budget_bytes < 1000):
        raise ValueError("depth must lie between 1 and 10, there must be a file and a token, and 1000 bytes")
    weights = (registry or Registry()).edge_weights
    found = cut(symbolgraph.symbols(files, ["repo", "path"]))
    edges = cut(symbolgraph.with_weights(symbolgraph.both_ways(symbolgraph.symbol_edges(found, symbolgraph.import_bindings(files, aliases=aliases))), weights))
    asked = cut(resolve_seeds(seeds, found, allow_private))
    start = asked.where("node is not null").select("repo", "node").distinct()
    file = symbolgraph.path_of("node")
    hidden = [c for c, wanted in ((paths.test_path(file), include_tests), (paths.doc_path(file), include_docs)) if not wanted]
    g = cut(symbolgraph.symbol_graph(edges, start, depth, functools.reduce(lambda a, b: a | b, hidden) if hidden else None, max_nodes, max_files))
    forward = edges.where("kind <> 'referencedBy'")  # the ranking follows what a symbol uses, not who uses it
    ranked = cut(scoped.rank(g.withColumn("name", F.substring_index("node", "#", -1)), forward, budget_tokens, budget_bytes, weights))
    out = {"seeds": asked, "graph": g, "edges": edges, "rank": ranked, "stats": symbolgraph.graph_stats(g, edges), "rank_stats": scoped.rank_stats(ranked)}
    if plan_only:
        return out
    at = found.groupBy("repo", sy.symbol_id("path", "symbol").alias("node")).agg(F.min(F.struct("line", "path", "symbol")).alias("d"))
    places = ranked.where("included").join(at, ["repo", "node"]).select("repo", "d.path", "d.symbol", "d.line")
    s = scoped.slices(files, places).withColumn("node", sy.symbol_id("path", "symbol"))
    n = F.length("body")
    s = cut(s.withColumns({"conservative": tx.tokens_conservative(n), "optimistic": tx.tokens_optimistic(n), "average": tx.tokens_average(n)}))
    seed_files = start.select("repo", file.alias("path")).distinct().withColumn("is_seed", F.lit(True))
    parts = s.join(seed_files, ["repo", "path"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False))).withColumn("body", tx.redacted("body"))
    gone = scoped.left_out(g, ranked)
    return out | {"slices": s, "stubs": scoped.stubs(gone), "index": symbolgraph.index(g, ranked, s), "sections": scoped.scoped_sections(parts, budget_tokens)}


def resolve_imports(edges: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Edges with ``dst`` filled in where a specifier means a file of the repository."""
    r = resolve.resolve(edges, files, aliases)
    return r.withColumn("dst", F.coalesce("dst", "resolved")).drop("resolved")
