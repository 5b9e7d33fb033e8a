"""Import and symbol graphs, one per repository: degrees, roles, components, reachability, breadth-first search.

An edge table has ``repo``, ``src``, ``dst``; a node table ``repo``, ``node``. A target that
is not a node of its repository is external. Every join is on (repo, node), so
repositories are worked on together, and a large one is spread by its nodes.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import paths
from quillspan.session import cut


def internal_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends are nodes; edges with a null end fall away."""
    n = nodes.select("repo", "node").distinct()
    return (
        edges.select("repo", "src", "dst").distinct()
        .join(n.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi")
        .join(n.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi")
    )


def external_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, as delivered, whose target is no node of the repository; null targets count as external."""
    return edges.join(nodes.select("repo", F.col("node").alias("dst")).distinct(), ["repo", "dst"], "left_anti")


def degrees(nodes: DataFrame, internal: DataFrame) -> DataFrame:
    """``in_degree`` and ``out_degree`` (distinct neighbours; a loop counts in both) and ``role`` of every node."""
    out = internal.groupBy("repo", F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = internal.groupBy("repo", F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    i, o = F.coalesce("in_degree", F.lit(0)).cast("bigint"), F.coalesce("out_degree", F.lit(0)).cast("bigint")
    d = nodes.select("repo", "node").distinct().join(into, ["repo", "node"], "left").join(out, ["repo", "node"], "left").select("repo", "node", i.alias("in_degree"), o.alias("out_degree"))
    role = F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "isolated").when(F.col("in_degree") == 0, "root").when(F.col("out_degree") == 0, "leaf").otherwise("inner")
    return d.withColumn("role", role)


def top_fan(deg: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The ``k`` nodes per repository with the largest degree; ties by node. Nodes of degree 0 do not count."""
    w = Window.partitionBy("repo").orderBy(F.desc(by), "node")
    return deg.where(F.col(by) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo", "node", F.col(by).alias("n"), F.col("rank").cast("bigint").alias("rank"))


def external_packages(external: DataFrame, specifier: str = "specifier") -> DataFrame:
    """``package``, ``n``: how often a package is imported."""
    p = paths.package_of(specifier)
    return external.select("repo", p.alias("package")).where("package <> ''").groupBy("package").agg(F.count("*").alias("n"))


def package_specifiers(external: DataFrame, specifier: str = "specifier") -> DataFrame:
    """``repo``, ``package``, sorted distinct ``specifiers``."""
    p = paths.package_of(specifier)
    d = external.select("repo", p.alias("package"), F.col(specifier).alias("specifier")).where("package <> ''").distinct()
    return d.groupBy("repo", "package").agg(F.array_sort(F.collect_list("specifier")).alias("specifiers"))


def totals(nodes: DataFrame, edges: DataFrame, internal: DataFrame) -> DataFrame:
    """Per repository: nodes, packages (of nodes with a ``package``; at least 1), distinct edges with a target, those inside and outside."""
    package = F.col("package") if "package" in nodes.columns else F.lit(None).cast("string")
    n = nodes.select("repo", "node", package.alias("package")).groupBy("repo").agg(F.countDistinct("node").alias("n_nodes"), F.greatest(F.countDistinct("package"), F.lit(1)).alias("n_packages"))
    e = edges.select("repo", "src", "dst").where("dst is not null").distinct().groupBy("repo").agg(F.count("*").alias("n_edges"))
    i = internal.groupBy("repo").agg(F.count("*").alias("n_internal"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    t = n.join(e, "repo", "full").join(i, "repo", "left")
    return t.select(
        "repo", z("n_nodes").alias("n_nodes"), F.coalesce("n_packages", F.lit(1)).cast("bigint").alias("n_packages"), z("n_edges").alias("n_edges"), z("n_internal").alias("n_internal"), (z("n_edges") - z("n_internal")).alias("n_external")
    )


def external_reach(external: DataFrame, specifier: str = "specifier") -> DataFrame:
    """``package``, ``n_files``, ``n_repos``: how many files and repositories import a package."""
    d = external.select("repo", "src", paths.package_of(specifier).alias("package")).where("package <> ''").distinct()
    per = d.groupBy("package", "repo").agg(F.count("*").alias("n"))
    return per.groupBy("package").agg(F.sum("n").cast("bigint").alias("n_files"), F.count("*").alias("n_repos"))


def reachability(internal: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """``repo``, ``node``, ``distance``, ``truncated``: what the seeds reach, of each repository the nearest ``most`` nodes; whether there are more."""
    w = Window.partitionBy("repo")
    d = bfs(internal, seeds).withColumns({"rn": F.row_number().over(w.orderBy("distance", "node")), "n": F.count("*").over(w)})
    return d.where(F.col("rn") <= most).select("repo", "node", "distance", (F.col("n") > most).alias("truncated"))


def components(internal: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node: ``repo``, ``node``, ``component`` (its least node).

    Each pass trims nodes that lie on no cycle, spreads the least reachable-from label
    forward until nothing changes, collects what reaches each label's node backward
    inside the label, takes that as a component, and goes on with the rest. Loops at a
    node make no component. Every round is written to the checkpoint folder, so its plan
    does not grow and lost executors cost no recomputation.
    """
    left = cut(internal.where("src <> dst").select("repo", "src", "dst").distinct())
    found = None
    while True:  # each pass takes at least one node out, so this ends
        while True:  # trim
            n = left.count()
            src, dst = left.select("repo", F.col("src").alias("dst")).distinct(), left.select("repo", F.col("dst").alias("src")).distinct()
            left = cut(left.join(src, ["repo", "dst"], "left_semi").join(dst, ["repo", "src"], "left_semi"))
            m = left.count()
            if m == n:
                break
        if m == 0:
            break
        label = cut(left.select("repo", F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
        while True:  # the least label among a node and what reaches it
            best = left.join(label.withColumnRenamed("node", "src"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("node")).agg(F.min("label").alias("l"))
            new = cut(label.join(best, ["repo", "node"], "left").select("repo", "node", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            label = new.drop("moved")
            if not moved:
                break
        colored = left.join(label.toDF("repo", "src", "ls"), ["repo", "src"]).join(label.toDF("repo", "dst", "ld"), ["repo", "dst"]).where("ls = ld").select("repo", "src", "dst", F.col("ls").alias("label"))
        colored = cut(colored)
        inside = cut(label.where("node = label"))
        edge = inside
        while True:  # backward from the label's node
            step = colored.join(edge.select("repo", F.col("node").alias("dst"), "label"), ["repo", "dst", "label"]).select("repo", F.col("src").alias("node"), "label").distinct()
            edge = cut(step.join(inside, ["repo", "node", "label"], "left_anti"))
            if edge.isEmpty():
                break
            inside = cut(inside.unionByName(edge))
        big = inside.join(inside.groupBy("repo", "label").agg(F.count("*").alias("k")).where("k > 1"), ["repo", "label"]).select("repo", "node", F.col("label").alias("component"))
        big = cut(big)
        found = big if found is None else cut(found.unionByName(big))
        gone = inside.select("repo", "node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), ["repo", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_anti"))
    empty = internal.select("repo", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    if found is None:
        return empty
    least = found.groupBy("repo", "component").agg(F.min("node").alias("least"))
    return found.join(least, ["repo", "component"]).select("repo", "node", F.col("least").alias("component"))


def bfs(internal: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """``repo``, ``node``, ``distance``: nodes reached from the seeds (``repo``, ``node``), within ``depth`` steps.

    Each round writes only what it found, and is read again with the rounds before it.
    """
    rounds = [cut(seeds.select("repo", "node").distinct().withColumn("distance", F.lit(0).cast("bigint")))]
    edges = cut(internal.select("repo", "src", "dst"))
    d = 0
    while depth is None or d < depth:
        d += 1
        step = edges.join(rounds[-1].select("repo", F.col("node").alias("src")), ["repo", "src"]).select("repo", F.col("dst").alias("node")).distinct()
        front = cut(step.join(together(rounds), ["repo", "node"], "left_anti").withColumn("distance", F.lit(d).cast("bigint")))
        if front.isEmpty():
            break
        rounds.append(front)
    return together(rounds)


def together(rounds: list[DataFrame], most: int = 32) -> DataFrame:
    """The rounds of a loop as one table; of many, the earlier ones are merged in place, so that plans stay small."""
    if len(rounds) > most:
        rounds[:-1] = [cut(functools.reduce(DataFrame.unionByName, rounds[:-1]))]
    return functools.reduce(DataFrame.unionByName, rounds)


def reexport_hubs(edges: DataFrame, least: int = 5, kind: str = "kind") -> DataFrame:
    """Files with at least ``least`` distinct re-exports: ``reexports``, ``exports_total`` and ``ratio``."""
    d = edges.select("repo", "src", "dst", "specifier", kind).distinct()
    h = d.groupBy("repo", F.col("src").alias("node")).agg(F.count_if(F.col(kind).isin("reexport", "export")).alias("reexports"), F.count("*").alias("edges_total"))
    return h.where(F.col("reexports") >= least).withColumn("ratio", F.when(F.col("edges_total") > 0, F.col("reexports") / F.col("edges_total")).otherwise(0.0))


def hotspots(deg: DataFrame, hubs: DataFrame, fan_in: int = 10, fan_out: int = 10, k: int = 20) -> DataFrame:
    """The ``k`` files per repository with the largest sum of the signals that pass their thresholds.

    A file of the top ten of either fan list appears even if its score is 0. Ties: the
    fan-in list first, then fan-out, then hubs, each in its order.
    """
    ins, outs = top_fan(deg, "in_degree"), top_fan(deg, "out_degree")
    part = lambda df, n, limit, name, src: df.select(
        "repo", "node", F.when(F.col(n) >= limit, F.col(n)).otherwise(0).alias("score"), F.when(F.col(n) >= limit, F.lit(name)).alias("reason"), F.lit(src).alias("src"), F.col("rank").alias("pos")
    )
    ranked = hubs.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("reexports"), "node")).cast("bigint"))
    u = part(ins, "n", fan_in, "fan-in", 0).unionByName(part(outs, "n", fan_out, "fan-out", 1)).unionByName(part(ranked, "reexports", 0, "re-exports", 2))
    g = u.groupBy("repo", "node").agg(F.sum("score").cast("bigint").alias("score"), F.array_sort(F.array_compact(F.collect_list("reason"))).alias("reasons"), F.min(F.struct("src", "pos")).alias("o"))
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "o.src", "o.pos")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("repo", "node", "score", "reasons", "rank")
