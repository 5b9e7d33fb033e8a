"""Symbols of modules, the typed edges between them, and the graph around seeds.

A module's symbols are its declarations at line starts; each reaches up to the next one.
What a symbol refers to is read from its own lines, named by kind, and resolved through the
module's imports by equi-joins. A symbol is known as ``path#name`` within its repository.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import symbols as sy
from quillspan.operators import frontend, resolve
from quillspan.operators.graph import bfs
from quillspan.session import cut

# What a declaration at the start of a line looks like, and words before a parenthesis that call nothing.
TOP = r"^(?:export\s+)?(?:(?:default|async|abstract|declare)\s+)*(function|class|interface|type|enum|const|let)\s+([A-Za-z_$][\w$]*)"
NOT_CALLED = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "super", "import", "constructor", "throw")
# Why an edge of a kind exists, and what it weighs.
REASONS = {"typeRef": "return-type", "extends": "extends", "implements": "implements", "calls": "direct-call", "referencedBy": "referenced-by"}
WEIGHTS = {"typeRef": 2.5, "extends": 2.0, "implements": 2.0, "calls": 3.0, "referencedBy": 2.0}

_TOP = re.compile(TOP)
_STRING = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_EXTENDS, _IMPLEMENTS = re.compile(r"\bextends\s+([^{]+)"), re.compile(r"\bimplements\s+([^{]+)")
_RETURNS = re.compile(r"\)\s*:\s*([^={;]+)")
_CALL = re.compile(r"(?:^|[^.\w$])([A-Za-z_$][\w$]*)\s*\(")


def references(code: str, kind: str) -> set[tuple[str, str]]:
    """(kind, name) of what a symbol refers to; ``code`` begins behind its name, comments are gone."""
    code = _STRING.sub("''", code)
    head = code.split("{", 1)[0]
    found = set()
    if kind in ("class", "interface"):
        for rule, pattern in (("extends", _EXTENDS), ("implements", _IMPLEMENTS)):
            m = pattern.search(head)
            if m:
                part = re.split(r"\bimplements\b|\bextends\b", m.group(1))[0]
                while "<" in part and re.search(r"<[^<>]*>", part):
                    part = re.sub(r"<[^<>]*>", "", part)
                found |= {(rule, n.group()) for x in part.split(",") if (n := _NAME.match(x.strip()))}
    if kind == "function":
        m = _RETURNS.search(head)
        if m:
            found |= {("typeRef", n) for n in _NAME.findall(m.group(1)) if n[0].isupper()}
    found |= {("calls", n) for n in _CALL.findall(code) if n not in NOT_CALLED}
    return found


def symbols(files: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """One row per symbol: ``keys``, ``symbol``, ``kind``, ``line``, ``end_line`` (from 1), ``exported``, ``refs`` (sorted array of kind and name).

    Lines that begin with a comment mark say nothing. Null texts have no symbols; a name declared twice in a
    module gives two rows.
    """
    schema = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys) + ", symbol string, kind string, line bigint, end_line bigint, exported boolean, refs array<struct<kind:string,name:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *own, text in b.itertuples(index=False):
                lines = text.replace("\r\n", "\n").split("\n")
                at = [(i, m) for i, x in enumerate(lines) if (m := _TOP.match(x))]
                for (i, m), end in zip(at, [*(k for k, _ in at[1:]), len(lines)][: len(at)], strict=True):
                    body = [lines[i][m.end() :], *lines[i + 1 : end]]
                    code = "\n".join(x for x in body if not x.lstrip().startswith(("//", "*", "/*")))
                    rows.append((*own, m.group(2), m.group(1), i + 1, end, lines[i].startswith("export"), [{"kind": k, "name": n} for k, n in sorted(references(code, m.group(1)))]))
            yield pd.DataFrame(rows, columns=[*keys, "symbol", "kind", "line", "end_line", "exported", "refs"])

    return files.where(F.col(text_col).isNotNull()).select(*keys, text_col).mapInPandas(run, schema)


def symbol_edges(found: DataFrame, bound: DataFrame) -> DataFrame:
    """``repo``, ``src``, ``dst`` (symbol ids), ``kind``, ``weight``, ``reason``: references that resolve to a symbol, distinct.

    ``found``: rows of ``symbols`` with repo, path; ``bound``: what a module's imports mean (repo, path, name,
    target, imported). A name that is not imported is one of the module itself, or unresolved.
    """
    uses = found.select("repo", "path", "symbol", F.explode("refs").alias("r")).select("repo", "path", "symbol", F.col("r.kind").alias("kind"), F.col("r.name").alias("name"))
    to = resolve.resolve_names(uses, bound, found.select("repo", "path", F.col("symbol").alias("name"))).where("to_path is not null")
    e = to.select("repo", sy.symbol_id("path", "symbol").alias("src"), sy.symbol_id("to_path", "to_symbol").alias("dst"), "kind").where("src <> dst").distinct()
    return with_weights(e)


def with_weights(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Edges with the ``weight`` and ``reason`` of their kind; unknown kinds weigh 1 and give themselves as reason."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    w = F.try_element_at(table(WEIGHTS | (weights or {})), F.col("kind"))
    return edges.withColumns({"weight": F.coalesce(w, F.lit(1.0)), "reason": F.coalesce(F.try_element_at(table(REASONS), F.col("kind")), F.col("kind"))})


def import_bindings(files: DataFrame, text_col: str = "content", aliases: dict[str, str] | None = None) -> DataFrame:
    """``repo``, ``path``, ``name``, ``target``, ``imported``: the names a module's imports bind and the files they come from."""
    imported = frontend.bindings(frontend.imports(files, ["repo", "path"], text_col), ["repo", "path"])
    asked = resolve.resolve(imported.withColumn("src", F.col("path")), files, aliases).where("resolved is not null")
    return asked.select("repo", "path", "name", F.col("resolved").alias("target"), "imported")


def both_ways(edges: DataFrame) -> DataFrame:
    """The edges and, turned around, who refers to a symbol (kind ``referencedBy``)."""
    back = edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("referencedBy").alias("kind")).distinct()
    return edges.select("repo", "src", "dst", "kind", "weight", "reason").unionByName(with_weights(back))


def path_of(node: Column | str) -> Column:
    return F.substring_index(F.col(node) if isinstance(node, str) else node, "#", 1)


def symbol_graph(edges: DataFrame, seeds: DataFrame, depth: int = 2, skip: Column | None = None, most_nodes: int | None = 1000, most_files: int | None = 50) -> DataFrame:
    """Symbols fewer than ``depth`` steps from the seeds (repo, node): ``repo``, ``node``, ``distance``, sorted distinct ``reasons``.

    ``edges``: repo, src, dst, reason, in the directions that are followed. ``skip`` (over ``node``) leaves
    symbols out, such as those of tests or documents, and what only they lead to. Of a repository
    the nearest ``most_files`` files and ``most_nodes`` symbols are kept, ties by name; None sets no limit.
    """
    e = edges.select("repo", "src", "dst", "reason")
    if skip is not None:
        out = F.coalesce(skip, F.lit(False))
        marked = e.select("repo", F.col("dst").alias("node")).distinct().where(out).select("repo", F.col("node").alias("dst"))
        e = e.join(marked, ["repo", "dst"], "left_anti")
    reached = bfs(e, seeds, depth - 1)
    into = e.join(reached.select("repo", F.col("node").alias("src")), ["repo", "src"])
    why = into.groupBy("repo", F.col("dst").alias("node")).agg(F.collect_set("reason").alias("r"))
    none = F.array().cast("array<string>")
    seeded = F.when(F.col("distance") == 0, F.array(F.lit("seed"))).otherwise(none)
    g = reached.join(why, ["repo", "node"], "left").select("repo", "node", "distance", F.array_sort(F.array_distinct(F.concat(seeded, F.coalesce("r", none)))).alias("reasons"))
    if most_files is not None:
        f = g.groupBy("repo", path_of("node").alias("file")).agg(F.min(F.struct("distance", "node")).alias("first"))
        f = f.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy("first"))).where(F.col("rn") <= most_files)
        g = g.withColumn("file", path_of("node")).join(f.select("repo", "file"), ["repo", "file"], "left_semi").drop("file")
    if most_nodes is not None:
        g = g.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy("distance", "node"))).where(F.col("rn") <= most_nodes).drop("rn")
    return g


def budgeted_graph(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, depth: int = 2, most_files: int = 50, most_bytes: int = 500_000) -> DataFrame:
    """A search that spends a budget as it goes: ``repo``, ``node``, ``distance``, ``included``.

    ``edges``: repo, src, dst; ``nodes``: repo, node, file, bytes. Symbols are met level by level, in the order of
    the symbols that lead to them and then by name. One in a file too many, or over what is left of the bytes, is
    left out and leads nowhere; a file counts once a symbol of it was admitted to the byte check. Each level is an
    ordered stream per repository that carries what is left; nothing is gathered.
    """
    e = cut(edges.select("repo", "src", "dst").distinct())
    n = cut(nodes.groupBy("repo", "node").agg(F.min("file").alias("file"), F.coalesce(F.min("bytes"), F.lit(0)).alias("bytes")))
    schema = "repo string, node string, file string, bytes bigint, parent bigint, used bigint, files array<string>, place bigint, scoped boolean, included boolean"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = fold
        place = used = 0
        files: set[str] = set()
        for b in batches:
            marks = []
            for repo, file, size, start, known in zip(b.repo, b.file, b.bytes, b.used, b["files"], strict=True):
                if now is fold or repo != now:
                    now, used, files, place = repo, int(start), set(known), 0
                scoped = file in files or len(files) < most_files
                if scoped:
                    files.add(file)
                fits = scoped and used + size <= most_bytes
                used += size if fits else 0
                place += 1
                marks.append((place, scoped, fits))
            yield b.assign(place=[m[0] for m in marks], scoped=[m[1] for m in marks], included=[m[2] for m in marks])

    seen = None
    front = seeds.select("repo", "node").distinct().withColumn("parent", F.lit(0).cast("bigint"))
    for level in range(depth + 1):
        if seen is None:
            state = front.select("repo").distinct().select("repo", F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("files"))
        else:
            done = seen.groupBy("repo").agg(F.sum(F.when(F.col("included"), F.col("bytes")).otherwise(0)).cast("bigint").alias("used"), F.array_sort(F.collect_set(F.when(F.col("scoped"), F.col("file")))).alias("files"))
            state = done  # at most most_files files
        row = front.join(n, ["repo", "node"]).join(state, "repo").select("repo", "node", "file", "bytes", "parent", "used", "files")
        met = row.repartition("repo").sortWithinPartitions("repo", "parent", "node").mapInPandas(fold, schema).withColumn("distance", F.lit(level).cast("bigint"))
        met = cut(met.select("repo", "node", "file", "bytes", "place", "scoped", "included", "distance"))
        seen = met if seen is None else cut(seen.unionByName(met))
        step = e.join(met.where("included").select("repo", F.col("node").alias("src"), "place"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("node")).agg(F.min("place").alias("parent"))
        front = step.join(seen.where("included"), ["repo", "node"], "left_anti")
        if met.where("included").isEmpty():
            break
    w = Window.partitionBy("repo", "node").orderBy(F.desc("included"), "distance")
    return seen.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("repo", "node", "distance", "included")


def graph_stats(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: ``n_nodes``, ``n_edges`` (distinct, between its nodes), ``n_files``, ``eccentricity`` and ``json_bytes`` of the nodes."""
    g = graph.withColumn("size", F.octet_length(F.to_json(F.struct("distance", "node", "reasons"))))
    per = g.groupBy("repo").agg(F.count("*").alias("n_nodes"), F.countDistinct(path_of("node")).alias("n_files"), F.max("distance").alias("eccentricity"), F.sum("size").cast("bigint").alias("json_bytes"))
    ends = graph.select("repo", "node")
    e = edges.select("repo", "src", "dst", "kind").distinct().join(ends.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi")
    n = e.groupBy("repo").agg(F.count("*").alias("n_edges"))
    return per.join(n, "repo", "left").select("repo", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_files", "eccentricity", "json_bytes")


def marked(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """The symbols of a graph with their ``line`` in an index: mark, id and the kind their name suggests."""
    leads = edges.select("repo", F.col("src").alias("node")).distinct().withColumn("leads", F.lit(True))
    d = graph.join(leads, ["repo", "node"], "left")
    mark = sy.role_mark(F.col("distance") == 0, F.col("leads").isNull())
    return d.select("repo", "node", F.concat(mark, F.lit(" "), F.col("node"), F.lit(" ("), sy.inferred_kind(F.substring_index("node", "#", -1)), F.lit(")")).alias("line"))


def index(graph: DataFrame, ranked: DataFrame, slices: DataFrame) -> DataFrame:
    """The index of a scoped pack: every symbol of the graph with its rank and its slices.

    ``ranked``: repo, node, score, within, included; ``slices``: repo, node, path, start_line, end_line and the
    three token estimates. A symbol without rank has score 0 and is not included; one without slices has an empty list
    and null token sums.
    """
    r = ranked.select("repo", "node", "score", "within", "included")
    s = slices.groupBy("repo", "node").agg(
        F.array_sort(F.collect_list(F.struct("path", "start_line", "end_line"))).alias("places"), *[F.sum(c).cast("bigint").alias(c) for c in ("conservative", "optimistic", "average")]
    )
    none = F.array().cast("array<struct<path:string,start_line:bigint,end_line:bigint>>")
    d = graph.join(r, ["repo", "node"], "left").join(s, ["repo", "node"], "left")
    return d.select(
        "repo", "node", "distance", "reasons", sy.inferred_kind(F.substring_index("node", "#", -1)).alias("kind"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("within", F.lit(False)).alias("within"),
        F.coalesce("included", F.lit(False)).alias("included"), F.coalesce("places", none).alias("places"), "conservative", "optimistic", "average",
    )
