"""Scoped packs: ranking within a budget, slices, merged ranges, stubs, sections."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import paths
from quillspan.functions import symbols as sy
from quillspan.functions import text as tx


def eccentricity(reached: DataFrame) -> DataFrame:
    """``repo``, ``eccentricity`` (the largest distance) and ``n_nodes``."""
    return reached.groupBy("repo").agg(F.max("distance").alias("eccentricity"), F.count("*").alias("n_nodes"))


def rank(nodes: DataFrame, edges: DataFrame, budget_tokens: int = 20_000, budget_bytes: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Order of inclusion within a budget, per repository.

    ``nodes``: repo, node, name, distance; ``edges``: repo, src, dst, kind. The best-scored edge is followed first,
    its score being weight times 0.8 to the target's distance; the seed scores 1000 and is always in; a symbol's
    bytes are four times its tokens. The first symbol that overflows a budget ends the run and is listed as
    not included. Ties go by node. Rows: repo, node, rank (from 0), score, tokens, within, included.

    Every symbol takes 25 tokens at least, so a run meets few symbols, and of those a symbol leads to only as
    many best-scored ones can be met: the others are dropped before a repository's edges come together.
    """
    n = nodes.select("repo", "node", sy.token_estimate("name", "distance").alias("tokens"), "distance")
    e = edges.select("repo", "src", "dst", sy.edge_weight("kind", weights).alias("w")).groupBy("repo", "src", "dst").agg(F.max("w").alias("w"))
    e = e.join(n.select("repo", F.col("node").alias("dst"), "distance"), ["repo", "dst"]).select("repo", "src", "dst", sy.edge_score("w", "distance").alias("s"))
    e = e.join(n.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_semi")
    met = budget_tokens // 25 + 2 + n.where("distance = 0").groupBy("repo").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("repo", "src").orderBy(F.desc("s"), "dst"))).where(F.col("rn") <= met).select(F.col("repo").alias("_repo"), "src", "dst", "s")

    def run(key, g: pd.DataFrame, ed: pd.DataFrame) -> pd.DataFrame:
        tokens = dict(zip(g.node, g.tokens, strict=True))
        out_edges: dict[str, list] = {}
        for s, d, w in zip(ed.src, ed.dst, ed.s, strict=True):
            out_edges.setdefault(s, []).append((d, w))
        seeds = set(g.node[g.distance == 0])
        heap = [(-1000.0, x) for x in sorted(seeds)]
        rows, seen, used = [], set(), 0
        while heap:
            s, x = heapq.heappop(heap)
            if x in seen:
                continue
            seen.add(x)
            after = used + tokens[x]
            within = after <= budget_tokens and (budget_bytes is None or after * 4 <= budget_bytes)
            included = within or x in seeds
            rows.append((key[0], x, len(rows), -s, tokens[x], within, included))
            if not included:
                break
            used = after
            for d, w in out_edges.get(x, ()):
                if d not in seen:
                    heapq.heappush(heap, (-w, d))
        return pd.DataFrame(rows, columns=["repo", "node", "rank", "score", "tokens", "within", "included"])

    return n.groupBy("repo").cogroup(e.groupBy("_repo")).applyInPandas(run, "repo string, node string, rank bigint, score double, tokens bigint, within boolean, included boolean")


def rank_stats(ranked: DataFrame) -> DataFrame:
    """Per repository: ``n_ranked``, ``n_included``, ``tokens`` and ``bytes`` of the included, and whether the budget ended the run."""
    inc = F.sum(F.when(F.col("included"), F.col("tokens")).otherwise(0)).cast("bigint")
    return ranked.groupBy("repo").agg(F.count("*").alias("n_ranked"), F.count_if("included").alias("n_included"), inc.alias("tokens"), (inc * 4).alias("bytes"), (F.count_if(~F.col("included")) > 0).alias("exhausted"))


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 2) -> DataFrame:
    """Ranges of one key that touch or lie at most ``gap`` lines apart become one: ``keys``, start, end and ``n`` merged.

    Rows with a null bound are left out; a range that ends before it starts counts as its start.
    """
    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).alias("_s"), F.greatest(start, end).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(F.col("_s") - reach > gap, 1).when(reach.isNull(), 1).otherwise(0))
    ties = Window.partitionBy(*keys).orderBy("_s", "_e", F.desc("_new"))  # of equal ranges the one that opens the group comes first
    d = d.withColumn("_g", F.sum("_new").over(ties.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min("_s").alias(start), F.max("_e").alias(end), F.count("*").alias("n")).drop("_g")


def find_declaration(files: DataFrame, id_col: str, text_col: str, name: Column | str) -> DataFrame:
    """``id``, ``line``: the first line that declares ``name``, by five patterns in order within a line; null where none does.

    Names are taken literally. Lines are numbered from 1.
    """
    n = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    decl = F.concat(
        F.lit(r"^(?:export\s+)?(?:(?:default|async|abstract|declare)\s+)*(?:function|class|interface|type|enum|const|let)\s+"), n, F.lit(r"(?:[^\w$]|$)|^"), n, F.lit(r"\s*[:=]")
    )
    d = files.select(F.col(id_col).alias("id"), decl.alias("p"), F.posexplode(F.split(text_col, "\n")).alias("i", "l"))
    hit = d.where(F.rlike(F.trim(F.regexp_replace("l", r"[\r\t]", " ")), F.col("p"))).groupBy("id").agg((F.min("i") + 1).cast("bigint").alias("line"))
    return files.select(F.col(id_col).alias("id")).join(hit, "id", "left")


_SIMPLE = re.compile(r"(?:const|let|var|type|interface)\s+")
_OPENS = re.compile(r"(?:export\s+)?(?:function|class|interface|enum)\s+|(?:const|let)\s+\w+\s*=\s*(?:async\s*)?\(")


def expand_block(lines: list[str], at: int, up: int = 5, simple: int = 10, most: int = 100, cut_to: int = 50) -> tuple[int, int]:
    """(first, last) line of the block around line ``at`` (all from 1).

    A simple declaration reaches to the first ``;`` or ``}``, or ``simple`` + 1 lines on. Any other block begins at the
    declaration at most ``up`` lines above, if there is one, and ends where its braces balance; one that does
    not within ``most`` lines is cut ``cut_to`` lines on, and one without any brace is the line alone.
    """
    i = at - 1
    if i < 0 or i >= len(lines):
        return at, at
    if _SIMPLE.match(lines[i].strip()):
        stop = min(len(lines), i + simple + 2)
        return at, next((k for k in range(i, stop) if ";" in lines[k] or "}" in lines[k]), stop - 1) + 1
    first = next((k for k in range(i, max(0, i - up) - 1, -1) if _OPENS.match(lines[k].strip())), i)
    depth, opened = 0, False
    for k in range(first, len(lines)):
        opened = opened or "{" in lines[k]
        depth += lines[k].count("{") - lines[k].count("}")
        if opened and depth == 0:
            return first + 1, k + 1
        if k - first > most:
            return first + 1, min(k, first + cut_to) + 1
    return first + 1, max(first, i) + 1


def doc_above(lines: list[str], at: int) -> str | None:
    """The doc block that ends on the line right above line ``at``; only a line that is exactly ``*/`` ends one."""
    k = at - 2
    if k < 0 or lines[k].strip() != "*/":
        return None
    for j in range(k, -1, -1):
        if lines[j].strip().startswith("/**"):
            return "\n".join(lines[j : k + 1])
        if j < k and "*/" in lines[j]:
            return None
    return None


def slices(files: DataFrame, places: DataFrame, path_col: str = "path", text_col: str = "content", context: int = 3) -> DataFrame:
    """Code slices: ``repo``, ``path``, ``symbol``, start and end line, offsets, ``doc``, redaction-ready ``body`` and token estimates.

    ``files``: repo, path, content; ``places``: repo, path, symbol, line. A place outside its
    file gives an empty slice; null texts give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, text, symbol, line in b.itertuples(index=False):
                ls = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                s, e = expand_block(ls, int(line))
                body = "\n".join(ls[s - 1 : e])
                offset = sum(len(x) + 1 for x in ls[: s - 1])
                rows.append((repo, path, symbol, s, e, offset, offset + len(body), doc_above(ls, s), body, max(1, s - context), min(len(ls), e + context)))
            yield pd.DataFrame(rows, columns=["repo", "path", "symbol", "start_line", "end_line", "start_char", "end_char", "doc", "body", "from_line", "to_line"])

    j = files.select("repo", F.col(path_col).alias("path"), F.col(text_col).alias("text")).where("text is not null").join(places.select("repo", "path", "symbol", "line").where("line is not null"), ["repo", "path"])
    return j.select("repo", "path", "text", "symbol", "line").mapInPandas(
        run, "repo string, path string, symbol string, start_line bigint, end_line bigint, start_char bigint, end_char bigint, doc string, body string, from_line bigint, to_line bigint"
    )


def stubs(excluded: DataFrame) -> DataFrame:
    """Per package or file, the stub text of the symbols left out: ``excluded`` has owner, name, kind and, if packages occur, ``external``.

    A package's stubs stand in ``declare module``, a file's under its path.
    """
    ext = F.coalesce(F.col("external"), F.lit(False)) if "external" in excluded.columns else F.lit(False)
    s = excluded.select("owner", ext.alias("external"), sy.stub("name", "kind").alias("stub"), "name").where("name is not null").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "stub"))), lambda x: x["stub"]), "\n\n")
    g = s.groupBy("owner", "external").agg(text.alias("t"), F.count("*").alias("n"))
    inside = F.concat(F.lit('declare module "'), F.col("owner"), F.lit('" {\n'), F.regexp_replace(F.regexp_replace("t", "export declare ", "export "), r"(?m)^(?=.)", "  "), F.lit("\n}"))
    return g.select("owner", F.when(F.col("external"), inside).otherwise(F.concat(F.lit("// From "), F.col("owner"), F.lit("\n"), F.col("t"))).alias("text"), "n")


def stub_file(stubbed: DataFrame, header: str = "/** Declarations of symbols outside this pack. */") -> DataFrame:
    """One row: the stubs of all owners under a header, packages first; ``text`` and ``n``. For the symbols one pack leaves out."""
    order = F.struct(~F.col("text").startswith("declare module"), F.col("owner"), F.col("text"))
    return stubbed.agg(F.concat_ws("\n\n", F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "\n\n")).alias("text"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def left_out(graph: DataFrame, ranked: DataFrame) -> DataFrame:
    """Symbols of the graph that the ranking did not include: ``repo``, ``owner`` (package or file), ``name``, ``kind``, ``external``."""
    gone = graph.join(ranked.where("included").select("repo", "node"), ["repo", "node"], "left_anti")
    path, name = F.substring_index("node", "#", 1), F.substring_index("node", "#", -1)
    package = paths.package_of_installed(path)
    return gone.select("repo", F.coalesce(package, path).alias("owner"), name.alias("name"), sy.inferred_kind(name).alias("kind"), package.isNotNull().alias("external"))


def seed_problem(seed: Column, path_known: Column, path: Column, exported: Column, allow_private: bool = False) -> Column:
    """Why a seed cannot be used, by the first rule that holds; null if it can."""
    return (
        F.when(~seed["valid"], "INVALID_GRAMMAR")
        .when(path.rlike(r"\.d\.ts$"), "AMBIENT_TYPE")
        .when(path.startswith("../"), "PROJECT_REFERENCE")
        .when(~F.coalesce(path_known, F.lit(False)), "SEED_NOT_FOUND")
        .when(F.lit(not allow_private) & ~F.coalesce(exported, F.lit(True)), "NOT_EXPORTED")
    )


def incoming(edges: DataFrame, targets: DataFrame, weight: float = 2.0) -> DataFrame:
    """Edges that point at the targets, turned around: who refers to them, with a fixed weight."""
    t = targets.select("repo", F.col("node").alias("dst")).distinct()
    return edges.join(t, ["repo", "dst"], "left_semi").select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("referencedBy").alias("kind"), F.lit(weight).alias("weight")).distinct()


def sibling_edges(symbols: DataFrame) -> DataFrame:
    """Symbols of one file as neighbours in a chain by line, so that n symbols give n - 1 edges: repo, src, dst, kind."""
    w = Window.partitionBy("repo", "path").orderBy("line", "symbol")
    d = symbols.withColumn("after", F.lead("symbol").over(w)).where("after is not null")
    return d.select("repo", F.concat_ws("#", "path", "symbol").alias("src"), F.concat_ws("#", "path", "after").alias("dst"), F.lit("sameFileSibling").alias("kind"))


def scoped_sections(parts: DataFrame, budget_tokens: int = 20_000) -> DataFrame:
    """A scoped pack as text per repository: header, index, excerpts (the seed's file first, then by path and line) up to the first that overflows, summary if it still fits.

    ``parts``: repo, path, start_line, end_line, body, is_seed. Sections count by the mean token estimate of their
    text, header and index first. What is left out is counted at the end. ``repo``, ``text``, ``omitted``, ``tokens``.
    """
    of = lambda t: tx.tokens_average(F.length(t))
    body = F.concat(F.lit("==== EXCERPT: "), "path", F.lit(" L"), F.col("start_line").cast("string"), F.lit("–L"), F.coalesce(F.col("end_line"), F.col("start_line")).cast("string"), F.lit(" ====\n"), F.coalesce(tx.newlines("body"), F.lit("")))
    p = parts.select("repo", "path", "start_line", "is_seed", body.alias("s"))
    role = F.when(F.max("is_seed"), "seed").otherwise("file")
    line = F.concat(F.col("path"), F.lit(" ("), F.col("role"), F.lit(")"))
    files = p.groupBy("repo", "path").agg(role.alias("role"), F.count("*").alias("k")).select("repo", "path", "k", line.alias("line"))
    top = files.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("k").alias("k"), (F.sum(F.length("line") + 1) - 1 + len("==== INDEX ====\n")).alias("index_chars"))
    top = top.withColumn("head", F.concat(F.lit("==== SECTION: HEADER ====\nFiles: "), F.col("n_files").cast("string"), F.lit("\nExcerpts: "), F.col("k").cast("string")))
    top = top.withColumn("keep_head", of("head") <= budget_tokens).withColumn("used", F.when(F.col("keep_head"), of("head")).otherwise(0))
    size = tx.tokens_average("index_chars")
    top = top.withColumn("keep_idx", F.col("used") + size <= budget_tokens).withColumn("used", F.col("used") + F.when(F.col("keep_idx"), size).otherwise(0))
    # Only an index that fits is put together.
    kept = files.join(top.where("keep_idx").select("repo"), "repo", "left_semi").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("ls"))
    top = top.join(kept, "repo", "left").withColumn("idx", F.concat(F.lit("==== INDEX ====\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")))
    w = Window.partitionBy("repo").orderBy(F.desc("is_seed"), "path", "start_line", "s")
    run = p.join(top.select("repo", "used"), "repo").withColumn("t", of("s")).withColumn("total", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("used"))
    run = run.withColumn("included", F.max(F.col("total") > budget_tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)) == F.lit(False))
    x = run.groupBy("repo").agg(
        F.array_sort(F.collect_list(F.when(F.col("included"), F.struct((~F.col("is_seed")).alias("k"), "path", "start_line", "s")))).alias("ss"),
        F.count_if(~F.col("included")).alias("omitted"), F.coalesce(F.max(F.when(F.col("included"), F.col("total"))), F.max("used")).alias("tokens"),
    )
    x = x.join(top.select("repo", "head", "idx", "keep_head", "keep_idx"), "repo")
    summary = F.concat(F.lit("==== SUMMARY ====\nTotal tokens: "), F.col("tokens").cast("string"), F.lit("\nTruncated: "), F.when(F.col("omitted") > 0, "Yes").otherwise("No"))
    x = x.withColumn("summary", summary).withColumn("fits", F.col("tokens") + of("summary") <= budget_tokens)
    mark = F.when(F.col("omitted") > 0, F.concat(F.lit("…omitted "), F.col("omitted").cast("string"), F.lit(" excerpts due to budget constraints")))
    shown = F.when(F.size("ss") > 0, F.array_join(F.transform("ss", lambda y: y["s"]), "\n\n"))
    text = F.concat_ws("\n\n", F.when(F.col("keep_head"), F.col("head")), F.when(F.col("keep_idx"), F.col("idx")), shown, F.when(F.col("fits"), F.col("summary")), mark, F.lit("==== END ===="))
    return x.select("repo", text.alias("text"), "omitted", F.col("tokens").cast("bigint").alias("tokens"))
