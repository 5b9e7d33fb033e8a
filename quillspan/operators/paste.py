"""Paste packs: choosing files with reasons, signatures, totals and the rendered text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import paths
from quillspan.functions import text as tx
from quillspan.operators.manifest import first_fit

# Section marks of the rendered text.
HEADER, INDEX, SUMMARY, END = "==== SECTION: HEADER ====", "==== INDEX ====", "==== SUMMARY ====", "==== END ===="
SKIPPED_DIRS = ("node_modules", "dist", "build", "coverage", ".git")


def exclude_reason(path: str, extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, directories: tuple[str, ...] = SKIPPED_DIRS) -> Column:
    """Why a file is left out, by the first rule that says so; null if it stays."""
    any_of = lambda ps: F.greatest(*[paths.matches_pattern(path, p).cast("int") for p in ps], F.lit(0)) == 1
    inside = F.exists(F.split(paths.directory(path), "/"), lambda s: s.isin(*directories)) if directories else F.lit(False)
    reason = F.when(F.lit(bool(extensions)) & ~paths.extension(path).isin(*(extensions or [""])), "extension")
    reason = reason.when(F.lit(bool(include)) & ~any_of(include or ["\x00"]), "not included")
    reason = reason.when(F.lit(bool(exclude)) & any_of(exclude or ["\x00"]), "excluded")
    return reason.when(inside, "directory")


def choose(files: DataFrame, key: str, reason: Column, max_files: int = 100, max_loc: int = 50_000, max_bytes: int = 2_000_000, order: list[str] | None = None) -> DataFrame:
    """``files`` (path, size, loc) with ``included`` and ``exclude_reason``: the rules, then the budgets in path order.

    A file over what is left of a budget is skipped and the next is tried; 0 or null
    budgets take the default. A null size or loc counts as 0.
    """
    f = files.withColumn("exclude_reason", reason)
    open_ = f.where("exclude_reason is null").withColumn("one", F.lit(1).cast("bigint"))
    caps = {"one": max_files or 100, "loc": max_loc or 50_000, "size": max_bytes or 2_000_000}
    fit = first_fit(open_, key, [F.col(c) for c in (order or ["path"])], caps).drop("one")
    fit = fit.withColumn("exclude_reason", F.when(~F.col("included"), "budget exceeded"))
    return fit.unionByName(f.where("exclude_reason is not null").withColumn("included", F.lit(False)))


def totals(chosen: DataFrame, key: str) -> DataFrame:
    """Per pack: files, included and excluded ones, bytes and lines included, and whether anything was cut by a budget."""
    inc = lambda c: F.sum(F.when(F.col("included"), F.coalesce(c, F.lit(0))).otherwise(0)).cast("bigint")
    return chosen.groupBy(key).agg(
        F.count("*").alias("n_files"), F.count_if("included").alias("n_included"), F.count_if(~F.col("included")).alias("n_excluded"),
        inc("size").alias("total_bytes"), inc("loc").alias("total_loc"), (F.count_if(F.col("exclude_reason") == "budget exceeded") > 0).alias("truncated"),
    )


def non_source_excerpt(text: Column | str, whole: int = 50, head: int = 30) -> Column:
    """A text of at most ``whole`` lines as it is, else its first ``head`` lines and a mark."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n")
    return F.when(F.size(lines) <= whole, t).otherwise(F.concat(F.array_join(F.slice(lines, 1, head), "\n"), F.lit(f"\n\n... (content truncated after {head} lines)")))


_REGION = re.compile(r"(?:export )?(interface|type|class) ")
_ALWAYS = re.compile(r"import|//|/\*|\*|export(?!.*(?:function|const))")
_FUNCTION = re.compile(r"(?:export )?(?:async )?function ")
_VALUE = re.compile(r"(?:export )?(?:const|let) (?=.*:)")


def signature_lines(text: str) -> str:
    """What a module declares, by the shape of its lines: imports, exports, comments, interfaces and types whole, functions up to their body, members of classes.

    A line is judged by its first words and by the region (interface, type, class) it lies in; a region ends
    where braces balance. Braces in strings and comments count, and a type of one line keeps what follows
    up to the next balance.
    """
    out: list[str] = []
    regions: set[str] = set()
    depth, body = 0, False
    for line in text.split("\n"):
        t = line.strip()
        opens = _REGION.match(t)
        if opens:
            regions.add(opens.group(1))
            depth, body = 0, False
        brace = line.find("{")
        if _ALWAYS.match(t) or regions & {"interface", "type"}:
            out.append(line)
        elif _FUNCTION.match(t):
            out.append(line if brace < 0 else line[:brace].rstrip() + ";")
            body = body or brace >= 0
        elif _VALUE.match(t):
            arrow = line.find("=>")
            if arrow >= 0:
                out.append(line[: arrow + 2].rstrip() + " { /* ... */ }")
            elif brace >= 0:
                continue  # an object literal is left out, braces and all
            else:
                out.append(line)
        elif "class" in regions and not body and t:
            if "(" in t and ")" in t and brace >= 0:
                out.append(line[:brace].rstrip() + " { /* ... */ }")
                body = True
            else:
                out.append(line)
        for c in t:
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                regions.clear()
                body = False
            elif c == "}" and depth == 1 and "class" in regions:
                body = False
    return "\n".join(out)


def signatures(files: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """``id``, ``signatures``: declarations of TypeScript and JavaScript files, an excerpt of all others. Null texts give null."""
    f = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("t"))
    source = paths.extension("path").isin("ts", "tsx", "js", "jsx") & F.col("t").isNotNull()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "signatures": [signature_lines(t) for t in b["t"]]})

    schema = f"id {f.schema['id'].dataType.simpleString()}, signatures string"
    a = f.where(F.coalesce(source, F.lit(False))).select("id", "t").mapInPandas(run, schema)
    return a.unionByName(f.where(~F.coalesce(source, F.lit(False))).select("id", non_source_excerpt("t").alias("signatures")))


def render(chosen: DataFrame, key: str, title: str = "Pack", most_excluded: int = 20) -> DataFrame:
    """The rendered pack per key: header, index, files, summary; ``chosen`` has path, content, loc, size, included, exclude_reason.

    A pack's text is one value, so it must fit the budgets of ``choose``; of the excluded
    files, ``most_excluded`` are listed and the rest counted.
    """
    inc = chosen.where("included")
    body = inc.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("path", F.coalesce("loc", F.lit(0)).cast("string").alias("loc"), F.coalesce(tx.redacted("content"), F.lit("")).alias("text")))).alias("fs"),
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
    )
    w = Window.partitionBy(key).orderBy("path")
    exc = chosen.where("not included").withColumn("rn", F.row_number().over(w)).groupBy(key).agg(
        F.count("*").alias("n_exc"), F.sort_array(F.collect_list(F.when(F.col("rn") <= most_excluded, F.concat_ws(": ", "path", "exclude_reason")))).alias("ex")
    )
    line = lambda x: F.concat(F.lit("==== FILE: "), x["path"], F.lit(" (LOC "), x["loc"], F.lit(") ====\n"), x["text"])
    more = F.when(F.col("n_exc") > most_excluded, F.concat(F.lit("and "), (F.col("n_exc") - most_excluded).cast("string"), F.lit(" more")))
    return body.join(exc, key, "left").select(
        key,
        F.concat_ws(
            "\n", F.lit(HEADER), F.lit(title), F.lit(INDEX), F.array_join(F.transform("fs", lambda x: x["path"]), "\n"), F.array_join(F.transform("fs", line), "\n"),
            F.lit(SUMMARY), F.concat(F.size("fs").cast("string"), F.lit(" files, "), F.col("bytes").cast("string"), F.lit(" bytes")), F.array_join(F.coalesce("ex", F.array().cast("array<string>")), "\n"), more, F.lit(END),
        ).alias("text"),
    )
