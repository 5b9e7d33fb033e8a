"""Sinks: canonical JSON, NDJSON, packs in variants, reports as text."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import text as tx
from quillspan.operators import budget


def canonical_type(t: T.DataType) -> T.DataType:
    """The type with struct fields in alphabetical order, at all depths."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, canonical_type(f.dataType), f.nullable) for f in sorted(t.fields, key=lambda f: f.name)])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(canonical_type(t.elementType), t.containsNull)
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, canonical_type(t.valueType), t.valueContainsNull)
    return t


def _ordered(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(c, lambda x: _ordered(x, t.elementType))
    if isinstance(t, T.MapType):
        keys = F.array_sort(F.map_keys(c))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _ordered(c[k], t.valueType)))
    return c


def canonical_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object: keys sorted at all depths, nulls written as ``null``."""
    fields = [_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def write_ndjson(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One canonical object per line; sorted over all part files if an order is given."""
    out = df.orderBy(*order) if order else df
    canonical_json(out).write.mode("overwrite").text(path)


def write_json(row: dict, path: str, deterministic: bool = True) -> None:
    """One document, compact if deterministic, else indented; keys sorted."""
    text = json.dumps(row, sort_keys=True, separators=(",", ":") if deterministic else None, indent=None if deterministic else 2, default=str, ensure_ascii=False)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text + ("" if deterministic else "\n"))


def scope_directory(out: str, **config: object) -> str:
    """The directory of a scoped pack: named by the first 16 hex digits of its configuration's hash."""
    text = json.dumps({k: config[k] for k in sorted(config)}, sort_keys=True, separators=(",", ":"))
    return os.path.join(out, hashlib.sha256(text.encode()).hexdigest()[:16])


def write_variants(artifacts: dict[str, DataFrame], out: str, members: dict[str, tuple[str, ...]]) -> list[str]:
    """Each variant's artifacts as NDJSON directories, and ``index.json`` of what was written with each variant's token estimates."""
    written, tokens = [], {}
    for variant, names in members.items():
        for n in names:
            if n in artifacts:
                p = os.path.join(out, variant, n + ".ndjson")
                write_ndjson(budget.project(n, artifacts[n], variant), p)
                written.append(p)
        texts = [canonical_json(budget.project(n, artifacts[n], variant), "text").select(F.lit(n).alias("id"), "text") for n in names if n in artifacts]
        if texts:
            tokens[variant] = artifact_totals(functools.reduce(DataFrame.unionByName, texts)).first().asDict()
    write_json({"paths": sorted(written), "tokens": tokens}, os.path.join(out, "index.json"))
    return written


def artifact_totals(texts: DataFrame) -> DataFrame:
    """One row on the lines of artifacts (``id``, ``text``): how many artifacts, their bytes, and the token estimates of all text together.

    Lengths are added up before they are divided, as if the texts were one; every line counts with its line feed.
    """
    t = texts.agg(F.countDistinct("id").alias("n_artifacts"), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("bigint").alias("total_bytes"), F.coalesce(F.sum(F.length("text") + 1), F.lit(0)).cast("bigint").alias("chars"))
    return t.select("n_artifacts", "total_bytes", tx.tokens_conservative("chars").alias("conservative"), tx.tokens_optimistic("chars").alias("optimistic"), tx.tokens_average("chars").alias("average"))


def show(artifact: DataFrame, out: TextIO | None = None) -> int:
    """Print an artifact line by line as canonical JSON, in order; partitions come one at a time. Returns the number of lines."""
    n = 0
    for r in canonical_json(artifact, "text").orderBy("text").toLocalIterator():
        print(r.text, file=out or sys.stdout)
        n += 1
    return n


def report_text(row: dict) -> str:
    """A refactoring report as plain text."""
    lines = [f"Refactoring report: {row.get('repo')}", f"Risk: {row.get('risk_level')} ({row.get('risk_score')})", ""]
    lines += [f"  {k}: {row[k]}" for k in ("n_nodes", "max_fan_in", "max_fan_out", "max_reexports", "n_components", "max_hotspot") if k in row]
    return "\n".join([*lines, "", "Actions:", *[f"  - {a}" for a in row.get("actions", [])], ""])


def prompt_text(slices: DataFrame, key: str) -> DataFrame:
    """Per key, its slices one after the other under their places, in order of path and line."""
    head = F.concat(F.lit("### "), F.col("path"), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"))
    s = slices.where("body is not null").select(key, F.struct("path", "start_line", F.concat(head, F.col("body")).alias("t")).alias("x"))
    return s.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("prompt"))


def _document(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """All rows as one JSON array. It is one value, so a table of more than ``most`` rows is an error; ``ndjson`` has no such bound."""
    rows = canonical_json(df)
    if rows.limit(most + 1).count() > most:
        raise EngineError("E401", f"a JSON document holds at most {most} rows")
    return rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]")).alias("text"))


def _sections(df: DataFrame) -> DataFrame:
    """Artifacts (``id``, ``text``) as text sections, one row each, with a first and a last one around them; ``position`` orders them."""
    line = F.concat(F.lit("==== ARTIFACT: "), F.col("id"), F.lit(" ====\n"), F.coalesce("text", F.lit("")))
    n = df.agg(F.count("*").alias("n"))
    head = n.select(F.lit(0).alias("rank"), F.lit("").alias("position"), F.concat(F.lit("==== SECTION: HEADER ====\nFiles: "), F.col("n").cast("string"), F.lit("\n\n==== SECTION: ARTIFACTS ====")).alias("text"))
    tail = n.select(F.lit(2).alias("rank"), F.lit("").alias("position"), F.lit("==== END ====").alias("text"))
    return head.unionByName(df.select(F.lit(1).alias("rank"), F.col("id").alias("position"), line.alias("text"))).unionByName(tail)


FORMATTERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "json": ("application/json", _document),
    "ndjson": ("application/x-ndjson", lambda df: canonical_json(df, "text")),
    "paste": ("text/plain", _sections),
}

# Error codes with their category and exit code.
ERROR_CODES = {
    "E101": ("FileSystem", 3), "E102": ("FileSystem", 3), "E103": ("FileSystem", 3), "E201": ("Collector", 5), "E202": ("Collector", 5), "E203": ("Collector", 5),
    "E301": ("Engine", 4), "E401": ("Validation", 2), "E701": ("Validation", 2), "E702": ("Validation", 2),
}


class EngineError(Exception):
    """An error with a code, which gives its category and exit code; unknown codes are ``Unknown`` and exit with 1."""

    def __init__(self, code: str, message: str, exit_code: int | None = None) -> None:
        super().__init__(f"[{code}] {message}")
        self.code = code
        self.category, known = ERROR_CODES.get(code, ("Unknown", 1))
        self.exit_code = known if exit_code is None else exit_code


def error_report(errors: list[EngineError]) -> str:
    """One line per error, grouped by category, worst first."""
    ordered = sorted(errors, key=lambda e: (-e.exit_code, e.category, e.code))
    return "\n".join(f"{e.category}: {e}" for e in ordered)


def worst_exit(errors: list[EngineError]) -> int:
    return max((e.exit_code for e in errors), default=0)
