"""Generated, minified or vendored source files.

Where the text of a file is at hand, its layout decides: the text is lexed by its
language, emitted again in canonical layout (``printer.canonical``), and the two layouts
are compared. Literals that dominate the tokens mark data saved as code, extreme expansion
marks minified code, and canonical lines that repeat one pattern throughout mark
generated code.

Copies of others' code look like any other code, so the path tells them: the segments
and suffixes that tools and package managers give their output. A file whose text is not
at hand is judged by its path and by the layout that its bytes and lines imply.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.printer import canonical

# What tools call their output, and where copies of others' code are kept.
GENERATED_SEGMENTS = ("generated", "__generated__", "autogen", "_autogen", "codegen-output", ".next", ".nuxt", ".svelte-kit")
BUILT_SEGMENTS = ("dist", ".turbo", "__pycache__")
VENDORED_SEGMENTS = ("vendor", "vendored", "third-party", "third_party", "extern", "external", "bower_components", "node_modules", "site-packages", "jspm_packages")
GENERATED_NAME = r"(\.(pb|gen|generated|g)\.[a-z]+|_pb2(_grpc)?\.py|[._]generated\.py)$"
BUNDLED_NAME = r"((\.|-|_)min\.[mc]?js|(\.|-)bundle\.[mc]?js|\.chunk\.[mc]?js)$"
VERSIONED_SEGMENT = r"/[A-Za-z0-9_.]*[A-Za-z][\w.]*[-@]v?\d+\.\d+\.\d+[^/]*/"
SOURCE = r"\.(ts|tsx|js|mjs|py)$"


def not_handwritten(
    files: DataFrame, texts: DataFrame | None = None, long_lines: float = 200.0, short_lines: float = 15.0, many_lines: int = 500,
    expansion: float = 5.0, literal_share: float = 0.9, uniformity: float = 0.8, least_chars: int = 500, least_data_chars: int = 2000,
) -> DataFrame:
    """Classify the source files of a file table.

    ``files`` needs file_id, repo, path, bytes, loc; ``texts`` (optional) repo, path,
    content. One row per row of ``files`` whose path names a source language:
    ``file_id``, ``repo``, ``path``, ``reason`` (``data``, ``minified``, ``generated``,
    ``vendored`` or null), ``evidence`` (``layout``, ``path``, ``size`` or null),
    ``has_text`` and ``handwritten``. The first reason that holds is given: what the
    text's layout shows, then the path, then bytes and lines. Layouts of texts below
    ``least_chars`` (data: ``least_data_chars``) say nothing. Null bytes or loc count as
    unknown, a loc of 0 as one line; a null path is no source file; of several texts of a
    path the longest counts. Empty tables give an empty result. ``kind`` is not
    trusted: it is missing or wrong at times and says nothing about who wrote a file.
    """
    low = F.lower("path")
    inside = F.concat(F.lit("/"), low)
    seg = lambda names: F.exists(F.split(low, "/"), lambda s: s.isin(*names))
    f = files.select("file_id", "repo", "path", "bytes", "loc").where(low.rlike(SOURCE))
    per_line = F.col("bytes") / F.greatest(F.col("loc"), F.lit(1))
    figures = "n_chars bigint, expansion double, uniformity double, literal_share double"
    if texts is None:
        f = f.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in figures.split(", ")})
    else:

        def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [canonical(t, p.lower().endswith(".py")) for t, p in zip(b.content, b.path, strict=True)]
                yield b[["repo", "path"]].assign(n_chars=b.content.str.len(), expansion=[x.expansion for x in got], uniformity=[x.uniformity for x in got], literal_share=[x.literal_share for x in got])

        t = texts.select("repo", "path", "content").where("content is not null and content <> ''").where(F.lower("path").rlike(SOURCE))
        lexed = t.mapInPandas(lex, f"repo string, path string, {figures}")
        per = lexed.groupBy("repo", "path").agg(F.max_by(F.struct("n_chars", "expansion", "uniformity", "literal_share"), "n_chars").alias("m")).select("repo", "path", "m.*")
        f = f.join(per, ["repo", "path"], "left")
    long = F.col("n_chars") >= least_chars
    of = lambda reason, evidence: F.struct(F.lit(reason).alias("reason"), F.lit(evidence).alias("evidence"))
    found = (
        F.when((F.col("literal_share") >= literal_share) & (F.col("n_chars") >= least_data_chars), of("data", "layout"))
        .when(long & (F.col("expansion") >= expansion), of("minified", "layout"))
        .when(long & (F.col("uniformity") >= uniformity), of("generated", "layout"))
        .when(seg(VENDORED_SEGMENTS) | inside.rlike(VERSIONED_SEGMENT), of("vendored", "path"))
        .when(seg(GENERATED_SEGMENTS) | low.rlike(GENERATED_NAME), of("generated", "path"))
        .when(seg(BUILT_SEGMENTS) | low.rlike(BUNDLED_NAME), of("minified", "path"))
        .when((per_line < short_lines) & (F.col("loc") >= many_lines), of("data", "size"))
        .when(per_line >= long_lines, of("minified", "size"))
    )
    return f.withColumn("found", found).select(
        "file_id", "repo", "path", F.col("found.reason").alias("reason"), F.col("found.evidence").alias("evidence"), F.col("n_chars").isNotNull().alias("has_text"), F.col("found").isNull().alias("handwritten")
    )


def evidence_counts(classified: DataFrame) -> DataFrame:
    """Files per ``has_text``, ``evidence`` and ``reason`` (null for hand-written ones): how much each kind of evidence decides."""
    return classified.groupBy("has_text", "evidence", "reason").agg(F.count("*").alias("n_files"))
