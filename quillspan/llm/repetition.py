"""Repetition inside a single document, with adaptive thresholds per language and source.

The share of repeated words is measured over each whole document, once. Per (language,
source) a mergeable KLL quantile sketch holds the group's shares; the sketches of a
language, and of all, are merged from these. A sketch's quantiles tell the usual level
of its group from what breaks out of it: the threshold lies a part (``rise``) of the way
up the first jump of at least ``jump`` between neighbouring quantiles. A group without such a
jump, or one whose median is itself beyond the level of all, takes its language's
threshold, else that of all documents; where nothing jumps, nothing is repetitive. The
measured rows are then joined with the thresholds and filtered. The sketches have a
fixed size, so a group of any size is one small row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import stored

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"\n\s*\n|(?<=[.!?])\s+")


def repeated_words(text: str, n: int = 6) -> tuple[int, int]:
    """(words, words inside n-grams that already occurred earlier in the text)."""
    ws = _WORD.findall(text.lower())
    seen: set[tuple[str, ...]] = set()
    covered = upto = 0
    for i in range(len(ws) - n + 1):
        g = tuple(ws[i : i + n])
        if g in seen:
            covered += i + n - max(upto, i)
            upto = i + n
        else:
            seen.add(g)
    return len(ws), covered


def repeated_parts(text: str) -> float:
    """Share of characters in sentences or paragraphs that repeat an earlier one."""
    seen: set[str] = set()
    total = again = 0
    for part in _BREAK.split(text):
        key = " ".join(part.split()).lower()
        total += len(key)
        if len(key) >= 20 and key in seen:
            again += len(key)
        seen.add(key)
    return again / total if total else 0.0


def _break(quantiles: Column, jump: float, rise: float) -> Column:
    """The threshold that ascending quantiles show, or null."""
    ups = F.zip_with(F.slice(quantiles, 1, F.size(quantiles) - 1), F.slice(quantiles, 2, F.size(quantiles) - 1), lambda a, b: F.struct(a.alias("a"), (b - a).alias("up")))
    first = F.get(F.filter(ups, lambda x: x["up"] >= jump), F.lit(0))
    return first["a"] + first["up"] * F.lit(rise)


def repetition(
    df: DataFrame, id_col: str, text_col: str, lang_col: str | None = "lang", source_col: str | None = "source",
    n: int = 6, jump: float = 0.15, rise: float = 0.25, accuracy: int = 1024, ranks: int = 400, broadcast_groups: int = 100_000,
) -> DataFrame:
    """Repeated share of each document and whether it passes its group's threshold.

    One row per input row: ``doc_id``, ``lang`` (lower case, ``und`` for null),
    ``source``, ``n_words``, ``repeated_words``, ``repeated_share``,
    ``repeated_part_share``, ``threshold`` (null where no level breaks) and ``repetitive``.
    Words are runs of letters; case, digits, punctuation and spacing do not count. Null
    and empty texts have 0 words, share 0 and are never repetitive; a repeated row is
    measured again. ``accuracy`` is the sketches' size, ``ranks`` the number of quantiles
    read between the median and the largest share.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(*repeated_words(t or "", n), repeated_parts(t or "")) for t in b["text"]]
            yield b[["doc_id", "lang", "source"]].assign(n_words=[x[0] for x in got], repeated_words=[x[1] for x in got], repeated_part_share=[x[2] for x in got])

    src = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.lower(F.coalesce(F.col(lang_col), F.lit("und"))) if lang_col else F.lit("und")).alias("lang"),
        (F.coalesce(F.col(source_col), F.lit("")) if source_col else F.lit("")).alias("source"),
    )
    m = src.mapInPandas(measure, "doc_id bigint, lang string, source string, n_words bigint, repeated_words bigint, repeated_part_share double")
    # Read twice, so written once: a row of figures per document, no text.
    m = stored(m.withColumn("repeated_share", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(0.0)))
    at = F.array(*(F.lit(0.5 + 0.5 * i / ranks) for i in range(ranks + 1)))
    read = lambda sketch: F.kll_sketch_get_quantile_double(sketch, at)
    groups = m.groupBy("lang", "source").agg(F.kll_sketch_agg_double("repeated_share", accuracy).alias("sketch"))
    groups = stored(groups)
    langs = groups.groupBy("lang").agg(F.kll_merge_agg_double("sketch", accuracy).alias("s")).select("lang", _break(read("s"), jump, rise).alias("of_lang"))
    every = groups.agg(F.kll_merge_agg_double("sketch", accuracy).alias("s")).where("s is not null").select(_break(read("s"), jump, rise).alias("of_all"))  # one row
    q = groups.select("lang", "source", read("sketch").alias("q")).withColumn("own", _break(F.col("q"), jump, rise))
    usual = F.coalesce(F.get("q", F.lit(0)) < F.col("of_all"), F.lit(True))
    # Groups are few, but their number is checked before they are broadcast.
    few = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    small = F.broadcast if few else lambda x: x
    level = q.join(small(langs), "lang", "left").join(F.broadcast(every), F.lit(True), "left").select(
        "lang", "source", F.coalesce(F.when(usual, F.col("own")), F.col("of_lang"), F.col("of_all")).alias("threshold")
    )
    return m.join(small(level), ["lang", "source"], "left").select(
        "doc_id", "lang", "source", "n_words", "repeated_words", "repeated_share", "repeated_part_share", "threshold",
        ((F.col("n_words") >= n) & F.coalesce(F.col("repeated_share") >= F.col("threshold"), F.lit(False))).alias("repetitive"),
    )
