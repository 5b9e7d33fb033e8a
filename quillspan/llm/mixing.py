"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are wanted ``r = share * total / size`` times on average. Each
gets the whole part of r; the fractional parts are rounded in pairs: probability mass
(in tokens) moves between two documents until one of them is 0 or 1, in a direction
drawn so that each document's expectation is kept and the source's token total does
not move at all. Partitions round their own documents; the one document that is left
over in each is combined with the others through a tree of groups, until one per
source is left, which is rounded alone. A source misses its target by one document.
"""

from __future__ import annotations

import base64
import functools
import random
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut

_FAN = 32


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of whole texts in a public byte-level BPE; null texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoding(vocabulary)
        for b in batches:
            yield b[["doc_id", "source"]].assign(n_tokens=[len(e.encode_ordinary(t)) if t else 0 for t in b["text"]])

    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")


def _move(a: list, b: list, u: float) -> None:
    """Move mass between [p, weight, ..] items a and b until one is 0 or 1; token total and expectations are kept."""
    pa, wa, pb, wb = a[0], a[1], b[0], b[1]
    up = min((1 - pa) * wa, pb * wb)  # tokens that can go from b to a
    down = min(pa * wa, (1 - pb) * wb)  # from a to b
    step = up if u * (up + down) < down else -down
    a[0], b[0] = pa + step / wa, pb - step / wb
    for x in (a, b):
        if x[0] < 1e-9:
            x[0] = 0.0
        elif x[0] > 1 - 1e-9:
            x[0] = 1.0


def round_pairs(rows: list[list], seed: int) -> tuple[list[list], list | None]:
    """Pivotal rounding of [p, weight, id, ..] rows with 0 < p < 1: the settled rows and the one left over."""
    left, done = None, []
    for r in rows:
        if left is None:
            left = r
            continue
        u = random.Random(xxhash.xxh64_intdigest(f"{left[2]}/{r[2]}", seed)).random()
        _move(left, r, u)
        open_ = [x for x in (left, r) if 0.0 < x[0] < 1.0]
        done += [x for x in (left, r) if not 0.0 < x[0] < 1.0]
        left = open_[0] if open_ else None
        if len(open_) == 2:
            raise AssertionError("a move settles at least one of two")
    return done, left


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, broadcast_sources: int = 100_000) -> DataFrame:
    """Copies of each document in a mixture with the sources' target shares.

    ``sized``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats
    (one row per source; shares of sources without tokens cannot be met). ``total`` is
    the mixture's size in tokens; by default the largest for which no source needs more
    than its repeats. Rows: ``doc_id``, ``source``, ``n_tokens``, ``copies`` for every
    document of a listed source, also those with 0 copies. No document has more copies
    than ``max_repeats``. Documents of unlisted or null sources, of 0 or null tokens,
    and targets of null or zero share take no part. Empty tables give no rows. Rows that
    repeat an id are documents of their own. If ``total`` is more than the repeats allow,
    a source stops at its repeats and ``mix_report`` shows what it reached. The targets
    are broadcast only if they count at most ``broadcast_sources``.
    """
    t = targets.where("target_share > 0 and max_repeats > 0 and source is not null").groupBy("source").agg(F.first("target_share").alias("share"), F.first("max_repeats").alias("cap"))
    t = cut(t)
    small = F.broadcast if t.count() <= broadcast_sources else lambda x: x
    d = sized.select("doc_id", "source", "n_tokens").where("n_tokens > 0 and source is not null").join(small(t), "source")
    d = cut(d)
    size = d.groupBy("source", "share", "cap").agg(F.sum("n_tokens").alias("size"))
    total_row = size.agg(F.min(F.col("cap") * F.col("size") / F.col("share")).alias("most"))
    rate = size.crossJoin(F.broadcast(total_row)).select(  # one row
        "source", "cap", F.least(F.col("share") * (F.lit(float(total)) if total else F.col("most")) / F.col("size"), F.col("cap").cast("double")).alias("r")
    )
    d = d.drop("share", "cap").join(small(rate), "source")
    # max_repeats * size / share * share / size need not be max_repeats again in floating point.
    d = d.withColumn("r", F.when(F.abs(F.col("r") - F.round("r")) < 1e-9, F.round("r")).otherwise(F.col("r")))
    d = d.select("doc_id", "source", "n_tokens", F.floor("r").cast("bigint").alias("base"), (F.col("r") - F.floor("r")).alias("p"))
    schema = "doc_id bigint, source string, n_tokens bigint, base bigint, p double"

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("source", sort=True):
            xs = [[p, w, i, b] for p, w, i, b in zip(g.p, g.n_tokens, g.doc_id, g.base, strict=True)]
            done, left = round_pairs([x for x in xs if 0 < x[0] < 1], seed)
            done += [x for x in xs if x[0] <= 0 or x[0] >= 1]
            s = g.source.iloc[0]
            uniq = {id(x): x for x in [*done, *([left] if left else [])]}
            out += [(x[2], s, x[1], x[3], x[0]) for x in uniq.values()]
        return pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "base", "p"])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Batches are bounded; what a batch leaves over is carried into the next one.
        carry: pd.DataFrame | None = None
        for b in batches:
            b = settle(b if carry is None else pd.concat([carry, b], ignore_index=True))
            open_ = (b.p > 0) & (b.p < 1)
            carry = b[open_]
            yield b[~open_]
        if carry is not None and len(carry):
            yield carry

    # What a partition does depends on its rows' order, so each level is written before the next one reads it.
    level = cut(d.mapInPandas(within, schema))
    closed = [level.where("p <= 0 or p >= 1")]
    rest = level.where("p > 0 and p < 1")
    n = rest.count()
    while n:
        groups = max(1, n // _FAN)
        g = F.pmod(F.xxhash64("doc_id"), F.lit(groups))
        rest = cut(rest.groupBy("source", g.alias("g")).applyInPandas(lambda x: settle(x.sort_values("doc_id")), schema))
        closed.append(rest.where("p <= 0 or p >= 1"))
        rest = rest.where("p > 0 and p < 1")
        n = rest.count()
        if groups == 1:
            break
    last = rest.withColumn("p", F.when((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)) < F.col("p"), 1.0).otherwise(0.0))
    out = functools.reduce(DataFrame.unionByName, [*closed, last])
    return out.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("bigint")).alias("copies"))


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``target_share``, ``actual_share``, ``share_error``, ``n_docs``, ``n_tokens`` used, ``most_copies``, ``mean_copies``.

    ``error_bound`` is the largest document of all sources over the whole: where no source stops
    at its repeats, rounding moves a source by less than one document.
    """
    m = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count_if(F.col("copies") > 0).alias("n_docs"), F.max("copies").alias("most_copies"), F.avg("copies").alias("mean_copies"), F.max("n_tokens").alias("largest"),
    )
    whole = m.agg(F.sum("n_tokens").alias("whole"), F.max("largest").alias("largest_doc"))
    actual = F.coalesce("n_tokens", F.lit(0)) / F.col("whole")
    return (
        targets.join(m, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", actual.alias("actual_share"), (actual - F.col("target_share")).alias("share_error"), (F.col("largest_doc") / F.col("whole")).alias("error_bound"),
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "most_copies", "mean_copies")),
        )
    )
