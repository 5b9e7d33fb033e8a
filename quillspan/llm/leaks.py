"""Evaluation texts leaking into training text (winnowing).

Both sides keep the minimal ``k``-gram hash of every window of ``w`` word k-grams;
any run of ``k + w - 1`` equal words shares a kept hash. Fingerprints are joined, hits
are gathered per document as the items and diagonals they lie on, and every such diagonal is
extended over the words of both texts. A passage of 25 words of which one in ten is
replaced keeps at least one hit with the default k = 5, w = 3. A document's text travels
once, with all its items, so a fingerprint that many items share (such as a common
opening) costs a look at words already at hand and no further copies of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.spans import sliding_min
from quillspan.session import stored

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&[a-z]{2,8};")
_LEAD = re.compile(r"(?m)^[ \t]*(?:(?:[>|*+#-]+|\d{1,3}[.)])[ \t]+)+")
_MARK = re.compile(r"[^\w\s]+|_+")


def words(text: str) -> list[str]:
    """Lower-case words without markup: tags, entities, list and quote marks are dropped, and punctuation inside words too.

    A word is what stands between blanks, so a path or a dotted name is one word, and so
    is whatever it was replaced by.
    """
    return _MARK.sub("", _LEAD.sub(" ", _TAG.sub(" ", text)).lower()).split()


def fingerprints(ws: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) kept by winnowing; a text of k to k + w - 2 words keeps its minimum."""
    n = len(ws) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in ws), np.uint64, len(ws))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = (h ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    low = sliding_min(h, min(w, n))
    keep = np.zeros(n, bool)
    for i in range(min(w, n)):
        keep[i : i + len(low)] |= h[i : i + len(low)] == low
    pos = np.flatnonzero(keep)
    return pos, h[pos].view(np.int64)


def longest_match(a: list[str], b: list[str], diagonal: int, min_words: int, one_in: int) -> tuple[int, int, int] | None:
    """Longest (start in a, length, replaced) on the diagonal with at most one word in ``one_in`` replaced."""
    lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
    if hi - lo < min_words:
        return None
    same = np.fromiter((x == y for x, y in zip(a[lo:hi], b[lo - diagonal : hi - diagonal], strict=True)), bool, hi - lo)
    # A stretch is good if its sum of +1 (equal) and 1 - one_in (replaced) is not negative.
    s = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - one_in))])
    best: tuple[int, int] | None = None
    first = np.minimum.accumulate(s)  # leftmost start for an end: first place where the prefix sum is small enough
    for end in range(min_words, len(s)):
        at = int(np.searchsorted(-first, -s[end], side="left"))
        while at < end and not same[at]:
            at += 1
        if end - at >= min_words and same[end - 1] and s[end] >= s[at] and (best is None or end - at > best[1] - best[0]):
            best = (at, end)
    if best is None:
        return None
    at, end = best
    return lo + at, end - at, int((~same[at:end]).sum())


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str,
    min_words: int = 25, one_in: int = 10, k: int = 5, w: int = 3, broadcast_rows: int = 500_000, broadcast_bytes: int = 32_000_000, salts: int = 16,
) -> DataFrame:
    """Which documents contain passages of which items.

    One row per (``doc_id``, ``item_id``) with the longest passage: ``doc_word``,
    ``item_word`` (word offsets), ``n_words``, ``n_replaced`` and
    ``item_share`` (passage over the item's words). The items' fingerprints are
    broadcast only if they count at most ``broadcast_rows`` (24 bytes each), else shuffled, each to
    ``salts`` places, so that a fingerprint of very many documents is met by as many tasks; the items' texts only if they take
    at most ``broadcast_bytes``, else joined by item; the same rows result. Null and empty texts give no rows, nor do empty tables; a repeated
    item or document id counts as each of its rows.
    """

    def prints(idc: str, txt: str, df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, ps, hs = [], [], []
                for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                    p, h = fingerprints(words(t), k, w)
                    ids.append(np.full(len(p), i, np.int64))
                    ps.append(p)
                    hs.append(h)
                if ids:
                    yield pd.DataFrame({"i": np.concatenate(ids), "p": np.concatenate(ps), "h": np.concatenate(hs)})

        src = df.select(F.col(idc).cast("bigint").alias("i"), F.col(txt).alias("t")).where("t is not null and i is not null")
        return src.mapInPandas(run, "i bigint, p bigint, h bigint").toDF(f"{name}_id", f"{name}_pos", "h")

    right = stored(prints(item_id, item_text, items, "item"))  # counted and joined
    left = prints(doc_id, doc_text, docs, "doc")
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hits = left.join(F.broadcast(right), "h")
    else:
        left = left.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        hits = left.join(right.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["h", "s"])
    diagonals = (
        hits.select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("d")).distinct()
        .groupBy("doc_id", "item_id").agg(F.collect_list("d").alias("ds"))
    )
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("dt")).where("dt is not null")
    it = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("it")).where("it is not null")
    schema = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, n_replaced bigint, item_share double"

    def passage(di: int, a: list[str], ii: int, bw: list[str], ds: list[int]) -> tuple | None:
        found = [(m, int(x)) for x in ds if (m := longest_match(a, bw, int(x), min_words, one_in))]
        if not found:
            return None
        (at, n, replaced), x = max(found, key=lambda f: (f[0][1], -f[0][0], -f[1]))
        return di, ii, at, at - x, n, replaced, n / len(bw)

    if (it.agg(F.sum(F.octet_length("it"))).first()[0] or 0) <= broadcast_bytes:
        known: dict[int, list[list[str]]] = {}
        for i, t in it.toLocalIterator():  # its size has just been checked
            known.setdefault(i, []).append(words(t))
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = shared.value
            for b in batches:
                rows = []
                for di, dt, near in zip(b.doc_id, b["dt"], b.near, strict=True):
                    a = words(dt)
                    rows += [p for x in near for bw in of[x["item_id"]] if (p := passage(di, a, x["item_id"], bw, x["ds"]))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        found = diagonals.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "ds")).alias("near")).join(d, "doc_id").mapInPandas(extend, schema)
    else:

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [passage(di, words(dt), ii, words(t), ds) for di, ii, ds, dt, t in zip(b.doc_id, b.item_id, b.ds, b["dt"], b["it"], strict=True)]
                yield pd.DataFrame([r for r in rows if r], columns=[c.split()[0] for c in schema.split(", ")])

        found = diagonals.join(it, "item_id").join(d, "doc_id").mapInPandas(meet, schema)
    best = F.max_by(F.struct("doc_word", "item_word", "n_words", "n_replaced", "item_share"), F.struct("n_words", -F.col("doc_word"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
