"""Long exact spans shared between records (repeated-phrase automata).

Every run of ``min_chars`` equal characters holds, in both records, the same
*phrase*: the minimal ``phrase_chars``-gram (by rolling hash) of one of its
windows. So the plan is

1. one pass picks each record's phrases; phrases found in two records recur
   (``min(id) <> max(id)`` per hash, combined map-side);
2. records that hold a recurring phrase are met by automata: each shard of records
   compiles an Aho-Corasick automaton of the phrases confirmed for *its* records
   and streams their whole texts once, which finds every occurrence (also those that
   the picking skipped). An automaton's size is bounded by its shard; that a record meets
   only its own shard's automaton keeps the work in proportion to the texts, where streaming all
   records past the automata of all phrases would grow with their square;
3. around each occurrence, windows of ``min_chars`` on a grid are hashed (128 bits); what
   follows works on rows of hashes and positions, without texts. Where only part of a grid recurs, the
   windows between are hashed too, so the reported stretches are exact to the character.

Nothing is paired: every comparison is a min/max per hash, so a group of copies
costs rows in proportion to its texts. A hash that stands in many rows is not met by one
task either: the hashes that each make up a thousandth of the rows or more are at most a
thousand and are broadcast, the others are shuffled (``_among``).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import release, stored

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_SEGMENT = 1 << 22  # characters per pass over one text; the order key has 24 bits of position


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, inv, dtype=np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
    return up, down


_POW: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, equal for equal grams wherever they stand."""
    n = len(codes)
    have = _POW.get("p")
    if have is None or len(have[0]) <= n:
        have = _POW["p"] = _powers(max(n, 1 << 16))
    up, down = have
    with np.errstate(over="ignore"):
        c = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        c ^= c >> np.uint64(29)
        s = np.empty(n + 1, dtype=np.uint64)
        s[0] = 0
        np.cumsum(c * up[:n], dtype=np.uint64, out=s[1:])
        h = (s[k:] - s[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, in linear time (prefix and suffix minima of blocks)."""
    n = len(a)
    pad = (-n) % w
    b = np.concatenate([a, np.full(pad, np.iinfo(a.dtype).max, dtype=a.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def pick_phrases(text: str, min_chars: int, phrase_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of the distinct phrases picked from one text."""
    w = min_chars - phrase_chars + 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hs, ps = [], []
    for at in range(0, max(1, len(codes) - min_chars + 1), _SEGMENT):
        part = codes[at : at + _SEGMENT + min_chars - 1]
        if len(part) < min_chars:
            break
        h = _gram_hashes(part, phrase_chars)
        low = np.uint64(0xFFFFFF)
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # ties: the rightmost
        pos = np.unique((low - (sliding_min(key, w) & low)).astype(np.int64))
        hs.append(h[pos])
        ps.append(pos + at)
    if not hs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, first = np.unique(np.concatenate(hs), return_index=True)
    return h, np.concatenate(ps)[first]


def _starts(text: str, automaton, min_chars: int, phrase_chars: int, step: int) -> list[int]:
    """Grid starts of the windows around every phrase occurrence, as far as a core still fits."""
    n, reach, out = len(text), min_chars - phrase_chars, set()
    for end, _ in automaton.iter(text):
        p = end - phrase_chars + 1
        out.update(range(max(p - reach // step * step, p % step), p + 1, step))
    return sorted(q for q in out if q <= n - (min_chars - step + 1))


def _windows(text: str, starts: list[int], n: int) -> bytes:
    """The 128-bit hashes of the windows of ``n`` characters at ``starts``, one after the other."""
    return b"".join([xxhash.xxh3_128_digest(text[at : at + n].encode("utf-8", "surrogatepass")) for at in starts])


def _hash_rows(parts: list[tuple[int, int, list[int], int, bytes]]) -> pd.DataFrame:
    """Rows of (record, text, starts, kind, hashes); ``at`` packs the text's lower half and the start into one number."""
    size = [len(qs) for _, _, qs, _, _ in parts]
    w = np.frombuffer(b"".join(x[4] for x in parts), dtype=np.int64).reshape(-1, 2)
    q = np.fromiter((q for x in parts for q in x[2]), np.int64, sum(size))
    text = np.repeat(np.array([x[1] for x in parts], np.int64), size) << 32
    return pd.DataFrame({"rid": np.repeat(np.array([x[0] for x in parts], np.int64), size), "at": text | q, "kind": np.repeat(np.array([x[3] for x in parts], np.int8), size), "w1": w[:, 0], "w2": w[:, 1]})


_HASH_ROWS = "rid bigint, at bigint, kind tinyint, w1 bigint, w2 bigint"


def _shards(b: pd.DataFrame, k: int, most: int = 10_000) -> Iterator[tuple[pd.DataFrame, ahocorasick.Automaton]]:
    """Runs of records with at most ``most`` phrases (or one record), each with the automaton of its phrases."""
    start = held = 0
    sizes = [len(p) for p in b.pos]
    for i, n in enumerate([*sizes, most + 1]):
        if i > start and held + n > most:
            part = b.iloc[start:i]
            a = ahocorasick.Automaton()
            for t, ps in zip(part.text, part.pos, strict=True):
                for p in ps:
                    a.add_word(t[p : p + k], 1)
            a.make_automaton()
            yield part, a
            start, held = i, 0
        held += n


def _recurring(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that stand in two records, and in how many rows (``n``)."""
    return rows.groupBy(*key).agg(F.min("rid").alias("_a"), F.max("rid").alias("_b"), F.count("*").alias("n")).where("_a <> _b").select(*key, "n")


def _among(rows: DataFrame, keys: DataFrame, key: list[str], total: int) -> DataFrame:
    """The rows whose key is among ``keys`` (key, n), of ``total`` rows in all.

    Keys of a thousandth of the rows each are at most a thousand, whatever the data, so
    they are broadcast and their rows stay where they are; no other key weighs much.
    """
    much = total // 1000 + 1
    hot = keys.where(F.col("n") >= much).select(*key)
    if not hot.head(1):
        return rows.join(keys.select(*key), key, "left_semi")
    hot = F.broadcast(hot)
    rest = rows.join(hot, key, "left_anti").join(keys.where(F.col("n") < much).select(*key), key, "left_semi")
    return rows.join(hot, key, "left_semi").unionByName(rest)


def shared_spans(
    df: DataFrame, id_col: str, text_col: str, min_chars: int = 240, phrase_chars: int = 64, step: int = 16, checkpoint: bool = True
) -> DataFrame:
    """How much of each record stands verbatim in another one.

    Returns one row per input row: ``record_id`` (the value of ``id_col``),
    ``n_chars``, ``shared_chars`` (characters inside runs of at least ``min_chars``
    that also stand in a row with another id), ``shared_share`` and ``spans``
    (array of ``[start, end)`` in code points, maximal, ordered).

    Null or short texts: 0 shared characters and no spans (``n_chars`` is 0 for
    null). An empty table gives an empty result. Rows with equal texts but other ids
    share all of their text; a row repeated under the *same* id is not another
    record. Other columns of ``df`` are ignored.
    """
    if not 0 < phrase_chars < min_chars or step < 1:
        raise ValueError("phrase_chars must lie between 0 and min_chars, step must be positive")
    base = df.select(F.col(id_col).cast("bigint").alias("rid"), F.col(text_col).cast("string").alias("text")).where(F.col("rid").isNotNull())
    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rid, hs, ps = [], [], []
            for r, t in zip(b.rid, b.text, strict=True):
                h, p = pick_phrases(t, min_chars, phrase_chars)
                rid.append(np.full(len(h), r, dtype=np.int64))
                hs.append(h.view(np.int64))
                ps.append(p)
            if rid:
                yield pd.DataFrame({"rid": np.concatenate(rid), "tid": np.repeat(b.tid.to_numpy(), [len(h) for h in hs]), "h": np.concatenate(hs), "pos": np.concatenate(ps).astype(np.int32)})

    keep_rows = stored if checkpoint else lambda df: df
    drop = release if checkpoint else lambda df: None
    # Rows of one id are one record: their texts are met one by one, under the same id, and told apart by a number of theirs.
    texts = base.withColumn("tid", F.pmod(F.xxhash64("text"), F.lit(1 << 31))).where(F.length("text") >= min_chars)
    picked = keep_rows(texts.mapInPandas(phrases, "rid bigint, tid bigint, h bigint, pos int"))
    twice = keep_rows(_recurring(picked, ["h"]))
    confirmed = _among(picked, twice, ["h"], picked.count()).groupBy("rid", "tid").agg(F.collect_list("pos").alias("pos"))

    core = min_chars - step + 1  # what all windows that start up to a step before a grid start have in common

    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, a in _shards(b, phrase_chars):
                rows = []
                for r, i, t in zip(part.rid, part.tid, part.text, strict=True):
                    qs = _starts(t, a, min_chars, phrase_chars, step)
                    whole = [q for q in qs if q + min_chars <= len(t)]
                    rows += [(r, i, whole, 0, _windows(t, whole, min_chars)), (r, i, qs, 1, _windows(t, qs, core))]
                yield _hash_rows(rows)

    # kind 0: whole windows, kind 1: cores
    gridded = keep_rows(texts.join(confirmed, ["rid", "tid"]).mapInPandas(grid, _HASH_ROWS))
    drop(picked)
    drop(twice)
    w = ["w1", "w2"]
    again = keep_rows(_recurring(gridded, w))
    met = keep_rows(_among(gridded, again, w, total := gridded.count()))
    drop(gridded)
    # Grid windows that recur on both sides cover all windows between them already; elsewhere the core's records look closer.
    tid, q = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    marks = met.repartition("rid").groupBy("rid", tid.alias("tid"), q.alias("q")).agg(F.max(F.col("kind") == 0).alias("on"), F.max(F.when(F.col("kind") == 1, F.struct(*w))).alias("w"))
    side = Window.partitionBy("rid", "tid", F.pmod("q", F.lit(step))).orderBy("q")  # grids of several phrases interleave
    covered = F.col("on") & F.coalesce((F.lag("q").over(side) == F.col("q") - step) & F.lag("on").over(side), F.lit(False))
    closer = marks.withColumn("covered", covered).where("w is not null and not covered").select("w.*").distinct()
    closer = keep_rows(closer.join(again, w))
    want = _among(met.where("kind = 1"), closer, w, total).groupBy("rid", tid.alias("tid")).agg(F.collect_set(q).alias("want"))
    drop(again)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, i, t, qs in zip(b.rid, b.tid, b.text, b.want, strict=True):
                fine = _fine(len(t), qs, min_chars, step)
                rows.append((r, i, fine, 0, _windows(t, fine, min_chars)))
            yield _hash_rows(rows)

    fine = keep_rows(texts.join(want, ["rid", "tid"]).mapInPandas(between, _HASH_ROWS))
    fine_again = keep_rows(_recurring(fine, w))
    place = ["rid", tid.alias("tid"), q.cast("int").alias("q")]
    starts = met.where("kind = 0").select(*place).unionByName(_among(fine, fine_again, w, fine.count()).select(*place))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, i, qs in zip(b.rid, b.tid, b.qs, strict=True):
                spans: list[list[int]] = []
                for q in sorted(qs.tolist()):
                    if spans and q <= spans[-1][1]:
                        spans[-1][1] = q + min_chars
                    else:
                        spans.append([q, q + min_chars])
                rows.append((r, i, sum(e - s for s, e in spans), spans))
            yield pd.DataFrame(rows, columns=["rid", "tid", "shared_chars", "spans"])

    found = starts.groupBy("rid", "tid").agg(F.collect_set("q").alias("qs")).mapInPandas(cover, "rid bigint, tid bigint, shared_chars bigint, spans array<array<bigint>>")
    empty = F.array().cast("array<array<bigint>>")
    return (
        base.select("rid", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("tid"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
        .join(found, ["rid", "tid"], "left")
        .select(
            F.col("rid").alias("record_id"),
            "n_chars",
            F.coalesce("shared_chars", F.lit(0).cast("bigint")).alias("shared_chars"),
            F.when(F.col("n_chars") > 0, F.coalesce(F.col("shared_chars"), F.lit(0)) / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"),
            F.coalesce("spans", empty).alias("spans"),
        )
    )


def _fine(n: int, starts: list[int], min_chars: int, step: int) -> list[int]:
    """Starts between grid starts of a text of ``n`` characters whose windows hold a wanted core: those up to ``step - 1`` before it."""
    out: set[int] = set()
    for q in map(int, starts):
        out.update(range(max(0, q - step + 1), min(q, n - min_chars + 1)))
    return sorted(out)
