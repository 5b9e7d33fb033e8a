"""Splitting oversized items at natural boundaries (lexical cohesion).

The vocabulary of the lines before and after every line end is compared in a sliding
block; a valley of that similarity marks a change of topic. Within each size window
the deepest valley is cut, with a bonus for blank lines and for lines that return to
the outer indentation; a window without any valley is cut at such a line, or at its last one. The next piece
starts a fixed overlap earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[A-Za-z]{3,}|[^\W\d_A-Za-z]{2,}")
_SOFT = re.compile(r"[;{}]|[.!?](?=\s)|,|\s")


def _similarity(lines: list[str], block: int) -> np.ndarray:
    """Cosine of the word counts of the ``block`` lines before and after the end of each line, over the whole vocabulary.

    The blocks slide by a line, so the scalar product and both norms are kept up to date
    word by word: the work grows with the words, not with the vocabulary.
    """
    n = len(lines)
    known: dict[str, int] = {}
    ids = [[known.setdefault(w, len(known)) for w in _WORD.findall(line.lower())] for line in lines]
    before, after = [0] * len(known), [0] * len(known)
    dot = left = right = 0
    for line in ids[1 : block + 1]:
        for w in line:
            right += 2 * after[w] + 1
            after[w] += 1
    for w in ids[0] if ids else ():
        left += 2 * before[w] + 1
        before[w] += 1
        dot += after[w]
    out = np.zeros(n)
    for i in range(n):
        if left and right:
            out[i] = dot / (left * right) ** 0.5
        if i + 1 < n:
            for w in ids[i + 1]:  # leaves the block after the gap and joins the one before it
                right -= 2 * after[w] - 1
                after[w] -= 1
                dot -= before[w]
            if i + 1 + block < n:
                for w in ids[i + 1 + block]:
                    right += 2 * after[w] + 1
                    after[w] += 1
                    dot += before[w]
            for w in ids[i + 1]:
                left += 2 * before[w] + 1
                before[w] += 1
                dot += after[w]
            if i + 1 - block >= 0:
                for w in ids[i + 1 - block]:
                    left -= 2 * before[w] - 1
                    before[w] -= 1
                    dot -= after[w]
    return out


def valley_depths(lines: list[str], block: int) -> np.ndarray:
    """For the end of each line: how far the similarity of the blocks around it lies below its neighbouring peaks."""
    n = len(lines)
    sim = _similarity(lines, block)
    pad = np.pad(sim, block, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(pad, block + 1)
    return (view[:n].max(1) - sim) + (view[block : block + n].max(1) - sim)


def pieces(text: str, max_bytes: int, overlap: int, block: int = 8, fill: float = 0.5) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece, as ``cuts`` gives them."""
    return [x[:3] for x in cuts(text, max_bytes, overlap, block, fill)]


def cuts(text: str, max_bytes: int, overlap: int, block: int = 8, fill: float = 0.5, least_depth: float = 0.1) -> list[tuple[int, int, str, float]]:
    """(start, end, boundary, depth) in code points.

    boundary is ``valley`` (a line end where cohesion falls by ``least_depth`` or more),
    ``line`` (another line end), ``soft`` (behind a blank or a mark), ``hard`` or ``end``;
    depth is how far cohesion falls there, 0 where no line ends. Every piece is at most ``max_bytes`` long in UTF-8. Each but the first starts
    exactly ``overlap`` code points before the end of the one before.
    """
    if max_bytes < 8 * (overlap + 1):
        raise ValueError("max_bytes must be at least 8 times the overlap")
    n = len(text)
    if n * 4 <= max_bytes or len(text.encode("utf-8", "surrogatepass")) <= max_bytes:
        return [(0, n, "end", 0.0)] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=size[1:])
    ends = np.flatnonzero(codes == 10) + 1
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    else:
        ends = np.append(ends, n)
    depth = valley_depths(lines, block)
    indent = np.array([len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines])
    after = np.append(indent[1:], 0)
    score = depth + 0.5 * (indent == -1) + 0.25 * (after <= 0) + 1e-3 * (after < indent)
    out, start = [], 0
    while True:
        # The furthest end that still fits; size is monotonic.
        reach = int(np.searchsorted(size, size[start] + max_bytes, side="right")) - 1
        if reach >= n:
            out.append((start, n, "end", 0.0))
            return out
        least = max(start + overlap + 1, int(np.searchsorted(size, size[start] + int(max_bytes * fill))))
        lo, hi = np.searchsorted(ends, [least, reach + 1])
        if lo == hi:
            # No line end in the window proper: the last one before it, if any progress is left.
            lo = np.searchsorted(ends, start + 2 * overlap + 1)
            lo = max(lo, hi - 1)
        if lo < hi:
            at = lo + int(np.argmax(score[lo:hi]))
            cut, drop = int(ends[at]), float(depth[at])
            kind = "valley" if drop >= least_depth else "line"
        else:
            drop = 0.0
            soft = [m.end() for m in _SOFT.finditer(text, least, reach)]
            cut, kind = (soft[-1], "soft") if soft else (reach, "hard")
        out.append((start, cut, kind, drop))
        start = cut - overlap


def split_items(
    df: DataFrame, id_col: str, text_col: str, max_bytes: int = 12_000, overlap: int = 200, block: int = 8, with_text: bool = True, only_large: bool = False
) -> DataFrame:
    """Cut the texts of ``df`` into pieces of at most ``max_bytes`` (UTF-8).

    Rows: ``record_id``, ``piece_no`` (from 0), ``n_pieces``, ``start_char``,
    ``end_char`` (code points), ``start_line``, ``end_line`` (from 1; lines end at line
    feeds), ``n_bytes``, ``boundary`` and ``depth`` (see ``cuts``) and, with ``with_text``, ``piece``. A text within
    the limit is one piece; null and empty texts have none; rows that repeat an id are
    cut each on their own. Pieces without their overlaps joined give the text again.
    ``only_large`` leaves out texts that fit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["record_id", "piece_no", "n_pieces", "start_char", "end_char", "start_line", "end_line", "n_bytes", "boundary", "depth", "piece"]
        for b in batches:
            rows = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                ps = cuts(t, max_bytes, overlap, block)
                line, at = 1, 0
                for no, (s, e, kind, depth) in enumerate(ps):
                    line, at = line + t.count("\n", at, s), s
                    last = line + t.count("\n", s, max(s, e - 1))
                    p = t[s:e]
                    rows.append((i, no, len(ps), s, e, line, last, len(p.encode("utf-8", "surrogatepass")), kind, depth, p if with_text else None))
            yield pd.DataFrame(rows, columns=cols)

    src = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null and t <> ''")
    src = src.where(F.octet_length("t") > max_bytes) if only_large else src
    out = src.mapInPandas(
        run, "record_id bigint, piece_no bigint, n_pieces bigint, start_char bigint, end_char bigint, start_line bigint, end_line bigint, n_bytes bigint, boundary string, depth double, piece string"
    )
    return out if with_text else out.drop("piece")


def cut_quality(pieces: DataFrame) -> DataFrame:
    """Per ``boundary`` of ``split_items`` rows: ``n_cuts``, ``mean_depth`` and ``mean_bytes``."""
    return pieces.groupBy("boundary").agg(F.count("*").alias("n_cuts"), F.avg("depth").alias("mean_depth"), F.avg("n_bytes").alias("mean_bytes"))
