"""Most frequent items: external sort, run-length counting, and a bounded heap per range.

Each map task counts the runs of its sorted batches, so a value that stands in a
third of all rows leaves a task as one short run per batch. Runs are range-partitioned
by value and sorted there (Spark's external sort spills what does not fit), each
range is read once in order, runs of a value are combined, and only the ``k``
largest counts stay in a heap. The heaps of the ranges are merged through a tree of
tasks, each of which again keeps ``k`` only. Memory is one batch and one heap per task,
whatever the number of distinct values or ranges; the counts are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAN = 64  # heaps that one task of the tree merges


def frequent_items(df: DataFrame, columns: list[str], k: int = 100, min_share: float | None = None, partitions: int | None = None) -> DataFrame:
    """The ``k`` most frequent values of each column.

    Rows: ``field``, ``item``, ``n`` and ``share`` of all rows of ``df`` (nulls count
    in the total, but are no item; the empty string is an item). Ties at the end of a
    heap are resolved by value, so the result does not depend on the partitioning.
    With ``min_share`` only values of at least that share are kept; ``k`` must then be
    at least ``1 / min_share``, so that none can be missed. Values are compared
    exactly, as strings. An empty table or a column of nulls gives no rows.
    """
    if k < 1 or (min_share is not None and k * min_share < 1):
        raise ValueError("k must be positive and at least 1 / min_share")
    names = list(dict.fromkeys(columns))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(names):
                c = pc.value_counts(b.column(i))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), c.field(0).cast(pa.string()), c.field(1).cast(pa.int64())], ["field", "item", "n"])

    columns, types = ["field", "item", "n"], (pa.string(), pa.string(), pa.int64())

    class Heaps:
        """The ``k`` largest counts of each field, and each field's total as the null item."""

        def __init__(self) -> None:
            self.heaps: dict[str, list] = {}
            self.total: dict[str, int] = {}

        def add(self, field: str, item: str | None, n: int) -> None:
            if item is None:
                self.total[field] = self.total.get(field, 0) + n
                return
            h = self.heaps.setdefault(field, [])
            entry = (n, _Backwards(item))
            if len(h) < k:
                heapq.heappush(h, entry)
            elif entry > h[0]:
                heapq.heapreplace(h, entry)

        def rows(self) -> list[tuple[str, str | None, int]]:
            return [(f, e[1].value, e[0]) for f, h in self.heaps.items() for e in h] + [(f, None, c) for f, c in self.total.items()]

    def batch(rows: list[tuple], names_: list[str] = columns, kinds: tuple = types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names_)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted range: runs of a value stand together; every row also counts in the total."""
        top, now, n = Heaps(), None, 0
        for b in batches:
            for f, v, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (f, v) == now:
                    n += c
                    continue
                if now is not None and now[1] is not None:
                    top.add(*now, n)
                    top.add(now[0], None, n)
                elif now is not None:
                    top.add(*now, n)
                now, n = (f, v), c
        if now is not None:
            top.add(*now, n)
            if now[1] is not None:
                top.add(now[0], None, n)
        yield batch(top.rows())

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Heaps()
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                top.add(*row)
        yield batch(top.rows())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Heaps()
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                top.add(*row)
        rows = [(f, v, c, c / top.total[f]) for f, v, c in top.rows() if v is not None]
        yield batch([r for r in rows if min_share is None or r[3] >= min_share], [*columns, "share"], (*types, pa.float64()))

    schema = "field string, item string, n bigint"
    counted = df.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names))).mapInArrow(runs, schema)
    by = [F.col("field"), F.col("item")]
    ranged = counted.repartitionByRange(partitions, *by) if partitions else counted.repartitionByRange(*by)
    tops = ranged.sortWithinPartitions(*by).mapInArrow(merge, schema)
    # Ranges share no value, so their heaps only have to be narrowed: by a tree, and in one task at its root.
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width > _FAN:
        width = -(-width // _FAN)
        tops = tops.repartition(width).mapInArrow(narrow, schema)
    return tops.repartition(1).mapInArrow(finish, schema + ", share double")


class _Backwards:
    """A string that orders backwards, so that the heap drops the larger of two equally frequent values."""

    __slots__ = ("value",)

    def __init__(self, value: str) -> None:
        self.value = value

    def __lt__(self, other: _Backwards) -> bool:
        return self.value.encode("utf-8", "surrogatepass") > other.value.encode("utf-8", "surrogatepass")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Backwards) and self.value == other.value

