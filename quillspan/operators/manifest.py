"""File manifest: kind, bucket, importance, and selection within a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import paths
from quillspan.session import stored


def importance(path: str = "path", size: str = "bytes", kind: Column | None = None, bucket: Column | None = None) -> Column:
    """1000 plus what kind, bucket, entry-point and configuration names add, less a penalty for large files."""
    kind = paths.file_kind(path) if kind is None else kind
    bucket = paths.visibility(path) if bucket is None else bucket
    p = F.lower(path)
    when = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        F.lit(1000)
        + F.when(kind == "code", 100).when(kind == "config", 80).when(kind == "docs", 60).when(kind == "test", 40).when(kind == "asset", 20).otherwise(0)
        + F.when(bucket == "public", 50).when(bucket == "internal", 30).otherwise(0)
        + when(p.contains("index.") | p.contains("main."), 100)
        + when(p.contains("config") | p.contains("package.json"), 80)
        - when(F.coalesce(F.col(size), F.lit(0)) > 100_000, 200)
    ).cast("bigint")


def manifest(files: DataFrame) -> DataFrame:
    """``files`` (path, bytes, sha256, loc, any more) with kind, bucket and importance derived from the path; binary names are left out."""
    f = files.where(~F.coalesce(paths.is_binary_name("path"), F.lit(False)))
    return f.withColumns({"kind": paths.file_kind("path"), "bucket": paths.visibility("path")}).withColumn("importance", importance())


def summary(files: DataFrame) -> DataFrame:
    """Files, bytes and lines per kind and bucket."""
    return files.groupBy("kind", "bucket").agg(
        F.count("*").alias("n_files"), F.sum(F.coalesce("bytes", F.lit(0))).cast("bigint").alias("total_bytes"), F.sum(F.coalesce("loc", F.lit(0))).cast("bigint").alias("total_loc")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; ``order`` must be total for a stable result. Null keys are keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_fit(df: DataFrame, key: str, order: list[Column], sizes: dict[str, int], kept: str = "included") -> DataFrame:
    """Marks, per key and in order, the rows that still fit; a row that does not is skipped and the next is tried.

    ``sizes``: size column -> what may be used of it in all. A null size counts as 0.
    Ties in ``order`` must be broken by the caller. The rule depends on the order, so a
    key is folded by one task, but as a stream: no group is gathered, and the state is
    what is left of the budgets. Rows larger than a whole budget never fit, whatever
    came before, and take no part in the ordered pass.
    """
    caps = list(sizes.items())
    cols = [c for c, _ in caps]
    never = None
    for c, cap in caps:
        never = (F.coalesce(F.col(c), F.lit(0)) > cap) if never is None else never | (F.coalesce(F.col(c), F.lit(0)) > cap)
    never = F.coalesce(never, F.lit(False))
    rest = df.where(~never)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = fold
        left: list[int] = []
        for b in batches:
            marks = []
            keys = b[key].where(b[key].notna(), None)
            for k, *ns in zip(keys, *(b[c].fillna(0) for c in cols), strict=True):
                if now is fold or k != now:
                    now, left = k, [cap for _, cap in caps]
                fits = all(n <= x for n, x in zip(ns, left, strict=True))
                if fits:
                    left = [x - n for x, n in zip(left, ns, strict=True)]
                marks.append(fits)
            b[kept] = marks
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields) + f", `{kept}` boolean"
    done = rest.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).mapInPandas(fold, schema)
    return done.unionByName(df.where(never).withColumn(kept, F.lit(False)))


def running_total(df: DataFrame, key: str, order: list[Column], size: Column, total: str = "total", place: str = "place") -> DataFrame:
    """``df`` with the sum of ``size`` and the number of rows up to each row, per key and in order.

    Rows are spread over ranges of (key, order), so a key of any size is added up by many tasks: each range has
    its own sums, and what came before in a key is the sums of its earlier ranges, one small row per range and key.
    Rows that are equal in ``order`` must be broken by the caller.
    """
    d = df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint"))
    d = stored(d.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    sums = d.groupBy("_range", F.col(key).alias("_key")).agg(F.sum("_size").alias("s"), F.count("*").alias("k"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(F.col("_range").alias("_r"), "_key", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    w = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_s": F.sum("_size").over(w), "_k": F.row_number().over(w)})
    j = d.join(offset, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    return j.select(*df.columns, (F.col("_s") + F.col("s0")).alias(total), (F.col("_k") + F.col("k0")).cast("bigint").alias(place))


def stop_at_overflow(df: DataFrame, key: str, order: list[Column], size: str, most: int, most_rows: int | None = None, kept: str = "included") -> DataFrame:
    """Marks, per key and in order, the rows before the first that would overflow the budget (or the row limit). Sizes are not negative; a null one counts as 0."""
    d = running_total(df, key, order, F.col(size), "_total", "_place")
    ok = F.col("_total") <= most
    return d.withColumn(kept, ok & (F.col("_place") <= most_rows) if most_rows is not None else ok).drop("_total", "_place")
