"""Refactoring report: suggested cuts, risk, actions, concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suggested_cuts(deg: DataFrame, hubs: DataFrame, fan_out: int = 15, ratio: float = 0.8, reexports: int = 10) -> DataFrame:
    """``repo``, ``node``, ``cut`` and ``impact``: files that import more than ``fan_out`` others, and hubs that do little but re-export."""
    wide = deg.where(F.col("out_degree") > fan_out).select("repo", "node", F.lit("split-imports").alias("cut"), F.lit("high").alias("impact"))
    barrel = hubs.where((F.col("ratio") > ratio) & (F.col("reexports") > reexports)).select("repo", "node", F.lit("reduce-reexports").alias("cut"), F.lit("medium").alias("impact"))
    return wide.unionByName(barrel)


def risk_score(cyclic: Column, max_fan_out: Column, max_reexports: Column, max_hotspot: Column) -> Column:
    """3 for cycles, 2 for a fan-out over 20, 2 for a hub over 30, 1 for a hotspot over 50."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(F.coalesce(cyclic, F.lit(False)), 3).otherwise(0) + F.when(z(max_fan_out) > 20, 2).otherwise(0) + F.when(z(max_reexports) > 30, 2).otherwise(0) + F.when(z(max_hotspot) > 50, 1).otherwise(0)
    ).cast("bigint")


def risk_level(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def actions(cyclic: Column, max_fan_out: Column, n_hubs: Column) -> Column:
    """What to do, as an array of texts; a reassuring one where nothing stands out."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(cyclic, F.lit(False)), "Break import cycles"),
            F.when(F.coalesce(max_fan_out, F.lit(0)) > 15, "Split files with a high fan-out"),
            F.when(F.coalesce(n_hubs, F.lit(0)) > 20, "Consolidate re-export hubs"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No major structural concerns")))


def report(deg: DataFrame, hubs: DataFrame, spots: DataFrame, scc: DataFrame) -> DataFrame:
    """One row per repository: cycles, the largest signals, ``risk_score``, ``risk_level`` and ``actions``."""
    d = deg.groupBy("repo").agg(F.max("out_degree").alias("max_fan_out"), F.max("in_degree").alias("max_fan_in"), F.count("*").alias("n_nodes"))
    h = hubs.groupBy("repo").agg(F.max("reexports").alias("max_reexports"), F.count("*").alias("n_hubs"))
    s = spots.groupBy("repo").agg(F.max("score").alias("max_hotspot"))
    c = scc.groupBy("repo").agg(F.countDistinct("component").alias("n_components"))
    z = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    j = d.join(h, "repo", "left").join(s, "repo", "left").join(c, "repo", "left").select("repo", *map(z, ("n_nodes", "max_fan_in", "max_fan_out", "max_reexports", "n_hubs", "max_hotspot", "n_components")))
    score = risk_score(F.col("n_components") > 0, F.col("max_fan_out"), F.col("max_reexports"), F.col("max_hotspot"))
    return j.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"))).withColumn("actions", actions(F.col("n_components") > 0, F.col("max_fan_out"), F.col("n_hubs")))
