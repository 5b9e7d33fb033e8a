"""Budgets over artifacts: values, selection, downsampling, variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.operators.manifest import first_fit

# Total bytes per level.
LEVELS = {"summary": 500_000, "contracts": 1_500_000, "full-api": 2_000_000, "deep": 5_000_000}
# Artifacts of the smaller variants of a pack.
SHORT = ("topology", "files-manifest", "import-graph", "ts-config", "exports")
MINIMAL = ("import-graph", "ts-config", "exports")


def per_collector(total: int, collectors: int) -> int:
    """An equal share of the budget; the whole where there is no collector."""
    return total // collectors if collectors else total


def artifact_value(artifact: str = "id", size: str = "size") -> Column:
    """1000 per byte, doubled for the topology and the import graph, half more for the public interface."""
    i = F.col(artifact)
    factor = F.when(i.contains("topology") | i.contains("import-graph"), 2.0).when(i.contains("public-api") | i.contains("exports"), 1.5).otherwise(1.0)
    return F.lit(1000.0) / F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(1)) * factor


def choose_artifacts(artifacts: DataFrame, key: str, total: int, each: int | None = None, value: Callable[[], Column] = artifact_value) -> DataFrame:
    """Artifacts that fit, most valuable first, skipping those that do not; ``decision`` says why. ``value`` scores an artifact by its ``id`` and ``size``."""
    a = artifacts.withColumn("value", value())
    big = F.col("size") > (each or total)
    fit = first_fit(a.where(~F.coalesce(big, F.lit(False))), key, [F.desc("value"), F.col("id")], {"size": total})
    fit = fit.withColumn("decision", F.when(F.col("included"), "kept").otherwise("over total budget"))
    return fit.unionByName(a.where(F.coalesce(big, F.lit(False))).withColumns({"included": F.lit(False), "decision": F.lit("over artifact budget")}))


# The columns that the smaller variants keep of an artifact; all of them where none are named.
VARIANT_COLUMNS = {
    "import-graph": {"short": ("repo", "node", "in_degree", "out_degree", "role"), "minimal": ("repo", "node", "role")}, "ts-config": {"minimal": ("repo", "name", "options")},
    "exports": {"minimal": ("repo", "path", "name")}, "files-manifest": {"short": ("repo", "path", "bytes", "loc", "kind", "bucket")}, "topology": {"short": ("repo", "package", "internal")},
}


def project(name: str, artifact: DataFrame, variant: str) -> DataFrame:
    """What a variant keeps of an artifact: of the named columns those there are."""
    keep = [c for c in VARIANT_COLUMNS.get(name, {}).get(variant, ()) if c in artifact.columns]
    return artifact.select(*keep) if keep else artifact


def downsample_text(text: Column | str, most: int) -> Column:
    return tx.prefix_with_marker(text, most)


def variants(artifacts: DataFrame, path: str = "filename") -> DataFrame:
    """Every artifact once per variant it belongs to (full, short, minimal), with flattened file names."""
    full = F.lit("full")
    short = F.when(F.col("id").isin(*SHORT), F.lit("short"))
    minimal = F.when(F.col("id").isin(*MINIMAL), F.lit("minimal"))
    return artifacts.withColumn("variant", F.explode(F.array_compact(F.array(full, short, minimal)))).withColumn(path, F.regexp_replace(path, "^ts/", ""))
