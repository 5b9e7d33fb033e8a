"""Validation of records: rules as columns, findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a file record must satisfy.
KINDS = ("code", "test", "config", "docs", "asset")
BUCKETS = ("internal", "public", "unknown")
SHA = r"^(?:[0-9a-f]{64}|skipped-large-file)$"

FILE_INFO = T.StructType(
    [T.StructField(n, t) for n, t in (("path", T.StringType()), ("bytes", T.LongType()), ("sha256", T.StringType()), ("loc", T.LongType()), ("kind", T.StringType()), ("bucket", T.StringType()), ("ignoreReason", T.StringType()))]
)


def file_rules() -> dict[str, Column]:
    """Rule name -> whether a file record breaks it. Null where a rule cannot be judged counts as broken only for required fields."""
    broken = lambda c: F.coalesce(c, F.lit(False))
    return {
        "path.required": F.col("path").isNull() | (F.col("path") == ""),
        "bytes.range": F.col("bytes").isNull() | broken(F.col("bytes") < 0),
        "loc.range": F.col("loc").isNull() | broken(F.col("loc") < 0),
        "kind.enum": F.col("kind").isNull() | ~broken(F.col("kind").isin(*KINDS)),
        "bucket.enum": F.col("bucket").isNull() | ~broken(F.col("bucket").isin(*BUCKETS)),
        "sha256.pattern": broken(~F.col("sha256").rlike(SHA)),
    }


def file_warnings(most_bytes: int = 1_000_000) -> dict[str, Column]:
    return {
        "large-file": F.coalesce(F.col("bytes") > most_bytes, F.lit(False)),
        "empty-code": F.coalesce((F.col("kind") == "code") & (F.col("loc") == 0), F.lit(False)),
    }


def findings(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: ``keys`` and ``rule``."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))


def counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule``, ``n`` for every rule, also those nothing breaks; one pass over the records."""
    one = df.agg(*[F.count_if(c).alias(n.replace(".", "_")) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n.replace(".", "_")).alias("n")) for n in rules])).alias("x")).select("x.rule", "x.n")


def first_findings(found: DataFrame, order: list[str], k: int = 25) -> DataFrame:
    """The first ``k`` findings in order; a report, so it is limited."""
    w = Window.orderBy(*order)
    return found.orderBy(*order).limit(k).withColumn("no", F.row_number().over(w).cast("bigint"))


def ndjson(lines: DataFrame, schema: T.StructType = FILE_INFO, column: str = "value", index: str | None = None) -> DataFrame:
    """Lines parsed under ``schema``: its fields, ``line`` as delivered and ``valid``; what does not parse is kept with nulls.

    ``index`` names a column with the lines' numbers, which is kept as ``no``.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    no = [F.col(index).cast("bigint").alias("no")] if index else []
    p = lines.select(*no, F.col(column).alias("line"), F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull() & F.col("line").rlike(r"^\s*\{")
    return p.select(*(["no"] if index else []), "line", F.coalesce(ok, F.lit(False)).alias("valid"), *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def ndjson_findings(lines: DataFrame, column: str = "value", index: str = "no") -> DataFrame:
    """What is wrong with the lines of a file manifest: ``no``, ``field`` (``[no]`` or ``[no].rule``), ``rule``; one row per broken rule."""
    p = ndjson(lines, FILE_INFO, column, index)
    bad = p.where("not valid").select("no", F.lit("json").alias("rule"))
    found = findings(p.where("valid"), ["no"], file_rules()).unionByName(bad)
    place = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("]"))
    return found.select("no", F.when(F.col("rule") == "json", place).otherwise(F.concat(place, F.lit("."), F.col("rule"))).alias("field"), "rule")


# What the artifacts of a pack must hold.
SCHEMAS = {
    "files-manifest": FILE_INFO, "import-graph": T.StructType([T.StructField("node", T.StringType()), T.StructField("in_degree", T.LongType()), T.StructField("out_degree", T.LongType())]),
    "exports": T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())]), "schema-index": T.StructType([T.StructField("path", T.StringType()), T.StructField("type", T.StringType())]),
}


def artifact_findings(name: str, artifact: DataFrame) -> list[str]:
    """What an artifact lacks of its schema: fields that are missing or of another type. An unknown artifact is an error."""
    if name not in SCHEMAS:
        raise ValidationFailed(f"no schema is known as {name}")
    have = {f.name: f.dataType for f in artifact.schema.fields}
    wrong = []
    for f in SCHEMAS[name].fields:
        if f.name == "ignoreReason" and f.name not in have:
            continue  # optional
        if f.name not in have:
            wrong.append(f"{f.name} is missing")
        elif have[f.name] != f.dataType and not (isinstance(f.dataType, T.LongType) and isinstance(have[f.name], (T.IntegerType, T.ShortType))):
            wrong.append(f"{f.name} is {have[f.name].simpleString()} and not {f.dataType.simpleString()}")
    return wrong


def stub_ok(text: Column | str) -> Column:
    """A stub has a declaration, and its braces differ by at most two."""
    t = F.col(text) if isinstance(text, str) else text
    diff = F.abs(F.regexp_count(t, F.lit(r"\{")) - F.regexp_count(t, F.lit(r"\}")))
    return t.rlike(r"\b(?:declare|export|interface|type|class|function|const|enum)\b") & (diff <= 2)


class ValidationFailed(Exception):
    """Raised in strict mode after findings were written, or at once when only validating."""


def enforce(found: DataFrame, strict: bool, only: bool = False) -> int:
    n = found.limit(1).count()
    if n and (strict or only):
        raise ValidationFailed("records break their rules")
    return n
