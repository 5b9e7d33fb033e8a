"""Queries of the problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import credentials, docpairs, handwritten, heavy, leaks, mixing, repetition, spans, split, syntax


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RECORDS = (("paste_files", "paste_id", "content"), ("code_slices", "slice_id", "body"))


def p1_shared_spans(spark: SparkSession, d: str) -> DataFrame:
    parts = [spans.shared_spans(_t(spark, d, t), i, c).select(F.lit(t).alias("source_table"), "*") for t, i, c in RECORDS]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_shared_spans(spark, d).where("shared_chars > 0").select("source_table", "record_id")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_t(spark, d, "file_infos"), _t(spark, d, "paste_files"))


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.evidence_counts(p2_files(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_files(spark, d).where("not handwritten").select("file_id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(_t(spark, d, "code_slices"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).where("is_slice").select("slice_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(_t(spark, d, "paste_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(p4_files(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_files(spark, d).where("not valid").select("paste_id")


def _code(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {t: (_t(spark, d, t), i, c) for t, i, c in RECORDS}


def p5_credentials(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(_code(spark, d))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(_code(spark, d), with_text=True)


def p5_model(spark: SparkSession, d: str) -> DataFrame:
    return credentials.quality(_code(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_credentials(spark, d).select("source_table", "record_id", "line_no").distinct()


def p6_frequent(spark: SparkSession, d: str) -> DataFrame:
    return heavy.frequent_items(_t(spark, d, "import_edges"), ["specifier", "to_path"], k=1000)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.frequent_items(_t(spark, d, "import_edges"), ["specifier", "to_path"], k=100, min_share=0.01).select("field", "item")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_items(_t(spark, d, "paste_files"), "paste_id", "content")


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_quality(split.split_items(_t(spark, d, "paste_files"), "paste_id", "content", with_text=False))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    p = split.split_items(_t(spark, d, "paste_files"), "paste_id", "content", with_text=False)
    return p.where("piece_no = 0 and n_pieces > 1").select(F.col("record_id").alias("paste_id"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.count_tokens(_t(spark, d, "documents"), "doc_id", "text", "source")
    return mixing.mix(sized, _t(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mixture(spark, d), _t(spark, d, "mix_targets"))


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(_t(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repetition(spark, d).where("repetitive").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            WITH v AS (SELECT 'specifier' AS field, specifier AS item FROM import_edges UNION ALL SELECT 'to_path', to_path FROM import_edges)
            SELECT field, item FROM v WHERE item IS NOT NULL GROUP BY field, item
            HAVING count(*) >= 0.01 * (SELECT count(*) FROM import_edges)""",
        "p6_frequent": """
            WITH v AS (SELECT 'specifier' AS field, specifier AS item FROM import_edges UNION ALL SELECT 'to_path', to_path FROM import_edges),
            c AS (SELECT field, item, count(*) AS n FROM v WHERE item IS NOT NULL GROUP BY field, item),
            r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, item) AS k FROM c)
            SELECT field, item, n, n / (SELECT count(*) FROM import_edges)::DOUBLE AS share FROM r WHERE k <= 1000""",
        "p7_found": "SELECT paste_id FROM paste_files WHERE strlen(content) > 12000",
        "p10_found": r"""
            WITH w AS (
                SELECT doc_id, regexp_extract_all(lower(text), '\pL+') AS ws FROM documents WHERE text IS NOT NULL),
            g AS (
                SELECT doc_id, i, array_to_string(ws[i:i + 5], ' ') AS gram
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 4)) AS i FROM w)),
            again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS r FROM g),
            covered AS (SELECT DISTINCT doc_id, i + j AS p FROM again, (SELECT unnest(range(0, 6)) AS j) WHERE r),
            s AS (SELECT doc_id, count(*) AS c FROM covered GROUP BY doc_id)
            SELECT s.doc_id FROM s JOIN w USING (doc_id) WHERE c >= 0.3 * len(ws)""",
    }
