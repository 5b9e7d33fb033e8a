import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name,unread", [("file_manifest", "sha256"), ("package_of_specifier", "to_path"), ("token_by_symbol", "body"), ("paste_filter", "content")])
def test_scans_read_only_what_is_used(spark, name, unread):
    schemas = re.findall(r"ReadSchema: (\S+)", plan(entry.queries()[name](spark, DATA)))
    assert schemas and all(unread not in s for s in schemas)


@pytest.mark.parametrize("name", ["node_degrees", "external_top20", "resolved_specifiers", "topology", "hotspots", "paste_budget"])
def test_no_nested_loops(spark, name):
    p = plan(entry.queries()[name](spark, DATA))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[IsNotNull\(content\)", plan(entry.queries()["text_normalized"](spark, DATA)))


def test_context_ends_with_the_file(spark, tmp_path):
    files = [(1, "r", "a.ts", "x\n" * 4), (2, "r", "a.ts", "x\r\n" * 9), (3, "r", "b.ts", "x\n" * 1999), (4, "r", "b.ts", None)]
    spark.createDataFrame(files, "paste_id bigint, repo string, path string, content string").write.parquet(f"{tmp_path}/paste_files.parquet")
    slices = [(1, "r", "a.ts", 7, 9, "a\nb\nc"), (2, "r", "b.ts", 1500, 1502, "a\nb\nc"), (3, "r", "c.ts", 5, 7, "a\nb\nc")]
    spark.createDataFrame(slices, "slice_id bigint, repo string, path string, start_line bigint, end_line bigint, body string").write.parquet(f"{tmp_path}/code_slices.parquet")
    got = {r.slice_id: (r.from_line, r.to_line) for r in entry.queries()["context_lines"](spark, str(tmp_path)).collect()}
    assert got == {1: (4, 10), 2: (1497, 1505), 3: (2, 10)}
