import pytest
from pyspark.sql import functions as F

from quillspan.sources import files as src
from quillspan.streaming import manifest as stream


def test_tree(spark, tmp_path):
    for p, b in {"src/a.ts": b"a\nb\n", "src/empty.ts": b"", "bin/x.dat": b"a\x00b", "img.png": b"x", "node_modules/m/i.js": b"x", "keep.log": b"x", "a/test-config.ts": b"x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {r.path: (r.loc, r.kind) for r in src.read_tree(spark, str(tmp_path), excludes=["SRC/none*"]).collect()}
    assert got == {"src/a.ts": (3, "code"), "src/empty.ts": (0, "code"), "a/test-config.ts": (1, "test")}
    got = {r.path for r in src.read_tree(spark, str(tmp_path), ignore_lines=["src/", "!keep.log"]).collect()}
    assert got == {"keep.log", "a/test-config.ts"}


def test_package_files(spark):
    t = '{"name":"x","private":true,"dependencies":{"b":"1","a":"2"},"exports":{".":"./i.js"}}'
    df = spark.createDataFrame([("r", "p/package.json", t), ("r", "q/package.json", "nonsense")], "repo string, path string, text string")
    got = {r.path: r for r in src.package_json(df).collect()}
    assert got["p/package.json"].dependencies == ["a", "b"] and got["p/package.json"].export_keys == ["."]
    assert got["q/package.json"].name is None
    y = spark.createDataFrame([("packages:\n  - 'packages/*'\n  - tools # note\nother: 1\n",)], "t string")
    assert y.select(src.workspace_patterns(F.col("t")).alias("p")).first().p == ["packages/*", "tools"]
    d = spark.createDataFrame([("r", x) for x in ("packages/a", "packages/a/b", "tools")], "repo string, dir string")
    p = spark.createDataFrame([("r", "packages/*"), ("r", "tools")], "repo string, pattern string")
    assert sorted(r.dir for r in src.expand_workspaces(d, p).collect()) == ["packages/a", "tools"]


def test_output_paths(tmp_path):
    assert src.safe_output("a/b.json", str(tmp_path)).startswith(str(tmp_path))
    for bad in ("../x", "a\x00b", "con.txt", ""):
        with pytest.raises(ValueError):
            src.safe_output(bad, str(tmp_path))


def test_stream_drops_redeliveries(spark, tmp_path):
    schema = "file_id bigint, repo string, path string, bytes bigint, loc bigint, bucket string, scanned_at timestamp, loaded_at timestamp"
    spark.sql("select 1L file_id, 'r' repo, 'a.ts' path, 5L bytes, 1L loc, 'public' bucket, timestamp'2025-01-01' scanned_at, timestamp'2025-01-01 01:00' loaded_at union all select 2, 'r', 'a.ts', 5, 1, 'public', timestamp'2025-01-01', timestamp'2025-01-02'").write.parquet(str(tmp_path / "in"))
    q = stream.manifest_stream(stream.read_records(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("m").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("m").count() == 1


def test_ignore_files_and_workspaces(spark, tmp_path):
    assert src.ignore_lines(spark, str(tmp_path)) == []
    (tmp_path / ".gitignore").write_text("*.tmp2\n# no\n/secret/\n")
    (tmp_path / "secret").mkdir()
    (tmp_path / "secret" / "a.ts").write_text("x")
    (tmp_path / "b.tmp2").write_text("x")
    (tmp_path / "c.ts").write_text("")
    for name in (".github/flow.yml", ".git/config", "_parts/__init__.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    lines = src.ignore_lines(spark, str(tmp_path))
    assert lines == ["*.tmp2", "# no", "/secret/"]
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert {(r.path, r.loc) for r in src.read_tree(spark, root, ignore_lines=lines).collect()} == {("c.ts", 0), (".gitignore", 4), (".github/flow.yml", 1), ("_parts/__init__.py", 1)}
    files = [("a", "pnpm-workspace.yaml", "packages:\n  - 'x/*'\n"), ("a", "package.json", '{"workspaces":["ignored"]}'), ("b", "package.json", '{"workspaces":["p/*","q"]}'), ("c", "package.json", '{"workspaces":{"packages":["r"]}}'), ("d", "package.json", "nonsense"), ("e", "package.json", None)]
    r = spark.createDataFrame(files, "repo string, name string, text string")
    assert sorted(map(tuple, src.workspaces(r).collect())) == [("a", "x/*"), ("b", "p/*"), ("b", "q"), ("c", "r")]


def test_stored_packs_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text("x" * 10)
    (tmp_path / "s.d.ts").write_text("y" * 6)
    (tmp_path / "c.ts").write_text("z")
    got = {r.path.rsplit("/", 1)[1]: (r.chars, r.conservative, r.optimistic) for r in src.stored_pack(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (10, 4, 2), "s.d.ts": (6, 2, 2)}
    assert src.git_state(str(tmp_path)) == {}


def test_output_paths_fit_what_is_there(tmp_path):
    (tmp_path / "f").write_text("x")
    (tmp_path / "d").mkdir()
    assert src.safe_output("d", str(tmp_path), "folder") and src.safe_output("f", str(tmp_path), "file") and src.safe_output("new/deep/x", str(tmp_path), "file")
    for bad, kind in (("d", "file"), ("f", "folder"), ("f/below", "file")):
        with pytest.raises(ValueError):
            src.safe_output(bad, str(tmp_path), kind)
