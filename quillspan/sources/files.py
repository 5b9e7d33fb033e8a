"""Sources: source trees as file tables, package and workspace files, stored packs, git state."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import paths
from quillspan.functions import text as tx

# What is ignored unless a later rule brings it back.
DEFAULT_IGNORES = (
    "node_modules/**", "dist/**", "build/**", ".turbo/**", ".svelte-kit/**", "coverage/**", ".nyc_output/**", ".next/**", ".nuxt/**", "target/**", "__pycache__/**", "*.pyc",
    ".git/**", ".hg/**", ".svn/**", ".DS_Store", "Thumbs.db", "*.log", ".env", ".env.local", ".env.*.local", "*.tmp", "*.swp", "*.swo",
)


_HIDDEN = re.compile(r"\.|_(?!common_metadata|metadata)[^=]*$")  # names that a scan passes over


def ignore_rules(lines: list[str] = (), defaults: bool = True) -> list[tuple[str, bool]]:
    """(regular expression, ignored) in order, of the defaults and the lines of an ignore file."""
    out = []
    for line in [*(DEFAULT_IGNORES if defaults else ()), *lines]:
        g = line.rstrip("\n").strip()
        if not g or g.startswith("#"):
            continue
        out.append((paths.glob_to_regex(g.lstrip("!"), ignore_file=True), not g.startswith("!")))
    return out


def ignored(path: str, rules: list[tuple[str, bool]]):
    """Whether a path is ignored: the last rule that matches decides. A column; rules are few and become one expression."""
    c = F.lit(False)
    for pattern, yes in rules:
        c = F.when(F.col(path).rlike(pattern), F.lit(yes)).otherwise(c)
    return F.coalesce(c, F.lit(False))


def read_tree(spark: SparkSession, root: str, excludes: list[str] = (), ignore_lines: list[str] = (), hash_files: bool = True, max_hash_mb: int = 10) -> DataFrame:
    """A directory as a file table: path, bytes, sha256, loc, kind, bucket, text.

    Ignored, excluded and binary files are left out. Empty files have loc 0; text is null
    where bytes are not UTF-8.
    """
    base = root.rstrip("/") if "://" in root else os.path.abspath(root).rstrip("/")
    rules = ignore_rules(list(ignore_lines))
    empty, hidden = _unlisted(spark, base, rules)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", base)) + "/", "")
    f = raw.select(rel.alias("path"), F.col("length").alias("bytes"), "content")
    if hidden:
        f = f.unionByName(_fetched(spark, base, hidden))
    if empty:
        f = f.unionByName(spark.createDataFrame([(p, 0, bytearray()) for p in empty], "path string, bytes bigint, content binary"))
    f = f.where(~ignored("path", rules)).where(~paths.is_binary_name("path"))
    for g in excludes:
        f = f.where(~F.col("path").rlike("(?i)" + paths.glob_to_regex(g)))
    f = f.where(F.position(F.lit(b"\x00"), F.substring("content", 1, 8000)) == 0)
    text = F.expr("try_validate_utf8(cast(content as string))")
    f = f.withColumn("text", text)
    return f.select("path", "bytes", tx.content_hash("content", "bytes", max_hash_mb * 1024 * 1024, hash_files).alias("sha256"), tx.line_count("text").alias("loc"), paths.file_kind("path").alias("kind"), paths.visibility("path").alias("bucket"), "text")


def _unlisted(spark: SparkSession, root: str, rules: list[tuple[str, bool]]) -> tuple[list[str], list[str]]:
    """(empty, hidden): files below a folder of any file system that a scan of it does not deliver.

    Those without bytes, and those below a name with a leading dot or underscore, but for the ignored ones. Only names are listed,
    as the scan does itself.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return [], []
    base = fs.makeQualified(path).toUri().getPath().rstrip("/")
    compiled = [(re.compile(p), yes) for p, yes in rules]
    empty, hidden, it = [], [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toUri().getPath()[len(base) + 1 :]
        if f.getLen() == 0:
            empty.append(name)
        elif any(_HIDDEN.match(x) for x in name.split("/")) and not next((yes for p, yes in reversed(compiled) if p.search(name)), False):
            hidden.append(name)
    return sorted(empty), sorted(hidden)


def _fetched(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The named files below a folder, opened by the tasks; for names that a scan passes over."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)
        for b in batches:
            for name in b.path:  # one at a time: contents may be large
                with files.open_input_stream(f"{base}/{name}") as f:
                    content = f.read()
                yield pd.DataFrame({"path": [name], "bytes": [len(content)], "content": [content]})

    parts = max(1, min(len(names) // 100, 10_000))
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(parts).mapInPandas(read, "path string, bytes bigint, content binary")


def ignore_lines(spark: SparkSession, root: str, name: str = ".gitignore", most_bytes: int = 10_000_000) -> list[str]:
    """The lines of a root's ignore file; none where there is no such file. One of more than ``most_bytes`` is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    if fs.getFileStatus(path).getLen() > most_bytes:
        raise ValueError("an ignore file is too long")
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def duplication_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows of a file table that take part in duplication: source extensions, without tests, types and generated names."""
    hidden = F.exists(F.split(paths.directory(path), "/"), lambda s: s.startswith(".") | s.isin("node_modules", "dist", "build", "coverage", "__pycache__", "target"))
    return files.where(paths.extension(path).isin(*paths.DUPLICATION_EXT) & ~F.col(path).rlike(paths.DUPLICATION_SKIP) & ~hidden)


def export_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """Source modules, below ``src`` only, without declarations and built files (whole path segments count)."""
    built = F.exists(F.split(paths.directory(path), "/"), lambda s: s.isin("node_modules", "dist"))
    return files.where(paths.extension(path).isin("ts", "tsx", "js", "jsx") & ~F.col(path).rlike(r"\.d\.ts$") & ~built & F.concat(F.lit("/"), F.col(path)).contains("/src/"))


def package_json(files: DataFrame, text: str = "text") -> DataFrame:
    """Fields of package.json texts; what does not parse gives nulls: name, private, type, main, module, bin, exports and dependencies (names, sorted)."""
    schema = "name string, private boolean, type string, main string, module string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    j = F.from_json(text, schema)
    names = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    deps = F.array_sort(F.array_distinct(F.concat(names(j["dependencies"]), names(j["devDependencies"]), names(j["peerDependencies"]))))
    keys = lambda p: F.json_object_keys(F.get_json_object(text, p))
    made = {"name", "private", "type", "main", "module", "dependencies", "bin_names", "export_keys", text}  # take the place of columns of these names
    return files.where(paths.file_name("path") == "package.json").select(
        *[c for c in files.columns if c not in made], *[j[c].alias(c) for c in ("name", "private", "type", "main", "module")], deps.alias("dependencies"), keys("$.bin").alias("bin_names"), keys("$.exports").alias("export_keys")
    )


def workspace_patterns(text: str):
    """The entries of a pnpm workspace file's ``packages`` list, as an array column."""
    block = F.regexp_extract(text, r"(?m)^packages:[ \t]*\r?\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?\r?\n?)*)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*['\"]?([^'\"#\r\n]+?)['\"]?[ \t]*(?:#[^\n]*)?\r?$"), F.lit(1)), lambda x: F.trim(x))


def workspaces(root_files: DataFrame) -> DataFrame:
    """``repo``, ``pattern``: of the pnpm workspace file, or where there is none, of ``workspaces`` in package.json (a list, or an object with ``packages``).

    ``root_files``: repo, name, text.
    """
    w = root_files.where("name = 'pnpm-workspace.yaml'").select("repo", F.explode(workspace_patterns("text")).alias("pattern"))
    listed = F.coalesce(F.from_json(F.get_json_object("text", "$.workspaces.packages"), "array<string>"), F.from_json(F.get_json_object("text", "$.workspaces"), "array<string>"))
    p = root_files.where("name = 'package.json'").select("repo", F.explode(listed).alias("pattern")).where("pattern is not null")
    own = root_files.where("name = 'pnpm-workspace.yaml'").select("repo").distinct()
    return w.unionByName(p.join(own, "repo", "left_anti")).distinct()


def expand_workspaces(directories: DataFrame, patterns: DataFrame) -> DataFrame:
    """``repo``, ``dir`` of the package directories that a pattern (``.``, a path, or a path with a trailing ``/*``) names."""
    d = directories.select("repo", "dir").distinct().withColumn("parent", F.regexp_replace("dir", r"/?[^/]*$", ""))
    p = patterns.select("repo", "pattern").distinct()
    star = p.where(F.col("pattern").endswith("/*")).select("repo", F.regexp_replace("pattern", r"/\*$", "").alias("parent"))
    plain = p.where(~F.col("pattern").endswith("/*")).select("repo", F.when(F.col("pattern") == ".", "").otherwise(F.col("pattern")).alias("dir"))
    return d.join(star, ["repo", "parent"]).select("repo", "dir").unionByName(d.join(plain, ["repo", "dir"]).select("repo", "dir")).distinct()


def package_dirs(files: DataFrame) -> DataFrame:
    return files.where(paths.file_name("path") == "package.json").select("repo", paths.directory("path").alias("dir")).distinct()


def stored_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored graph or export document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def stored_pack(spark: SparkSession, root: str) -> DataFrame:
    """Files of a written pack with their token estimates; whole file names count, so ``x.d.ts`` is a stub file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(r"\.(json|ndjson|d\.ts|md|txt)$"))
    n = F.length(F.col("content").cast("string"))
    return f.select("path", n.alias("chars"), tx.tokens_conservative(n).alias("conservative"), tx.tokens_optimistic(n).alias("optimistic"), tx.tokens_average(n).alias("average"))


def git_state(root: str) -> dict[str, str | bool]:
    """Commit, branch and whether there are changes; empty where git or a repository is missing."""

    def ask(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    commit = ask("rev-parse", "HEAD")
    return {"commit": commit, "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(ask("status", "--porcelain"))} if commit else {}


def safe_output(path: str, root: str | None = None, kind: str | None = None) -> str:
    """An output path that is allowed: no control characters or reserved names, inside ``root`` once links are resolved, below a folder that can be written to.

    ``kind`` (``file`` or ``folder``): what may stand there already.
    """
    if not path or any(ord(c) < 32 for c in path) or any(c in path for c in '<>"|?*'):
        raise ValueError("a path has characters that are not allowed")
    if any(p.split(".")[0].upper() in {"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))} for p in Path(path).parts):
        raise ValueError("a path has a reserved name")
    full = Path(path if os.path.isabs(path) or root is None else os.path.join(root, path)).resolve()
    if root is not None and not full.is_relative_to(Path(root).resolve()):
        raise ValueError("a path leaves its root")
    if kind and full.exists() and full.is_dir() != (kind == "folder"):
        raise ValueError(f"there is something else than a {kind}")
    there = next(p for p in (full, *full.parents) if p.exists())
    if there != full and not there.is_dir():
        raise ValueError("a path leads through a file")
    if not os.access(there, os.W_OK):
        raise PermissionError("a path cannot be written to")
    return str(full)
