"""Catalogues: exports, schema files, type usage, configurations, packages, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import paths

# What an exported declaration looks like at the start of a line, by kind.
EXPORT_PATTERNS = (
    ("function", r"(?m)^[ \t]*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("class", r"(?m)^[ \t]*export\s+(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"(?m)^[ \t]*export\s+(?:default\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("type", r"(?m)^[ \t]*export\s+type\s+([A-Za-z_$][\w$]*)"),
    ("enum", r"(?m)^[ \t]*export\s+(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("var", r"(?m)^[ \t]*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
)
# The plainer patterns by which names are listed; they stand at line starts and know no modifiers.
NAME_PATTERNS = tuple(rf"(?m)^export\s+{k}\s+([a-zA-Z_$][a-zA-Z0-9_$]*)" for k in ("(?:const|let|var)", "function", "class", "interface", "type", "enum"))
NAME_LIST = r"(?m)^export\s*\{\s*([^}]+)\s*\}"
NAME_DEFAULT = r"(?m)^export\s+default"
EXPORT_DEFAULT = r"(?m)^[ \t]*export\s+default\b"
IDENTIFIER = r"^[A-Za-z_$][\w$]*$"
KEYWORDS = {"any": r"\bany\b", "unknown": r"\bunknown\b", "never": r"\bnever\b", "satisfies": r"\bsatisfies\b"}
# Assertions, counted where import and export clauses are left out.
CLAUSES = r"\b(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?(?:\*\s*as\s+[\w$]+|\{[^}]*\})"
ASSERTIONS = {"as_const": r"\bas\s+const\b", "assertions": r"\bas\s+[A-Za-z_$'({\[]|[=(,]\s*<[A-Za-z_$][\w$.]*(?:\[\])?>\s*[\w$'{\[]"}
ANNOTATION, TOKEN = r"[\w\])?]\s*:\s*[A-Za-z{\[(]", r"[A-Za-z_$][\w$]*|\d+|[^\s\w]"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def without_comments(text: Column | str) -> Column:
    """Code without comments and with string contents emptied; line breaks of comments are kept by a blank."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, r"(?s)/\*.*?\*/", " ")
    t = F.regexp_replace(t, r"'[^'\n]*'|\"[^\"\n]*\"", "''")
    return F.regexp_replace(t, r"//[^\n]*", "")


def export_names(text: Column | str) -> Column:
    """Sorted distinct names a module exports, by patterns at line starts; of ``a as b`` the name is a, a default export adds ``default``."""
    t = F.col(text) if isinstance(text, str) else text
    listed = F.flatten(F.transform(_all(t, NAME_LIST), lambda body: F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+as\s+\w+", ""), r"[\s]+", " ")))))
    names = F.concat(*[_all(t, p) for p in NAME_PATTERNS], F.filter(listed, lambda x: x.rlike(IDENTIFIER)))
    names = F.when(t.rlike(NAME_DEFAULT), F.array_append(names, "default")).otherwise(names)
    return F.array_sort(F.array_distinct(names))


def exports(files: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per exported name and kind: ``keys``, ``name``, ``kind`` (re-exports, with a source, are ``reexport``).

    Only statements at line starts count, and none in comments or strings.
    """
    t = without_comments(text_col)
    as_kind = lambda k: lambda x: F.struct(x.alias("name"), F.lit(k).alias("kind"))
    own = F.concat(*[F.transform(_all(t, p), as_kind(k)) for k, p in EXPORT_PATTERNS])
    lists = F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*(export\s*(?:type\s*)?\{[^}]*\}(?:\s*from\b)?)"), F.lit(1))

    def entries(x: Column) -> Column:
        kind = F.when(x.rlike(r"\}\s*from$"), "reexport").otherwise("var")
        parts = F.filter(F.transform(F.split(F.regexp_extract(x, r"\{([^}]*)\}", 1), ","), lambda y: F.regexp_replace(F.trim(F.regexp_replace(y, r"\s+", " ")), r"^type |^.* as ", "")), lambda y: y.rlike(IDENTIFIER))
        return F.transform(parts, lambda y: F.struct(y.alias("name"), kind.alias("kind")))

    star = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*export\s*\*\s*as\s+([A-Za-z_$][\w$]*)"), F.lit(1)), lambda y: F.struct(y.alias("name"), F.lit("reexport").alias("kind")))
    default = F.when(t.rlike(EXPORT_DEFAULT), F.array(F.struct(F.lit("default").alias("name"), F.lit("default").alias("kind")))).otherwise(F.array().cast("array<struct<name:string,kind:string>>"))
    return files.where(F.col(text_col).isNotNull()).select(*keys, F.explode(F.array_distinct(F.concat(own, F.flatten(F.transform(lists, entries)), star, default))).alias("e")).select(*keys, "e.name", "e.kind")


def exports_summary(exported: DataFrame, key: str) -> DataFrame:
    """Per key: exports, re-exports, defaults, distinct kinds as a sorted list of ``kind=n``."""
    k = exported.groupBy(key, "kind").agg(F.count("*").alias("n"))
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    return k.groupBy(key).agg(
        F.sum("n").cast("bigint").alias("n_exports"), pick("reexport").alias("n_reexports"), pick("default").alias("n_defaults"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("by_kind")
    )


def schema_class(path: Column | str) -> Column:
    """zod, yup, contract, validator, schema or other, by the file name; the first that fits."""
    n = F.lower(paths.file_name(path))
    return F.when(n.contains("zod"), "zod").when(n.contains("yup"), "yup").when(n.contains("contract"), "contract").when(n.contains("validator") | n.contains("validation"), "validator").when(n.contains("schema"), "schema").otherwise("other")


def schema_framework(cls: Column) -> Column:
    return F.when(cls.isin("zod", "yup"), cls).otherwise("custom")


def schema_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """The rows of ``files`` whose name is that of a schema file."""
    return files.where(F.col(path_col).rlike(paths.SCHEMA_NAME))


def repeated_names(exported: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` names exported by most files, of those exported by more than one; ties by name."""
    n = exported.select(key, "name").distinct().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return n.orderBy(F.desc("n"), "name").limit(k)


def schema_summary(schemas: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: schema files, how many exports they have, and the files of each class as sorted ``class=n``.

    ``schemas``: path, class; ``exported``: path, name.
    """
    k = schemas.groupBy("class").agg(F.count("*").alias("n"))
    a = k.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_files"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "class", "n"))), ",").alias("by_class"))
    e = exported.join(schemas.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("n_exports"))
    return a.crossJoin(e).select("n_files", "n_exports", "by_class")  # one row each


def type_metrics(files: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Per row the counts of type keywords outside comments and strings, of assertions (``as``, also ``as const``, and angle brackets), of annotations, and of tokens."""
    code = without_comments(text_col)
    plain = F.regexp_replace(code, CLAUSES, " ")
    count = lambda t, p: F.regexp_count(t, F.lit(p)).cast("bigint")
    cols = {k: count(code, p) for k, p in KEYWORDS.items()} | {k: count(plain, p) for k, p in ASSERTIONS.items()} | {"annotations": count(code, ANNOTATION), "tokens": count(code, TOKEN)}
    return files.where(F.col(text_col).isNotNull()).select(*keys, *[c.alias(n) for n, c in cols.items()])


def type_ratios(metrics: DataFrame, key: str | None = None) -> DataFrame:
    """Sums of ``type_metrics`` per key (or of all), with ``any_ratio`` and ``annotated_ratio`` over the tokens, 0 where there are none."""
    names = [*KEYWORDS, *ASSERTIONS, "annotations", "tokens"]
    g = (metrics.groupBy(key) if key else metrics.groupBy()).agg(F.count("*").alias("n_files"), *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    over = lambda c: F.when(F.col("tokens") > 0, F.col(c) / F.col("tokens")).otherwise(0.0)
    return g.withColumns({"any_ratio": over("any"), "annotated_ratio": over("annotations")})


def rollup_metrics(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of ``values`` for every prefix of ``keys`` down to the grand total."""
    return metrics.rollup(*keys).agg(F.count("*").alias("n_files"), *[F.sum(v).cast("bigint").alias(v) for v in values])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``value``, ``n``: how often each value occurs, null as ``(none)``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))


# What speaks for a language at the root of a repository, and how much.
LANGUAGE_EVIDENCE = (
    ("typescript", "tsconfig", 0.4), ("typescript", "strict", 0.1), ("typescript", "esm", 0.1), ("typescript", "type-module", 0.15), ("typescript", "typescript-dependency", 0.2), ("typescript", "node-types", 0.1),
    ("python", "pyproject.toml", 0.4), ("python", "requirements.txt", 0.2), ("python", "setup.py", 0.2), ("python", "Pipfile", 0.3), ("rust", "Cargo.toml", 0.95), ("go", "go.mod", 0.5), ("go", "go.work", 0.4),
)
LANGUAGE_CAPS = {"typescript": 0.95, "python": 0.9, "rust": 0.95, "go": 0.9}
LANGUAGE_LEAST = {"typescript": 0.2, "python": 0.2, "rust": 0.0, "go": 0.3}
LOCKFILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"))
# What marks a monorepo, and how surely.
MONOREPOS = {"pnpm-workspace": 0.95, "npm-workspaces": 0.8, "yarn-workspaces": 0.85, "rush": 0.9, "turbo": 0.7, "lerna": 0.75}


def _evidence(root_files: DataFrame) -> DataFrame:
    """``repo``, ``fact``: what the root files (``repo``, ``name``, and ``text`` where it is at hand) say."""
    f = root_files if "text" in root_files.columns else root_files.withColumn("text", F.lit(None).cast("string"))
    n, field = F.col("name"), lambda p: F.get_json_object("text", p)
    plain = F.when(n == "tsconfig.json", "tsconfig").otherwise(n)
    config, package = n == "tsconfig.json", n == "package.json"
    esm = (F.lower(field("$.compilerOptions.module")) == "esnext") | (F.lower(field("$.compilerOptions.moduleResolution")) == "bundler")
    facts = F.array(
        plain, F.when(config & (field("$.compilerOptions.strict") == "true"), "strict"), F.when(config & esm, "esm"), F.when(package & (field("$.type") == "module"), "type-module"),
        F.when(package & F.coalesce(field("$.devDependencies.typescript"), field("$.dependencies.typescript")).isNotNull(), "typescript-dependency"),
        F.when(package & field("$.devDependencies['@types/node']").isNotNull(), "node-types"), F.when(package & field("$.workspaces").isNotNull(), "workspaces"),
    )
    return f.select("repo", F.explode(F.array_compact(facts)).alias("fact")).distinct()


def detect_languages(root_files: DataFrame) -> DataFrame:
    """``repo``, ``language``, ``confidence``: added up over the evidence at the root (``repo``, ``name`` and, if at hand, ``text``), capped; faint evidence is none."""
    s = root_files.sparkSession
    m = s.createDataFrame(list(LANGUAGE_EVIDENCE), "language string, fact string, weight double")
    c = s.createDataFrame([(k, LANGUAGE_CAPS[k], LANGUAGE_LEAST[k]) for k in LANGUAGE_CAPS], "language string, cap double, least double")
    got = _evidence(root_files).join(F.broadcast(m), "fact").groupBy("repo", "language").agg(F.round(F.sum("weight"), 6).alias("w"))
    return got.join(F.broadcast(c), "language").where("w > least").select("repo", "language", F.least("w", "cap").alias("confidence"))


def detect_monorepos(root_files: DataFrame) -> DataFrame:
    """``repo``, ``tool``, ``confidence`` of every monorepo marker at the root; workspaces in package.json count more with a yarn lockfile."""
    e = _evidence(root_files).groupBy("repo").agg(F.collect_set("fact").alias("f"))
    has = lambda x: F.array_contains("f", x)
    found = F.array(
        F.when(has("pnpm-workspace.yaml"), "pnpm-workspace"), F.when(has("workspaces"), F.when(has("yarn.lock"), "yarn-workspaces").otherwise("npm-workspaces")), F.when(has("rush.json"), "rush"), F.when(has("turbo.json"), "turbo"), F.when(has("lerna.json"), "lerna"),
    )
    sure = F.create_map(*[F.lit(x) for kv in MONOREPOS.items() for x in kv])
    return e.select("repo", F.explode(F.array_compact(found)).alias("tool")).select("repo", "tool", F.try_element_at(sure, F.col("tool")).alias("confidence"))


def surest(detected: DataFrame, what: str) -> DataFrame:
    """Per repository the detection of the highest confidence; ties by name."""
    return detected.groupBy("repo").agg(F.max_by(F.struct(what, "confidence"), F.struct("confidence", F.col(what))).alias("x")).select("repo", f"x.{what}", "x.confidence")


def choose_presets(languages: DataFrame, monorepos: DataFrame) -> DataFrame:
    """``repo``, ``preset``, ``confidence``: the first rule that the detections of a repository meet; repositories without detections do not appear."""
    d = languages.select("repo", F.col("language").alias("x"), "confidence").unionByName(monorepos.select("repo", F.col("tool").alias("x"), "confidence"))
    g = d.groupBy("repo").agg(F.collect_set("x").alias("f"))
    best = surest(languages, "language").select("repo", F.col("language").alias("best"))
    has = lambda x: F.array_contains("f", x)
    rule = lambda name, sure: F.struct(F.lit(name).alias("preset"), F.lit(sure).alias("confidence"))
    ts = has("typescript")
    chosen = F.when(has("pnpm-workspace") & ts, rule("ts-pnpm", 0.95)).when((has("npm-workspaces") | has("yarn-workspaces")) & ts, rule("ts-npm", 0.85)).when(has("python"), rule("py-poetry", 0.7)).when(has("rust"), rule("rust-cargo", 0.8))
    chosen = chosen.when(F.col("best") == "typescript", rule("ts-simple", 0.6)).otherwise(rule("default", 0.0))
    return g.join(best, "repo", "left").withColumn("c", chosen).select("repo", "c.preset", "c.confidence")


def detect_tool(root_files: DataFrame, markers: tuple) -> DataFrame:
    """``repo``, ``tool``: of the marker files present, the first in the order of ``markers``."""
    m = root_files.sparkSession.createDataFrame([(x[0], x[1], i) for i, x in enumerate(markers)], "name string, tool string, p int")
    return root_files.select("repo", "name").distinct().join(F.broadcast(m), "name").groupBy("repo").agg(F.min_by("tool", "p").alias("tool"))
