"""Import specifiers to files, and names to declarations: candidate tables and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import paths

# What may be appended to a specifier, in order of preference.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def joined_path(base: str, relative: str):
    """A relative specifier put against a directory, with ``.`` and ``..`` worked in."""
    parts = F.filter(F.split(F.concat_ws("/", F.col(base), F.col(relative)), "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    )
    return F.array_join(folded, "/")


def resolve(edges: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds ``resolved``, the file of the same repository a relative or aliased specifier means, else null.

    ``edges``: repo, src, specifier; ``files``: repo, path. ``aliases``: prefix -> directory.
    Candidates are tried in the order of SUFFIXES; ``x.js`` also stands for ``x.ts`` and
    ``x.tsx``. Distinct (repo, directory, specifier) are resolved once. Null specifiers
    resolve to nothing; bare package names are left to ``package_of``.
    """
    spec = F.col("specifier")
    ask = edges.select("repo", paths.directory("src").alias("dir"), "specifier").where("specifier is not null").distinct()
    target = F.when(paths.is_relative(spec), joined_path("dir", "specifier"))
    for prefix, directory in (aliases or {}).items():
        target = target.when(spec.startswith(prefix), F.concat(F.lit(directory), F.expr(f"substring(specifier, {len(prefix) + 1})")))
    ask = ask.withColumn("base", target).where("base is not null")
    plain = F.array(*[F.struct(F.lit(i).alias("p"), F.concat(F.col("base"), F.lit(s)).alias("path")) for i, s in enumerate(SUFFIXES)])
    stem = F.regexp_replace("base", r"\.m?js$", "")
    as_ts = F.when(F.col("base").rlike(r"\.m?js$"), F.array(*[F.struct(F.lit(100 + i).alias("p"), F.concat(stem, F.lit(s)).alias("path")) for i, s in enumerate((".ts", ".tsx", ".mts"))]))
    empty = F.array().cast("array<struct<p:int,path:string>>")
    cand = ask.select("repo", "dir", "specifier", F.explode(F.concat(plain, F.coalesce(as_ts, empty))).alias("c")).select("repo", "dir", "specifier", "c.p", "c.path")
    hit = cand.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("repo", "dir", "specifier").agg(F.min_by("path", "p").alias("resolved"))
    return edges.withColumn("dir", paths.directory("src")).join(hit, ["repo", "dir", "specifier"], "left").drop("dir")


def workspace_dependencies(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """Per package, its dependencies on workspace packages and on others, each sorted.

    ``deps``: repo, package, dependency; ``packages``: repo, name. The whole workspace counts,
    whatever the order of listing.
    """
    p = packages.select("repo", F.col("name").alias("dependency"), F.lit(True).alias("own")).distinct()
    d = deps.select("repo", "package", "dependency").distinct().join(p, ["repo", "dependency"], "left")
    pick = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(c, F.col("dependency")))))
    return d.groupBy("repo", "package").agg(pick(F.col("own").isNotNull()).alias("internal"), pick(F.col("own").isNull()).alias("external"))


def resolve_names(uses: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """Names used in a file to the symbols they mean: over the file's import bindings, then the exports.

    ``uses``: repo, path, name, kind; ``bindings``: repo, path, name, target (file), imported; ``exports``:
    repo, path, name. Adds ``to_path`` and ``to_symbol``; a name neither imported nor exported by
    its own file stays null.
    """
    e = exports.select("repo", F.col("path").alias("to_path"), F.col("name").alias("to_symbol")).distinct()
    via = uses.join(bindings.select("repo", "path", "name", F.col("target").alias("to_path"), F.col("imported").alias("to_symbol")), ["repo", "path", "name"], "left")
    via = via.withColumns({"to_path": F.coalesce("to_path", F.col("path")), "to_symbol": F.coalesce("to_symbol", F.col("name"))})
    ok = via.join(e.withColumn("known", F.lit(True)), ["repo", "to_path", "to_symbol"], "left")
    keep = lambda c: F.when(F.col("known"), F.col(c))
    return ok.select(*uses.columns, keep("to_path").alias("to_path"), keep("to_symbol").alias("to_symbol"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """For each file the configuration in the nearest directory above it: ``config`` (null where there is none).

    ``files``: repo, path; ``configs``: repo, path (of the configuration file).
    """
    parts = F.split(paths.directory("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))
    f = files.select("repo", "path").distinct()
    c = configs.select("repo", F.col("path").alias("config"), paths.directory("path").alias("dir")).groupBy("repo", "dir").agg(F.min("config").alias("config"))
    best = f.withColumn("a", F.explode(above)).select("repo", "path", "a.depth", "a.dir").join(c, ["repo", "dir"]).groupBy("repo", "path").agg(F.max_by("config", "depth").alias("config"))
    return f.join(best, ["repo", "path"], "left")


def entry_points(packages: DataFrame, files: DataFrame) -> DataFrame:
    """``repo``, ``node``: the files that a repository's root package.json (``repo``, ``text``) offers.

    Its commands (a path, or several by name), and ``exports``, ``main`` and ``module`` where they are paths. A built command below
    ``dist`` stands for its source below ``src``, if there is one. Where nothing leads to a file, ``src/index.ts`` is taken, if
    there is one.
    """
    known = files.select("repo", "path").distinct()
    field = lambda p: F.get_json_object("text", p)
    many = F.coalesce(F.map_values(F.from_json(field("$.bin"), "map<string,string>")), F.when(~field("$.bin").startswith("{"), F.array(field("$.bin"))), F.array().cast("array<string>"))
    built = F.transform(many, lambda x: F.struct(x.alias("p"), F.lit(True).alias("bin")))
    named = F.transform(F.array_compact(F.array(*[F.when(~field(f"$.{k}").rlike(r"^\s*[\[{]"), field(f"$.{k}")) for k in ("exports", "main", "module")])), lambda x: F.struct(x.alias("p"), F.lit(False).alias("bin")))
    asked = packages.select("repo", F.explode(F.concat(built, named)).alias("x")).select("repo", F.col("x.p").alias("p"), F.col("x.bin").alias("bin"))
    source = F.when(F.col("bin") & F.col("p").rlike(r"^dist/.*\.js$"), F.regexp_replace(F.regexp_replace("p", "^dist/", "src/"), r"\.js$", ".ts"))
    asked = asked.withColumn("mapped", source)
    direct = asked.join(known.withColumnRenamed("path", "mapped"), ["repo", "mapped"], "left_semi").select("repo", "p", F.col("mapped").alias("node"))
    rest = asked.join(direct.select("repo", "p"), ["repo", "p"], "left_anti").select("repo", F.lit("package.json").alias("src"), F.concat(F.lit("./"), F.regexp_replace("p", r"^\./", "")).alias("specifier")).distinct()
    found = direct.select("repo", "node").unionByName(resolve(rest, files).where("resolved is not null").select("repo", F.col("resolved").alias("node"))).distinct()
    fallback = packages.select("repo").distinct().join(found.select("repo").distinct(), "repo", "left_anti").join(known.where("path = 'src/index.ts'"), "repo").select("repo", F.col("path").alias("node"))
    return found.unionByName(fallback)
