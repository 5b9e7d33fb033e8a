"""Language front end without a compiler: imports, declarations, typed edges, doc tags, compiler options.

All of it is pattern work over code whose comments are dropped; strings are kept where
they hold specifiers. There is no type inference, so an edge names what the text names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import paths

# Compiler options a configuration is compared by.
OPTIONS = (
    "strict", "target", "module", "moduleResolution", "verbatimModuleSyntax", "declaration", "declarationMap", "sourceMap", "esModuleInterop", "allowSyntheticDefaultImports", "noUncheckedIndexedAccess", "exactOptionalPropertyTypes",
)
# Names of the compiler's enumerations, by number and by what a configuration may say in lower case.
ENUMS = {
    "target": {"0": "ES3", "1": "ES5", "2": "ES2015", "3": "ES2016", "4": "ES2017", "5": "ES2018", "6": "ES2019", "7": "ES2020", "8": "ES2021", "9": "ES2022", "10": "ES2023", "11": "ES2024", "99": "ESNext", "es6": "ES2015"},
    "module": {"0": "None", "1": "CommonJS", "2": "AMD", "3": "UMD", "4": "System", "5": "ES2015", "6": "ES2020", "7": "ES2022", "99": "ESNext", "100": "Node16", "199": "NodeNext", "200": "Preserve", "es6": "ES2015"},
    "moduleResolution": {"1": "Classic", "2": "Node10", "3": "Node16", "99": "NodeNext", "100": "Bundler", "node": "Node10"},
}
_ID = r"[A-Za-z_$][\w$]*"
IMPORT = r"(?m)^[ \t]*(import\s+(?:type\s+)?(?:[\w$*{},\s]+?\s+from\s+)?['\"][^'\"\n]+['\"])"
REEXPORT = r"(?m)^[ \t]*(export\s+(?:type\s+)?\{[^}]*\}\s*from\s*['\"][^'\"\n]+['\"])"
STAR = r"(?m)^[ \t]*(export\s*\*\s*(?:as\s+[A-Za-z_$][\w$]*\s+)?from\s*['\"][^'\"\n]+['\"])"
DECLARATION = rf"(?m)^[ \t]*(?:export\s+)?(?:(?:default|async|abstract|declare)\s+)*(function|class|interface|type|enum|const|let)\s+({_ID})"


def no_comments(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(t, r"(?s)/\*.*?\*/", " "), r"(?m)(^|[^:'\"`\w])//[^\r\n]*", "$1")


def imports(files: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """Top-level import and export-from statements: ``keys``, ``kind`` (import, reexport, export), ``specifier`` and ``names``.

    ``names`` are the bindings of the clause as written. Dynamic imports and require calls
    are not statements and are left out. Null texts give no rows.
    """
    t = no_comments(text_col)
    part = lambda p, kind: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))
    d = files.where(F.col(text_col).isNotNull()).select(*keys, F.explode(F.concat(part(IMPORT, "import"), part(REEXPORT, "reexport"), part(STAR, "export"))).alias("x"))
    clause = F.regexp_replace(F.regexp_extract(F.col("x.s"), r"^(?:import|export)\s+(?:type\s+)?([\s\S]*?)\s*(?:from\s*)?['\"]", 1), r"[{}\s]+", " ")
    names = F.filter(F.transform(F.split(clause, ","), lambda n: F.trim(n)), lambda n: n != "")
    return d.select(*keys, F.col("x.kind").alias("kind"), F.regexp_extract(F.col("x.s"), r"['\"]([^'\"]+)['\"]$", 1).alias("specifier"), names.alias("names"))


def bindings(imported: DataFrame, keys: list[str]) -> DataFrame:
    """Local names and what they stand for in the target: ``keys``, ``name``, ``imported`` (``default``, ``*`` or a name), ``specifier``."""
    d = imported.where("kind = 'import'").select(*keys, "specifier", F.posexplode("names").alias("i", "n"))
    n = F.regexp_replace("n", r"^type ", "")
    star, alias = F.regexp_extract(n, rf"^\* as ({_ID})$", 1), F.regexp_extract(n, rf" as ({_ID})$", 1)
    return d.select(
        *keys, F.when(star != "", star).when(alias != "", alias).otherwise(n).alias("name"), F.when(star != "", "*").otherwise(F.regexp_extract(n, rf"^({_ID})", 1)).alias("imported"), "specifier"
    )


def declarations(files: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """Top-level declarations: ``keys``, ``symbol``, ``kind``, ``line`` (from 1), ``exported``."""
    line = F.posexplode(F.split(text_col, "\n")).alias("i", "l")
    d = files.where(F.col(text_col).isNotNull()).select(*keys, line).where(F.col("l").rlike(DECLARATION.replace("(?m)^[ \\t]*", "^")))
    pat = DECLARATION.replace("(?m)^[ \\t]*", "^")
    return d.select(*keys, F.regexp_extract("l", pat, 2).alias("symbol"), F.regexp_extract("l", pat, 1).alias("kind"), (F.col("i") + 1).cast("bigint").alias("line"), F.col("l").rlike(r"^export\b").alias("exported"))


def typed_edges(files: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """Names a file refers to by kind: extends, implements, typeRef (return and annotation types) and calls, with counts.

    ``keys``, ``kind``, ``name``, ``n``. Keywords and members of objects are no names.
    """
    t = F.regexp_replace(no_comments(text_col), r"'[^'\n]*'|\"[^\"\n]*\"", "''")
    word = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    lists = lambda p: F.flatten(F.transform(word(p), lambda s: F.filter(F.transform(F.split(F.regexp_replace(s, r"<[^<>]*>", ""), ","), lambda x: F.trim(x)), lambda x: x.rlike(rf"^{_ID}$"))))
    parts = {
        "extends": lists(rf"\bextends\s+({_ID}(?:<[^<>]*>)?(?:\s*,\s*{_ID}(?:<[^<>]*>)?)*)"),
        "implements": lists(rf"\bimplements\s+({_ID}(?:<[^<>]*>)?(?:\s*,\s*{_ID}(?:<[^<>]*>)?)*)"),
        "typeRef": word(r"[)\w?]\s*:\s*(?:Promise<)?([A-Z][\w$]*)"),
        "calls": F.filter(word(rf"(?:^|[^.\w$])({_ID})\s*\("), lambda x: ~x.isin("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "super", "import", "constructor", "throw")),
    }
    tagged = lambda kind: lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))
    every = F.concat(*[F.transform(a, tagged(k)) for k, a in parts.items()])
    d = files.where(F.col(text_col).isNotNull()).select(*keys, F.explode(every).alias("e"))
    return d.groupBy(*keys, F.col("e.kind").alias("kind"), F.col("e.name").alias("name")).agg(F.count("*").alias("n"))


def doc_tags(docs: DataFrame, keys: list[str], doc_col: str = "doc") -> DataFrame:
    """Tags of doc comments: ``keys``, ``tag``, ``text``."""
    tags = F.regexp_extract_all(F.col(doc_col), F.lit(r"(?m)^[ \t]*(?:/?\*+)?[ \t]*(@[A-Za-z]+[^\r\n]*)"), F.lit(1))
    d = docs.where(F.col(doc_col).isNotNull()).select(*keys, F.explode(tags).alias("t"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("t", r"^@[A-Za-z]+", ""), r"\*/\s*$", ""))
    return d.select(*keys, F.regexp_extract("t", r"^@([A-Za-z]+)", 1).alias("tag"), clean.alias("text"))


def _option(name: str, value: Column) -> Column:
    """An option's value as text; enumerations get their proper names, also from numbers and lower case."""
    if name not in ENUMS:
        return value
    names = ENUMS[name] | {v.lower(): v for v in ENUMS[name].values()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(value)), value)


def compiler_options(configs: DataFrame, text_col: str = "text", packages: DataFrame | None = None) -> DataFrame:
    """``repo``, ``path``, ``name`` and the compared options as a map of each configuration (repo, path, text).

    Comments and trailing commas are allowed. The root's name is ``root``; others are called
    by the name of the package (``packages``: repo, dir, package) in their directory, else by its path.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(text_col), r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|/\*.*?\*/|//[^\n]*', "$1"), r",(\s*[}\]])", "$1")
    entry = lambda o: F.struct(F.lit(o).alias("key"), _option(o, F.get_json_object(plain, f"$.compilerOptions.{o}")).alias("value"))
    options = F.map_from_entries(F.filter(F.array(*[entry(o) for o in OPTIONS]), lambda e: e["value"].isNotNull()))
    c = configs.select("repo", "path", paths.directory("path").alias("dir"), options.alias("options"))
    if packages is None:
        c = c.withColumn("package", F.lit(None).cast("string"))
    else:
        c = c.join(packages.groupBy("repo", "dir").agg(F.min("package").alias("package")), ["repo", "dir"], "left")
    return c.select("repo", "path", F.when(F.col("dir") == "", "root").otherwise(F.coalesce("package", F.translate("dir", "/", "-"))).alias("name"), "options")


def option_delta(options: DataFrame) -> DataFrame:
    """Options in which a configuration differs from its repository's root one: repo, name, option, value, root_value; what only the root sets has a null value."""
    flat = options.select("repo", "name", F.explode("options").alias("option", "value"))
    root = flat.where("name = 'root'").select("repo", "option", F.col("value").alias("root_value"))
    others = options.where("name <> 'root'").select("repo", "name").distinct()
    either = flat.where("name <> 'root'").select("repo", "name", "option").union(others.join(root, "repo").select("repo", "name", "option")).distinct()
    d = either.join(flat, ["repo", "name", "option"], "left").join(root, ["repo", "option"], "left")
    return d.where(~F.col("value").eqNullSafe(F.col("root_value"))).select("repo", "name", "option", "value", "root_value")


def config_summary(options: DataFrame) -> DataFrame:
    """One row: configurations, strict ones, ones with modern modules, with declarations, and how often each target and module occurs (sorted ``value=n``)."""
    v = lambda o: F.try_element_at("options", F.lit(o))
    one = options.agg(
        F.count("*").alias("n_configs"), F.count_if(v("strict") == "true").alias("n_strict"), F.count_if(v("module").isin("ESNext", "ES2022", "ES2020")).alias("n_esm"), F.count_if(v("declaration") == "true").alias("n_declaration")
    )
    for o in ("target", "module"):
        n = options.select(v(o).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
        one = one.crossJoin(n.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "v", "n"))), ",").alias(o + "s")))  # one row each
    return one


def find_configs(files: DataFrame, workspaces: DataFrame, names: tuple[str, ...] = ("tsconfig.json", "jsconfig.json")) -> DataFrame:
    """``repo``, ``dir``, ``path``: of the root and of each workspace directory (repo, dir) the first configuration there is, in the order of ``names``."""
    d = files.select("repo", "path", paths.directory("path").alias("dir"), paths.file_name("path").alias("name")).where(F.col("name").isin(*names))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    first = d.groupBy("repo", "dir").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))
    wanted = workspaces.select("repo", "dir").union(files.select("repo", F.lit("").alias("dir"))).distinct()
    return first.join(wanted, ["repo", "dir"], "left_semi")
