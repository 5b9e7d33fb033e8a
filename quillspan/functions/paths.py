"""Path and specifier functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, in the order of the rules that use them.
CONFIG_EXT = ("json", "yaml", "yml", "toml", "ini", "cfg", "config", "eslintrc", "prettierrc", "gitignore", "dockerignore")
DOCS_EXT = ("md", "txt", "rst", "adoc")
CODE_EXT = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "kt", "swift", "dart", "scala", "clj")
BINARY_EXT = (
    "exe", "bin", "dll", "so", "dylib", "a", "lib", "o", "obj", "png", "jpg", "jpeg", "gif", "bmp", "webp", "ico", "mp3", "mp4", "avi", "mov", "wmv", "flv", "wav", "ogg",
    "zip", "tar", "gz", "rar", "7z", "bz2", "xz", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "woff", "woff2", "ttf", "otf", "eot",
)
DUPLICATION_EXT = ("ts", "tsx", "js", "jsx", "py", "rs", "go")
DUPLICATION_SKIP = r"\.d\.ts$|\.min\.js$|\.bundle\.js$|\.generated\.|\.snap$|\.lock$|__generated__|__snapshots__|\.test\.|\.spec\.|(?i:license)|(?i:readme)"
SCHEMA_NAME = r"(?i)(?:(?:schema|zod|yup|contract|validator|validation)[^/]*|types?)\.ts$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: Column | str) -> Column:
    """Lower-case text after the last dot of the whole path; the path itself where it has none."""
    return F.lower(F.regexp_extract(_c(path), r"([^.]*)$", 1))


def posix(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def directory(path: Column | str) -> Column:
    """Everything before the last slash; empty for a file at the root."""
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def file_kind(path: Column | str) -> Column:
    """test, config, docs, code or asset; the first rule that holds decides. Null paths are assets."""
    p = F.lower(_c(path))
    ext = extension(path)
    return (
        F.when(p.contains("test") | p.contains("spec") | p.contains("__tests__"), "test")
        .when(ext.isin(*CONFIG_EXT) | p.contains("config"), "config")
        .when(ext.isin(*DOCS_EXT) | p.contains("readme") | p.contains("doc"), "docs")
        .when(ext.isin(*CODE_EXT), "code")
        .otherwise("asset")
    )


def visibility(path: Column | str) -> Column:
    """internal before public before unknown."""
    p = F.lower(_c(path))
    return (
        F.when(p.contains("internal") | p.contains("private"), "internal")
        .when(p.contains("public") | p.contains("api") | p.contains("contracts"), "public")
        .otherwise("unknown")
    )


def is_binary_name(path: Column | str) -> Column:
    return extension(path).isin(*BINARY_EXT)


def is_relative(specifier: Column | str) -> Column:
    return _c(specifier).rlike(r"^(?:\./|\.\./|/)")


def package_of(specifier: Column | str) -> Column:
    """Package a specifier names: ``@scope/name`` or the part up to the first slash; empty for relative ones."""
    s = _c(specifier)
    return F.when(is_relative(s), "").otherwise(F.regexp_extract(s, r"^(@[^/]+/[^/]+|[^/]+)", 1))


def package_of_installed(path: Column | str) -> Column:
    """Package a path below node_modules belongs to; ``@types/x`` stands for x. Null elsewhere."""
    got = F.regexp_extract(_c(path), r"(?:^|/)node_modules/(?:@types/)?(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(got != "", got)


def matches_pattern(text: Column | str, pattern: str) -> Column:
    """A pattern with ``*`` is an unanchored regular expression in which ``*`` is any text; any other is a substring."""
    return _c(text).rlike(pattern.replace("*", ".*")) if "*" in pattern else _c(text).contains(pattern)


def glob_to_regex(glob: str, ignore_file: bool = False) -> str:
    """A glob as an anchored regular expression. ``**`` crosses directories; with ``ignore_file``, .gitignore rules hold."""
    import re

    g = glob.strip()
    below = ""
    if ignore_file:
        if g.endswith("/"):
            g, below = g[:-1], "/.*"
        rooted = "/" in g.rstrip("/")
        g = g.lstrip("/")
        if not rooted:
            g = "**/" + g
        below = below or "(?:/.*)?"
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "{" and "}" in g[i:]:
            end = g.index("}", i)
            out, i = out + "(?:" + "|".join(glob_to_regex(x)[1:-1] for x in g[i + 1 : end].split(",")) + ")", end + 1
        elif g[i] == "[" and "]" in g[i + 1 :]:
            end = g.index("]", i + 1)
            out, i = out + g[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return f"^{out}{below}$"


def test_path(path: Column | str, stories: bool = False) -> Column:
    return _c(path).rlike(r"\.test\.|\.spec\.|/__tests__/|/test/|/tests/" + (r"|\.stories\." if stories else ""))


def doc_path(path: Column | str, wide: bool = False) -> Column:
    return _c(path).rlike(r"\.md$|/docs/|/documentation/" + (r"|\.mdx$|/doc/|(?i:readme)|(?i:changelog)" if wide else ""))
