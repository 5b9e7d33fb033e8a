"""Symbol, seed and slice functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Weights of symbol edges; higher is better.
EDGE_WEIGHTS = {"calls": 3.0, "typeRef": 2.5, "extends": 2.0, "implements": 2.0, "imports": 1.5, "sameFileSibling": 1.2, "testCovers": 1.0, "docMentions": 0.3}


def edge_weight(kind: Column | str, weights: dict[str, float] | None = None) -> Column:
    """Weight of an edge kind; unknown kinds weigh 1."""
    table = EDGE_WEIGHTS | (weights or {})
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(kind)), F.lit(1.0))


def edge_score(weight: Column | str, distance: Column | str) -> Column:
    return _c(weight) * F.pow(F.lit(0.8), _c(distance))


def scoped_edge_type(kind: Column | str) -> Column:
    return F.when(_c(kind) == "typeRef", "references").otherwise(_c(kind))


def token_estimate(name: Column | str, distance: Column | str) -> Column:
    """Tokens a symbol is likely to take: a base by the shape of its name, more at the seed, less with distance."""
    n, d = _c(name), _c(distance)
    base = (
        F.when(n.rlike(r"^I[A-Z0-9_]"), 50)
        .when(n.rlike(r"^[A-Z0-9_]"), 200)
        .when(n.rlike(r"create|build|generate"), 150)
        .otherwise(100)
    )
    factor = F.when(d == 0, F.lit(1.5)).otherwise(F.greatest(F.lit(0.5), 1 - F.lit(0.1) * d))
    return F.floor(base * factor + 0.5).cast("bigint")


def guessed_kind(name: Column | str) -> Column:
    """interface, class, constant or function, by the name alone."""
    n = _c(name)
    return (
        F.when(n.rlike(r"^I[A-Z]"), "interface")
        .when(n.rlike(r"^[A-Z][A-Z0-9_]+$"), "const")
        .when(n.rlike(r"^[A-Z]"), "class")
        .otherwise("function")
    )


def inferred_kind(name: Column | str, variant: str = "graph", member: Column | None = None) -> Column:
    """What a symbol is by the look of its name, in the variant that graphs (``graph``), slices (``slice``) or stubs (``stub``) use.

    A leading I in front of anything but a small letter means an interface, a leading capital (or mark) without underscores a
    class; suffixes tell types and enumerations. The variants differ in the order of these rules and in what is left.
    """
    n = _c(name)
    capital = lambda at: F.upper(F.substring(n, at, 1)) == F.substring(n, at, 1)
    interface = n.startswith("I") & capital(2)
    klass = capital(1) & ~n.contains("_")
    if variant == "slice":
        return F.when(member if member is not None else F.lit(False), "method").when(klass, "class").when(interface, "interface").otherwise("function")
    ends = lambda *xs: F.greatest(*[n.endswith(x) for x in xs], F.lit(False))
    first = F.when(interface, "interface").when(klass, "class")
    if variant == "graph":
        return first.when(ends("Type", "Config"), "type").when(capital(1) & ends("Enum"), "enum").otherwise("function")
    if variant == "stub":
        return first.when(ends("Type", "Config", "Options"), "type").when(capital(1) & ends("s", "Enum"), "enum").when(F.lower(F.substring(n, 1, 1)) == F.substring(n, 1, 1), "function").otherwise("const")
    raise ValueError(f"no variant is known as {variant}")


def stub(name: Column | str, kind: Column | str) -> Column:
    """A declaration that stands for a symbol outside the pack."""
    n, k = _c(name), _c(kind)
    return (
        F.when(k == "interface", F.concat(F.lit("export interface "), n, F.lit(" {\n  [key: string]: unknown;\n}")))
        .when(k == "class", F.concat(F.lit("export declare class "), n, F.lit(" {\n  constructor(...args: unknown[]);\n}")))
        .when(k == "type", F.concat(F.lit("export type "), n, F.lit(" = unknown;")))
        .when(k == "enum", F.concat(F.lit("export declare enum "), n, F.lit(" {}")))
        .when(k == "const", F.concat(F.lit("export declare const "), n, F.lit(": unknown;")))
        .otherwise(F.concat(F.lit("export declare function "), n, F.lit("(...args: unknown[]): unknown;")))
    )


def role_mark(is_seed: Column, is_leaf: Column) -> Column:
    """The mark of a symbol in an index: a seed, one that leads nowhere, or any other."""
    return F.when(is_seed, "🌱").when(is_leaf, "🍃").otherwise("🔗")


def symbol_id(path: Column | str, symbol: Column | str, line: Column | str | None = None, column: Column | str | None = None) -> Column:
    base = F.concat(_c(path), F.lit("#"), _c(symbol))
    if line is None:
        return base
    tail = F.concat(F.lit("@"), _c(line).cast("string"), F.lit(":"), F.coalesce(_c(column).cast("string") if column is not None else F.lit("1"), F.lit("1")))
    return F.when(_c(line).isNull(), base).otherwise(F.concat(base, tail))


def parse_seed(seed: Column | str) -> Column:
    """``path#symbol``, ``path#Class.member``, ``path#symbol(<hash>)``, ``path#line:42:15`` or ``path:42[:15]`` as a struct.

    Fields: path, symbol, member, line, col, valid and overload (the hash of a signature). Other forms, the empty string and
    null are not valid and have null fields.
    """
    s = _c(seed)
    opt = lambda e: F.when(e != "", e)
    named = r"^([^#:]+)#([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*))?$"
    lined = r"^([^#:]+)(?:#line)?:(\d{1,9})(?::(\d{1,9}))?$"
    loaded = r"^([^#:]+)#([A-Za-z_$][\w$]*)\(<([^>]+)>\)$"
    is_named, is_lined, is_loaded = s.rlike(named), s.rlike(lined), s.rlike(loaded)
    return F.struct(
        F.when(is_named, F.regexp_extract(s, named, 1)).when(is_lined, F.regexp_extract(s, lined, 1)).when(is_loaded, F.regexp_extract(s, loaded, 1)).alias("path"),
        F.when(is_named, F.regexp_extract(s, named, 2)).when(is_loaded, F.regexp_extract(s, loaded, 2)).alias("symbol"),
        F.when(is_named, opt(F.regexp_extract(s, named, 3))).alias("member"),
        F.when(is_lined, F.regexp_extract(s, lined, 2).cast("bigint")).alias("line"),
        F.when(is_lined, opt(F.regexp_extract(s, lined, 3)).cast("bigint")).alias("col"),
        F.coalesce(is_named | is_lined | is_loaded, F.lit(False)).alias("valid"),
        F.when(is_loaded, F.regexp_extract(s, loaded, 3)).alias("overload"),
    )


def context_range(start: Column | str, end: Column | str, total: Column | str, lines: int = 3) -> Column:
    """The range widened by ``lines`` on both sides within 1..total."""
    return F.struct(F.greatest(F.lit(1), _c(start) - lines).alias("from_line"), F.least(_c(total), _c(end) + lines).alias("to_line"))


def char_offset(text: Column | str, line: Column | str) -> Column:
    """Where a line (from 1) begins in a text, in characters."""
    parts = F.slice(F.split(_c(text), "\n"), F.lit(1), F.greatest(_c(line).cast("int") - 1, F.lit(0)))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + 1)
