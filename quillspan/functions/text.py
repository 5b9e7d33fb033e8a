"""Text functions: sizes, tokens, lines, normalising, shingles and redaction, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("bigint")


def line_count(text: Column | str) -> Column:
    """0 for the empty text, else one more than its line feeds."""
    t = _c(text)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("bigint")


def content_hash(content: Column | str, size: Column | str, most_bytes: int = 10 * 1024 * 1024, enabled: bool = True) -> Column:
    """sha256 in hex, or ``skipped-large-file`` beyond the limit or when switched off."""
    if not enabled:
        return F.lit("skipped-large-file")
    return F.when(_c(size) > most_bytes, "skipped-large-file").otherwise(F.sha2(_c(content), 256))


def short_md5(text: Column | str) -> Column:
    return F.substring(F.md5(_c(text)), 1, 8)


def short_sha(text: Column | str) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def tokens_conservative(n: Column | str) -> Column:
    return F.ceil(_c(n) / 3).cast("bigint")


def tokens_optimistic(n: Column | str) -> Column:
    return F.ceil(_c(n) / 5).cast("bigint")


def tokens_average(n: Column | str) -> Column:
    """Mean of the two estimates, halves rounded up."""
    return F.floor((tokens_conservative(n) + tokens_optimistic(n)) / 2 + 0.5).cast("bigint")


def format_count(n: Column | str) -> Column:
    return F.format_number(_c(n), 0)


def bytes_to_tokens(n: Column | str) -> Column:
    return F.floor(_c(n) / 4).cast("bigint")


def tokens_to_bytes(n: Column | str) -> Column:
    return (_c(n) * 4).cast("bigint")


def json_size(value: Column | str) -> Column:
    """Bytes of a struct, array or map written as JSON, nulls included."""
    return F.octet_length(F.to_json(_c(value), {"ignoreNullFields": "false"})).cast("bigint")


def newlines(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def utc_day(ts: Column | str) -> Column:
    return F.concat(F.date_format(F.date_trunc("day", _c(ts)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def normalized(text: Column | str, intended_order: bool = False) -> Column:
    """Text as duplication compares it: without comments and imports, blanks collapsed.

    By default blanks are collapsed before the line-anchored import rules, as results
    must be; so a text that begins with ``import `` becomes empty. ``intended_order``
    drops import lines first.
    """
    t = F.regexp_replace(_c(text), r"(?s)/\*.*?\*/", "")
    t = F.regexp_replace(t, r"//[^\r\n]*", "")
    t = F.regexp_replace(t, r"#[^\r\n]*", "")
    imports = (r"(?m)^import\s+[^\r\n]*", r"(?m)^from\s+[^\r\n]*import\s+[^\r\n]*", r"(?m)^use\s+[^\r\n]*")
    blanks = lambda x: F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " ")
    if not intended_order:
        t = blanks(t)
    for rule in imports:
        t = F.regexp_replace(t, rule, "")
    return F.trim(blanks(t) if intended_order else t)


def shingles(normal: Column | str, words: int = 5) -> Column:
    """Hashes (8 hex digits of md5) of every run of ``words`` words; empty for shorter texts."""
    short = lambda w, i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ")), 1, 8)
    return over_words(F.split(F.trim(_c(normal)), " "), words, short)


def over_words(w: Column, words: int, f) -> Column:
    """``f(w, i)`` for the start i of every run of ``words`` elements of ``w``; empty where there is none.

    ``w`` is bound once: a plain expression inside the inner function would be evaluated
    again for every run.
    """
    runs = lambda ws: F.when(F.size(ws) >= words, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1))), lambda i: f(ws, i)))
    got = F.get(F.transform(F.array(w), runs), F.lit(0))
    return F.when(w.isNotNull(), F.coalesce(got, F.filter(F.transform(F.array(F.lit(1)), lambda i: f(w, i)), lambda _: F.lit(False))))


# What is redacted, in order; of a pattern with a group, the group is kept.
REDACTIONS = (
    ("PEM_BLOCK", r"-----BEGIN [A-Z0-9 ]+-----[^-]*(?:-----END [A-Z0-9 ]+-----)?"),
    ("PRIVATE_KEY", r"(?i)(private_?key['\"]?\s*[:=]\s*['\"`]?)[A-Za-z0-9/+=_-]{8,}"),
    ("AWS_ACCESS_KEY", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("AWS_SECRET", r"(?i)(aws_?secret(?:_?access)?(?:_?key)?['\"]?\s*[:=]\s*['\"`]?)[A-Za-z0-9/+=]{20,}"),
    ("JWT", r"eyJ[A-Za-z0-9_=-]+\.eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+"),
    ("DATABASE_URL", r"(?:postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp|mssql)://[^\s:@/'\"]*:[^\s@/'\"<>]+@[^\s'\"<>`]*"),
    ("API_KEY", r"(?i)(api_?key['\"]?\s*[:=]\s*['\"`]?)[A-Za-z0-9_-]{16,}"),
    ("TOKEN", r"(?i)(token['\"]?\s*[:=]\s*['\"`])[A-Za-z0-9_-]{20,}"),
)


def _replacement(name: str, pattern: str) -> str:
    return ("$1" if pattern.startswith("(?i)(") else "") + f"[REDACTED_{name}]"


def redacted(text: Column | str) -> Column:
    """The text with secrets replaced by ``[REDACTED_<TYPE>]``; null stays null."""
    t = _c(text)
    for name, pattern in REDACTIONS:
        t = F.regexp_replace(t, pattern, _replacement(name, pattern))
    return t


def redaction_types(text: Column | str) -> Column:
    """Types found, in the order of the rules, each tested on the text the rules before have left.

    Every step binds what the one before left, as a plain expression would be evaluated again for each use.
    """

    def step(state: Column, name: str, pattern: str) -> Column:
        def after(s: Column) -> Column:
            found = F.array_compact(F.array(F.when(s["t"].rlike(pattern), F.lit(name))))
            return F.struct(F.regexp_replace(s["t"], pattern, _replacement(name, pattern)).alias("t"), F.concat(s["k"], found).alias("k"))

        return F.get(F.transform(F.array(state), after), F.lit(0))

    state = F.struct(_c(text).alias("t"), F.array().cast("array<string>").alias("k"))
    for name, pattern in REDACTIONS:
        state = step(state, name, pattern)
    return state["k"]


def prefix_with_marker(text: Column | str, most: int, marker: str = "\n... [truncated]") -> Column:
    t = _c(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit(marker)))


def array_downsample(values: Column | str, size: Column, target: int) -> Column:
    """The first floor(n * target / size) elements, at least one."""
    v = _c(values)
    keep = F.greatest(F.lit(1), F.floor(F.size(v) * F.lit(target) / size).cast("int"))
    return F.when(size <= target, v).otherwise(F.slice(v, F.lit(1), keep))
