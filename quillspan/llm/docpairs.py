"""Functions paired with their documentation.

Three kinds of intervals are extracted from each text, none looking at the others:
comments, functions (declarations, methods of classes, functions bound to a name; in any
number and also behind other code), and statements. An as-of interval join then attaches
to each function the nearest comment that ends before it and documents at all (no
directive, ruler, placeholder or remark behind code), and rejects it where a statement
begins in between. The intervals of a text meet only each other, so the join is a sorted
merge per Arrow batch and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that document nothing, and comments that address tools.
PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|tba|n/?a|none|wip|note|internal|public|private|deprecated|placeholder|stub)?\W*"
    r"(?:(?:write|add|fill in|document|describe|update|complete|missing|needs?|no|insert|finish)\b\W*)?"
    r"(?:(?:the|this|me|some|proper|function|method|class|documentation|docs?|description|summary|comment|docstring|details?|here|goes|text|later|document|describe|missing|yet|available|provided|placeholder|lorem ipsum)\b\W*)*$"
)
DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint(?:-\w+)*|tslint[:\w-]*|ts-(?:ignore|nocheck|expect-error|check)|prettier-ignore(?:-\w+)*|istanbul ignore|c8 ignore|v8 ignore|noqa|type:\s*ignore|pylint|pragma|fmt:|isort|mypy|ruff|jshint|jscs|flow|biome-ignore|webpack\w*:|nosec|sourceMappingURL|#?region|#?endregion|@ts-\w+)\b"
)
_SAYING_TAG = re.compile(r"(?i)^\s*[@\\](?:description|desc|summary|remarks|brief|abstract|classdesc|fileoverview)\b[:\s]*")
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]|:(?:param|type|returns?|rtype|raises?|arg|var)\b)")
_INLINE_TAG = re.compile(r"\{@[^}]*\}")
_EDGE = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+[/!]?|#+(?=\s|$)|\"\"\"|''')?|(?:\*+/|\"\"\"|''')\s*$")
_REMARK = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|note|internal|public|warning|nb|deprecated|important)\b[.:!\s-]*(?:\([^)]*\)\s*:?)?")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_PLAIN = frozenset(
    "a an the this that these those it its is are be to of in on for with and or by from as at into function method helper returns return gets get sets set given does do performs class constructor".split()
)
_DENSE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")


def prose(doc: str | None) -> str:
    """What a comment says: without its marks, tags, directives, rulers and types."""
    if not doc:
        return ""
    out = []
    for line in doc.splitlines():
        s = _EDGE.sub("", _EDGE.sub("", line)).strip()
        s = _SAYING_TAG.sub("", s)
        if _TAG.match(s) or DIRECTIVE.match(s):
            continue
        s = _INLINE_TAG.sub(" ", s).strip()
        if s and (_WORD.search(s)):
            out.append(s)
    return "\n".join(out)


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def says_something(doc: str | None, name: str | None) -> bool:
    """Whether a comment holds prose beyond the symbol's name, placeholders, tags and directives."""
    text = prose(doc)
    if not text:
        return False
    said = " ".join(text.split())
    bare = _REMARK.sub("", said).strip()
    if PLACEHOLDER.match(said) or PLACEHOLDER.match(bare):
        return False
    if len(_DENSE.findall(bare)) >= 4:
        return True
    known = {_stem(p) for p in _PART.findall(name or "")}
    flat = re.sub(r"[\W_]+", "", (name or "").lower())
    new, words = 0, 0
    for w in _WORD.findall(bare):
        words += 1
        parts = [_stem(p) for p in _PART.findall(w)] or [w]
        if w.lower() in _PLAIN or all(p in known for p in parts) or (flat and w.lower().replace("-", "") == flat):
            continue
        new += 1
    return new >= 2 and words >= 3


def _idle(doc: str) -> bool:
    """Whether a comment holds only directives, rulers or placeholders, so that it documents nothing."""
    for line in doc.splitlines():
        s = _EDGE.sub("", _EDGE.sub("", line)).strip()
        if not DIRECTIVE.match(s) and (_TAG.match(s) or _INLINE_TAG.search(s)):
            return False
    said = " ".join(prose(doc).split())
    return not said or bool(PLACEHOLDER.match(said) or PLACEHOLDER.match(_REMARK.sub("", said).strip()))


_NAME_RE = r"[#A-Za-z_$¡-￿][\w$]*"
_TS = re.compile(
    rf"(?P<fun>(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<n1>{_NAME_RE})?)"
    rf"|(?P<const>(?:export\s+)?(?:const|let|var)\s+(?P<n2>{_NAME_RE})\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?=(?:async\b\s*)?(?:function\b|\(|<|{_NAME_RE}\s*=>)))"
    rf"|(?P<meth>(?:(?:public|private|protected|static|async|override|readonly|get|set|accessor)\s+)*\*?\s*(?P<n3>{_NAME_RE}|\[[^\]\n]*\]|'[^'\n]*')\s*(?=[(<]))"
)
_NOT_METHOD = frozenset("if for while switch catch return with function await new typeof super import do else throw delete void yield".split())
_HOLDER = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?P<k>class|namespace|module)\b")
_PY_FUN = re.compile(r"(?m)^([ \t]*)(?:(?:async[ \t]+)?def[ \t]+(\w+)|(\w+)[ \t]*(?::[^=\n]+)?=[ \t]*lambda\b)")
_PY_COLON = re.compile(r"\s*(?:->[^\n]*?)?:[ \t]*")
_STR_PY = re.compile(r"[rRuUbBfF]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')", re.S)
_REGEX_BODY = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_MASK = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?:[(,=:\[!&|?{{}};+*%~^-]|\breturn)\s*{_REGEX_BODY}", re.S)
_MASK_PY = re.compile(r"#[^\n]*|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
_PAIR = re.compile(r"[(){}\[\]]")
_STOP = re.compile(r"[;\n({\[]")
_GO_ON = re.compile(r"\s*(?:[.?:&|+*/%=,)\]}-]|in\b|of\b|instanceof\b|as\b|satisfies\b)")
_TYPE = re.compile(r"[^{;\n]+")
_CLOSES = {"(": ")", "[": "]", "{": "}"}

Span = tuple[int, int, str]


def mask(text: str, python: bool) -> tuple[str, list[Span]]:
    """The text with comments blanked and literals filled, at equal offsets, and its comments (start, end, text).

    Line comments that follow one another are one; a comment behind code on its line is none that documents.
    """
    out, spans, at = [], [], 0
    for m in (_MASK_PY if python else _MASK).finditer(text):
        s, e = m.span()
        c = text[s]
        out.append(text[at:s])
        at = e
        if c in "'\"`" or python and c != "#":
            out.append('"' + "x" * (e - s - 2) + '"')
        elif c == "#" or text.startswith(("//", "/*"), s):
            out.append("".join("\n" if x == "\n" else " " for x in m.group()) if "\n" in m.group() else " " * (e - s))
            spans.append((s, e))
        else:
            k = e - s - len(re.search(_REGEX_BODY + r"\Z", m.group()).group())
            out.append(text[s : s + k] + '"' + "x" * (e - s - k - 2) + '"')
    out.append(text[at:])
    code = "".join(out)
    comments: list[Span] = []
    for s, e in spans:
        start = text.rfind("\n", 0, s) + 1
        if code[start:s].strip():
            continue
        line = text[s] == "#" or text.startswith("//", s)
        if line and comments and comments[-1][2] == "line" and not text[comments[-1][1] : s].strip(" \t\n") and text.count("\n", comments[-1][1], s) == 1:
            comments[-1] = (comments[-1][0], e, "line")
        else:
            comments.append((s, e, "line" if line else "block"))
    return code, [(s, e, text[s:e]) for s, e, _ in comments]


def _partners(code: str) -> dict[int, int]:
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in _PAIR.finditer(code):
        i = m.start()
        if code[i] in _CLOSES:
            stack.append(i)
        elif stack and _CLOSES[code[stack[-1]]] == code[i]:
            out[stack.pop()] = i
    return out


def _skip(code: str, at: int, hi: int) -> int:
    while at < hi and code[at].isspace():
        at += 1
    return at


def _without_decorators(code: str, partner: dict[int, int]) -> str:
    if "@" not in code:
        return code
    out, at = [], 0
    for m in re.finditer(r"(?m)(?<![\w$)\]])@[A-Za-z_$][\w$.]*", code):
        if m.start() >= at:
            end = partner[m.end()] + 1 if code[m.end() : m.end() + 1] == "(" and m.end() in partner else m.end()
            out += [code[at : m.start()], re.sub(r"[^\n]", " ", code[m.start() : end])]
            at = end
    return "".join(out) + code[at:]


def _block(code: str, partner: dict[int, int], at: int, hi: int) -> int:
    """Where the body of a function begins whose parameters end before ``at``, or -1; a return type may hold braces of its own."""
    at = _skip(code, at, hi)
    if code[at : at + 1] == "{":
        return at
    t = re.compile(r":\s*(?:asserts\s+)?").match(code, at, hi)
    if not t:
        return -1
    at = t.end()
    while at < hi:
        at = _skip(code, at, hi)
        if code[at : at + 1] == "{":
            if at not in partner:
                return at
            after = _skip(code, partner[at] + 1, hi)
            if code[after : after + 1] in ("|", "&"):
                at = after + 1
            elif code[after : after + 1] == "[":
                at = partner.get(after, hi) + 1
                if (x := _skip(code, at, hi)) < hi and code[x] == "{":
                    return x
            else:
                return after if code[after : after + 1] == "{" else -1
            continue
        x = _TYPE.match(code, at, hi)
        if not x:
            return -1
        head, at = x.group().rstrip(), _skip(code, x.end(), hi)
        if code[at : at + 1] != "{":
            return -1
        if head[-1:] not in ("|", "&", "<", ",", "(", ":"):
            return at
        at = partner.get(at, hi) + 1
    return -1


def _expression_end(code: str, partner: dict[int, int], at: int, hi: int) -> int:
    while True:
        m = _STOP.search(code, at, hi)
        if not m:
            return hi
        if m.group() == ";":
            return m.end()
        if m.group() == "\n":
            if not _GO_ON.match(code, m.end(), hi):
                return m.start()
            at = m.end()
        else:
            at = partner.get(m.start(), hi - 1) + 1


def _function_end(code: str, partner: dict[int, int], m: re.Match, hi: int) -> int:
    """Where the function that ``m`` begins ends, or -1 if it has no body."""
    at = m.end()
    if m.group("const"):
        at = _skip(code, at, hi)
        a = re.compile(r"async\b\s*").match(code, at, hi)
        at = a.end() if a else at
        if not code.startswith("function", at):
            if code[at : at + 1] in ("(", "<"):
                p = code.find("(", at, hi)
                if p not in partner:
                    return -1
                at = partner[p] + 1
            arrow = re.compile(r"[^;]*?=>\s*(?=\S)", re.S).match(code, at, hi)
            if not arrow:
                return -1
            at = arrow.end()
            return _expression_end(code, partner, at, hi) if code[at] != "{" else partner.get(at, hi - 1) + 1
    p = code.find("(", at, hi)
    if p not in partner:
        return -1
    b = _block(code, partner, partner[p] + 1, hi)
    return -1 if b < 0 else partner.get(b, hi - 1) + 1


def _script_spans(code: str, partner: dict[int, int]) -> tuple[list[tuple[int, int, str, str, bool]], list[int]]:
    """Functions (start, end, name, kind, implemented) outside other functions, and where statements begin or end."""
    functions, statements = [], []
    todo = [(0, len(code), False)]
    first = _skip(code, 0, len(code))
    while todo:
        at, hi, members = todo.pop()
        while (at := _skip(code, at, hi)) < hi:
            m = _TS.match(code, at, hi)
            name = (m.group("n1") or m.group("n2") or m.group("n3") or "") if m else ""
            if m and (not m.group("meth") or (members or at == first) and name not in _NOT_METHOD):
                end = _function_end(code, partner, m, hi)
                kind = "method" if m.group("meth") else "const" if m.group("const") else "function"
                if end >= 0 or not members and kind != "method":
                    stop = end if end >= 0 else _expression_end(code, partner, at, hi)
                    functions.append((at, stop, name, kind, end >= 0))
                    statements.append(stop - 1)
                    at = max(stop, at + 1)
                    continue
            statements.append(at)
            h = _HOLDER.match(code, at, hi)
            if h:
                b = code.find("{", at, hi)
                end = partner.get(b, hi - 1)
                if b >= 0:
                    todo.append((b + 1, end, h.group("k") == "class"))
                    statements.append(end)
                    at = end + 1
                    continue
            at = max(_expression_end(code, partner, at, hi), at + 1)
    return sorted(functions), sorted(statements)


def _python_spans(code: str, text: str, partner: dict[int, int]) -> tuple[list[tuple[int, int, str, str, bool, str | None]], list[int]]:
    functions, statements = [], []
    n, upto = len(code), 0
    starts = [(m.start(), m.end() - 1, len(m.group()) - 1) for m in re.finditer(r"(?m)^[ \t]*\S", code)]
    for m in _PY_FUN.finditer(code):
        if m.start() < upto:
            continue
        at, indent = m.end(1), len(m.group(1))
        if m.group(3):
            end = _expression_end(code, partner, m.end(), n)
            functions.append((at, end, m.group(3), "const", True, None))
            upto = end
            continue
        p = code.find("(", m.end())
        colon = _PY_COLON.match(code, partner[p] + 1) if p in partner else None
        if not colon:
            functions.append((at, m.end(), m.group(2), "function", False, None))
            upto = m.end()
            continue
        end = next((s for s, _, k in starts if s > colon.end() and k <= indent), n)
        inside, doc = _skip(code, colon.end(), end), None
        d = _STR_PY.match(text, inside)
        if d:
            doc, inside = next(g for g in d.groups() if g is not None), d.end()
        real = re.sub(r"(?m)^\s*(?:pass|\.\.\.|;)\s*;?\s*$|\s+|^\s*\.\.\.", "", code[inside:end])
        functions.append((at, end, m.group(2), "method" if indent and at != _skip(code, 0, n) else "function", bool(real), doc))
        upto = end
    inside = np.array([f[:2] for f in functions]).reshape(-1, 2)
    for _, at, _ in starts:
        k = np.searchsorted(inside[:, 0], at, side="right") - 1
        if k < 0 or at >= inside[k, 1]:
            statements.append(at)
    statements += [e - 1 for _, e, *_ in functions]
    return functions, sorted(statements)


def extract(body: str, python: bool) -> tuple[list[Span], list[tuple[int, int, str, str, bool, str | None, bool]], list[int]]:
    """(comments, functions, statements) of a whole text with line feeds.

    comments: (start, end, text); functions: (start, end, name, kind, implemented,
    docstring, whether the text begins with it); statements: where one begins or ends
    that is no function, and where functions end.
    """
    code, comments = mask(body, python)
    partner = _partners(code)
    code = _without_decorators(code, partner)
    first = _skip(code, 0, len(code))
    if python:
        functions, statements = _python_spans(code, body, partner)
    else:
        found, statements = _script_spans(code, partner)
        functions = [(*f, None) for f in found]
    return comments, [(*f, f[0] == first) for f in functions], statements


def documented_functions(df: DataFrame, id_col: str = "slice_id", name_col: str = "symbol_name", doc_col: str = "doc", body_col: str = "body", path_col: str = "path") -> DataFrame:
    """One code-description pair per function or method whose documentation says something.

    Rows: ``slice_id``, ``symbol_name`` (of the first function from the table, else from
    the code), ``symbol_kind`` (``function``, ``method`` or ``const``, as the code shows
    it), ``is_slice`` (whether the text begins with this function, so that the row is one),
    ``description`` and ``code``. Documentation of the function that the text begins with is ``doc``;
    only where that is null, and for all other functions, it is the comment before the
    function or the docstring that opens it. Functions inside functions are part of these.
    Bodies that are null, blank or without an implementation, blank documentation, and
    documentation that only restates the name or holds tags, directives, rulers or
    placeholders give no pair. Repeated rows are pairs of their own; a null path is read
    as TypeScript. Empty tables give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            comments, functions, statements = [], [], []
            texts = [x.replace("\r\n", "\n") for x in b.body]
            for row, (text, path) in enumerate(zip(texts, b.path, strict=True)):
                c, f, x = extract(text, bool(path) and path.lower().endswith((".py", ".pyi")))
                comments += [(row, *y) for y in c if not _idle(y[2])]
                functions += [(row, *y) for y in f if y[4]]
                statements += [(row, y) for y in x]
            f = pd.DataFrame(functions, columns=["row", "at", "stop", "fname", "kind", "real", "docstring", "first"]).astype({"row": "int64", "at": "int64"}).sort_values("at", kind="stable")
            c = pd.DataFrame(comments, columns=["row", "cs", "ce", "comment"]).astype({"row": "int64", "ce": "int64"}).sort_values("ce", kind="stable")
            x = pd.DataFrame(statements, columns=["row", "statement"]).astype("int64").sort_values("statement", kind="stable")
            # As of the function's start: the last comment that has ended, and the last statement that has begun.
            f = pd.merge_asof(f, c, left_on="at", right_on="ce", by="row")
            f = pd.merge_asof(f, x, left_on="at", right_on="statement", by="row", allow_exact_matches=False)
            near = f.comment.where(~(f.statement >= f.ce), None)
            rows = []
            for r, at, stop, fname, kind, inner, first, before in zip(f.row, f["at"], f.stop, f.fname, f.kind, f.docstring, f["first"], near, strict=True):
                nm, own = b.symbol_name.iat[r], b.doc.iat[r]
                name = (nm or fname) if first else fname
                choices = [own] if first and own is not None else [before, inner]
                said = next((y for y in choices if isinstance(y, str) and says_something(y, name)), None)
                if said is not None:
                    rows.append((b.slice_id.iat[r], (nm if nm is not None else fname) if first else fname, kind, first, prose(said), b.body.iat[r] if first else texts[r][at:stop]))
            yield pd.DataFrame(rows, columns=["slice_id", "symbol_name", "symbol_kind", "is_slice", "description", "code"])

    src = df.select(
        F.col(id_col).cast("bigint").alias("slice_id"), F.col(name_col).alias("symbol_name"), F.col(doc_col).alias("doc"), F.col(body_col).alias("body"), F.col(path_col).alias("path")
    ).where(F.col("body").isNotNull() & F.col("body").rlike(r"\S"))
    return src.mapInPandas(run, "slice_id bigint, symbol_name string, symbol_kind string, is_slice boolean, description string, code string")
