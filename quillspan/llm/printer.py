"""Canonical layout of source texts: each text is lexed by its language and its tokens are emitted again by one rule.

The rule is that of common formatters: a statement a line, blocks and bracket pairs wider
than the line broken at their separators, everything else on one line, one blank between
tokens. Emitted are token classes, since the comparison asks for shapes and sizes only.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass
from itertools import accumulate

from quillspan.llm import syntax

WIDTH = 100
_OPEN = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[(){}\[\]]")
_STRUCTURE = re.compile(r"[(){}\[\];,\n]")
_LITERAL = re.compile(r"[s1tL]")
# A line feed after one of these, or before one of those, ends no statement.
_GOES_ON = frozenset("=o,.?:|&A+*(<q@~!e")
_CARRIES_ON = frozenset(".?:,=o|&+)*]a")


@dataclass
class Layout:
    """``lines``: shapes of the canonical lines; ``n_lines``: the original's lines with code; ``literals`` and ``names``: how many tokens are such."""

    lines: list[str]
    n_lines: int
    literals: int
    names: int

    @property
    def expansion(self) -> float:
        """Canonical lines over the original's lines."""
        return len(self.lines) / max(1, self.n_lines)

    @property
    def uniformity(self) -> float:
        """Share of canonical lines whose shape is that of the line a fixed number of lines before (the best of 1 to 8); 0 below 10 lines."""
        x, n = self.lines, len(self.lines)
        return max(sum(map(operator.eq, x[p:], x)) / (n - p) for p in range(1, min(9, n // 2))) if n >= 10 else 0.0

    @property
    def literal_share(self) -> float:
        """Literals among literals, names and words."""
        return self.literals / max(1, self.literals + self.names)


@functools.cache
def _lexer(python: bool):
    """Token pattern, classes, classes that go on after a block, classes before which a brace opens a value, and the classes of names and words."""
    if python:
        _, classes, char = syntax._python()
        return syntax._PY_TOKEN, classes, frozenset(), frozenset(), re.compile(f"[n{re.escape(''.join(char.values()))}]")
    _, classes, _ = syntax._script(True)
    word = lambda text: frozenset(classes[w] for w in text.split())
    words = "".join(classes[w] for w in (*syntax._KEYWORDS, *syntax._CONTEXTUAL, *syntax._TS_CONTEXTUAL))
    values = word("return typeof in of import export const let var case extends type") | frozenset("=:,([?o|&A+<*")
    return syntax._TOKEN, classes, word("else catch finally while from") | frozenset(";,)].("), values, re.compile(f"[n{re.escape(words)}]")


def canonical(text: str, python: bool) -> Layout:
    """The canonical layout of ``text``. Brackets without partner are taken to close at the end; any text has a layout."""
    token, classes, glue, values, words = _lexer(python)
    tokens = token.findall(text)
    cs = list(map(classes.__getitem__, tokens))
    s = "".join([c[:1] for c in cs])  # comments have no class
    width = list(accumulate([0 if c == "\n" else len(t) + 1 for t, c in zip(tokens, cs, strict=True) if c], initial=0))
    n = len(s)
    partner: dict[int, int] = {}
    stack: list[int] = []
    for m in _BRACKET.finditer(s):
        c, i = m.group(), m.start()
        if c in _OPEN:
            stack.append(i)
        elif stack and _OPEN[s[stack[-1]]] == c:
            partner[stack.pop()] = i
    lines: list[str] = []
    start = 0

    def flush(at: int) -> None:
        nonlocal start
        line = s[start:at].replace("\n", "")
        if line:
            lines.append(line)
        start = at

    def ahead(at: int) -> str:
        while at < n and s[at] == "\n":
            at += 1
        return s[at : at + 1]

    def behind(at: int) -> str:
        while at > 0 and s[at - 1] == "\n":
            at -= 1
        return s[at - 1 : at] if at else ""

    nest: list[tuple[int, bool, bool]] = []  # where the bracket closes, whether it is broken, whether it is a block
    closes, broken, block = -1, True, True
    for m in _STRUCTURE.finditer(s):
        c, i = m.group(), m.start()
        if c == "\n":
            # A line feed ends a statement where one can end: at the top or in a block, and in Python outside brackets.
            if python:
                if not nest:
                    flush(i)
            elif block and behind(i) not in _GOES_ON and (x := ahead(i)) not in _CARRIES_ON and x not in glue:
                flush(i)
        elif c in _OPEN:
            nest.append((closes, broken, block))
            closes = partner.get(i, n)
            block = c == "{" and not python and behind(i) not in values
            broken = closes > i + 1 and (block or width[closes] - width[i] > WIDTH)
            if broken:
                flush(i + 1)
        elif i == closes:
            if broken:
                flush(i)
                if block and ahead(i + 1) not in glue:
                    flush(i + 1)
            closes, broken, block = nest.pop()
        elif broken and (c == ";" or c == "," and nest):
            flush(i + 1)
    flush(n)
    return Layout(lines, sum(1 for x in s.split("\n") if x), len(_LITERAL.findall(s)), len(words.findall(s)))
