"""Source files that do not parse: lexers and grammars for the chart parser, and the operator."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.chart import _ANY, Grammar, Language, cost_of, mend, reduce

# --- ECMAScript modules and TypeScript ------------------------------------------------------------------------------

# Words of the languages. Contextual words also serve as names.
_KEYWORDS = "await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let".split()
_LITERALS = ("null", "true", "false")
_CONTEXTUAL = "as async from get of set static".split()
_TS_CONTEXTUAL = "abstract accessor asserts declare global implements infer interface is keyof module namespace out override private protected public readonly require satisfies type unique".split()

# A statement or the body of an arrow function does not begin with an object: X0 to E0 are expressions that do not.
_ECMA = """
Stmts = { Stmt } [ Last ]
Stmt = ';' | Z | Simple End | Ob | if Pe { Z } Stmt [ else Stmt ] | for [ await ] Pf { Z } Stmt | while Pe { Z } Stmt | do { Z } Stmt { Z } while Pe
  | try Ob catch [ Pp ] Ob [ finally Ob ] | try Ob finally Ob | switch Pe Os | n ':' { Z } Stmt | [ export [ default ] ] Func | [ export [ default ] ] Class | TDecl
End = ';' | Z
Simple = E0 | Var | return [ E ] | break [ n ] | continue [ n ] | throw E | debugger | Import | Export | TSimple
Last = Simple | if Pe { Z } Last | if Pe { Z } Stmt else Last | for [ await ] Pf { Z } Last | while Pe { Z } Last | n ':' Last
VarKw = var | let | const
Var = VarKw Decl { ',' Decl }
Decl = Bind TDef TAnn [ '=' A ]
Bind = n | Oo | Ba
Func = [ async ] function [ '*' ] [ n ] TPar Pp TRet Ob
Class = Decos class [ n ] TPar [ extends X ] TImpl Oc
Decos = { '@' X { Z } }
E = A | E ',' A
A = C | U Asg A | Arrow | yield | yield A | yield '*' A
Asg = '=' | assign
Arrow = n arrow Body | Pp TRet arrow Body | async n arrow Body | async Pp TRet arrow Body | TParX Pp TRet arrow Body | async TParX Pp TRet arrow Body
Body = A0 | Ob
C = B | B '?' A ':' A
B = U | B Bop U | h in U | TB
Bop = op | '+' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '|' | '&' | in | instanceof
U = X | X upd | Pre U | TU
Pre = '!' | '+' | upd | typeof | void | delete | await | tilde
X = Prim | X '.' w | X '.' h | X Bi | X Pa | X t | X opt w | X opt h | X opt Bi | X opt Pa | new X | new '.' w | TX
Prim = Oo | Prim0
E0 = A0 | E0 ',' A
A0 = C0 | U0 Asg A | Arrow | yield | yield A | yield '*' A
C0 = B0 | B0 '?' A ':' A
B0 = U0 | B0 Bop U | h in U | TB0
U0 = X0 | X0 upd | Pre U | TU
X0 = Prim0 | X0 '.' w | X0 '.' h | X0 Bi | X0 Pa | X0 t | X0 opt w | X0 opt h | X0 opt Bi | X0 opt Pa | new X | new '.' w | TX0
Prim0 = n | '1' | s | t | r | this | super | lit | Pe | Ba | Func | Class | J | import Pa | import '.' w
ObjElem = w | n '=' A | Key ':' A | dots A | [ async ] [ '*' ] Key TPar Pp TRet Ob | get Key Pp TRet Ob | set Key Pp TRet Ob
Key = w | s | '1' | Bi | h
Objs = [ ObjElem { ',' ObjElem } [ ',' ] ]
Arg = A | dots A
Args = [ Arg { ',' Arg } [ ',' ] ]
ArrPart = [ Arg ]
Arr = [ Arg ] { ',' [ Arg ] }
Param = Decos PMods Bind TOpt TAnn [ '=' A ] | Decos dots Bind TAnn | TThis
Params = [ Param { ',' Param } [ ',' ] ]
ForHead = [ ForInit ] ';' [ E ] ';' [ E ] | VarKw Bind of A | VarKw Bind in E | X of A | X in E
ForInit = Var | E
CMods = { CMod }
CBody = { Member } [ Field ]
Member = ';' | Z | Field End | Decos CMods [ async ] [ '*' ] Key TOpt TPar Pp TRet Ob | Decos CMods get Key Pp TRet Ob | Decos CMods set Key Pp TRet Ob | static Ob | TMember
Field = Decos CMods Key TDef TOpt TAnn [ '=' A ]
SwBody = { Case | Stmt } [ Last ]
Case = case E ':' | default ':'
Import = import s [ with Oo ] | import ImpClause from s [ with Oo ] | TImport
ImpClause = n | '*' as n | Om | n ',' Om | n ',' '*' as n
Export = export Var | export default A | export Om [ from s [ with Oo ] ] | export '*' [ as w ] from s | TExport
ImpElem = w | w as w | s as w | w as s | TImpElem
Imps = [ ImpElem { ',' ImpElem } [ ',' ] ]
"""
_PLAIN_HOOKS = """
TAnn = -
TRet = -
TPar = -
TParX = never
TOpt = -
TDef = -
TImpl = -
TDecl = never
TSimple = never
TB = never
TB0 = never
TU = never
TX = never
TX0 = never
PMods = -
TThis = never
CMod = static
TMember = never
TImport = never
TExport = never
TImpElem = never
Types = never
TupPart = never
Tups = never
Sig = never
IBody = never
EnumElem = never
Enums = never
"""
_TYPED_HOOKS = """
TAnn = - | ':' Type
TRet = - | ':' Type | ':' asserts n [ is Type ] | ':' n is Type | ':' this is Type | ':' asserts this [ is Type ]
TPar = - | TParX
TParX = '<' TP { ',' TP } [ ',' ] '>'
TP = { const | in | out } n [ extends Type ] [ '=' Type ]
TOpt = - | '?'
TDef = - | '!'
TImpl = [ implements TList ]
TPre = { export | declare | default }
TDecl = TPre interface n TPar [ extends TList ] Oi | TPre [ const ] enum n Oe | TPre namespace QN Ob | TPre module s Ob | TPre module QN Ob | declare global Ob | TPre abstract Class | TPre Class
TSimple = TPre type n TPar '=' Type | TPre [ async ] function [ '*' ] [ n ] TPar Pp TRet | declare Var | TPre module s
TB = B as Type | B as const | B satisfies Type
TB0 = B0 as Type | B0 as const | B0 satisfies Type
TU = '<' Type '>' U
TX = X '!' | X TArgs
TX0 = X0 '!' | X0 TArgs
TArgs = '<' TList '>'
TList = Type | TList ',' Type
PMods = { public | private | protected | readonly | override }
TThis = this TAnn
CMod = static | public | private | protected | readonly | override | abstract | declare | accessor
TMember = Decos CMods [ async ] Key TOpt TPar Pp TRet End | CMods Bs TAnn End | Decos CMods get Key Pp TRet End | Decos CMods set Key Pp End
TImport = import type ImpClause from s | import [ type ] n '=' require Pa | import n '=' QN
TExport = export type Om [ from s ] | export type '*' [ as w ] from s | export '=' A | export as namespace n | export import n '=' QN
TImpElem = type w | type w as w
QN = n | QN '.' w
Type = Un | Un extends Un '?' Type ':' Type
Un = [ '|' ] Us
Us = In | Us '|' In
In = [ '&' ] Is
Is = TPost | Is '&' TPost
TPost = keyof TPost | typeof QN [ TArgs ] | typeof import Pa | readonly TPost | unique TPost | infer n [ extends TPost ] | TAtom | FnType
TAtom = QN [ TArgs ] | s | '1' | '+' '1' | t | this | lit | void | Oi | Bt | Pt | import Pa [ '.' QN ] [ TArgs ] | TAtom Bz | TAtom Bt | TAtom Bi
FnType = TPar Pp arrow Type | [ abstract ] new TPar Pp arrow Type | Pp arrow n is Type | Pp arrow asserts n [ is Type ]
Types = Type
TupPart = Tup
Tup = Type | Type '?' | dots Type | w ':' Type | w '?' ':' Type | dots w ':' Type
Tups = [ Tup { ',' Tup } [ ',' ] ]
Sig = n ':' Type | n in Type [ as Type ]
ISep = ';' | ',' | Z
IBody = { IMember ISep | ISep } [ IMember ]
IMember = { readonly } Key TOpt TAnn | Key TOpt TPar Pp TRet | TPar Pp TRet | new TPar Pp TRet | [ '+' ] [ readonly ] Bs [ '+' ] TOpt TAnn | get Key Pp TRet | set Key Pp
EnumElem = Key [ '=' A ]
Enums = [ EnumElem { ',' EnumElem } [ ',' ] ]
"""

_T0 = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
_IN = r"(?:[^`{}'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\{[^{}`]*\}|" + _T0 + ")*"
_T1 = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{" + _IN + r"\})*`"
_IN2 = r"(?:[^`{}'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\{(?:[^{}`]|\{[^{}`]*\})*\}|" + _T1 + ")*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{" + _IN2 + r"\})*`"
_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/"
    r"|\n\s*"
    rf"|\b(?:return|typeof|case|delete|void|throw|await|yield|else|do|in|of)[ \t]*{_REGEX}"
    r"|(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*"
    r"|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\""
    rf"|{_TEMPLATE}"
    r"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])"
    rf"|(?:=>|&&=?|\|\|=?|\?\?=?|[!=]==?|[-+*/%&|^<]=|[(,:=\[!&|?{{;~+\-*%^}}])\s*{_REGEX}"
    r"|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\.\.\.|=>|\+\+|--|\*\*=?|<<=?|>>>=|>>=|[-+*/%&|^]=|#(?:[^\W\d]|\$)[\w$]*|[{}()\[\];,<>+\-*/%&|^!~?:=.@\x01]"
    r"|[^\s]"
)
_OPS = {
    "...": "e", "=>": "a", "?.": "q", "++": "U", "--": "U", "+": "+", "-": "+", "*": "*", "<": "<", ">": ">", "|": "|", "&": "&", "!": "!", "~": "~", "=": "=",
    ";": ";", ",": ",", ".": ".", "?": "?", ":": ":", "@": "@", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "\x01": "J",
} | dict.fromkeys("=== !== == != <= >= && || ?? ** << / % ^".split(), "o") | dict.fromkeys("&&= ||= ??= **= <<= >>= >>>= += -= *= /= %= &= |= ^=".split(), "A")
_NAMES = {"e": "dots", "a": "arrow", "q": "opt", "U": "upd", "o": "op", "A": "assign", "~": "tilde"}


class _Classes(dict):
    """Token -> class character; words are remembered, within bounds."""

    def __init__(self, fixed: dict[str, str], other) -> None:
        super().__init__(fixed)
        self.fixed, self.other = fixed, other

    def __missing__(self, token: str) -> str:
        c = self.other(token)
        if len(token) < 40:
            if len(self) > 300_000:
                self.clear()
                self.update(self.fixed)
            self[token] = c
        return c


@functools.cache
def _script(typed: bool):
    words = [*_KEYWORDS, *_CONTEXTUAL, *(_TS_CONTEXTUAL if typed else [])]
    char = {w: chr(0x100 + i) for i, w in enumerate(words)}
    serves = {char[w]: frozenset({w, "w"} | ({"n"} if w in _CONTEXTUAL or w in _TS_CONTEXTUAL else set())) for w in words}
    serves |= {"L": frozenset({"lit", "w"}), "n": frozenset({"n", "w"}), "1": frozenset({"1"}), "s": frozenset({"s"}), "t": frozenset({"t"}), "r": frozenset({"r"}), "h": frozenset({"h"}), "J": frozenset({"J"}), "Z": frozenset({"Z"})}
    for c in set(_OPS.values()) - set("()[]{}J"):
        serves[c] = frozenset({_NAMES.get(c, c)})
    g = Grammar(_ECMA + (_TYPED_HOOKS if typed else _PLAIN_HOOKS), serves)
    roles = {
        "(": [("Pe", "A", "E", ","), ("Pa", "Arg", "Args", ","), ("Pp", "Param", "Params", ","), ("Pf", "", "ForHead", "")],
        "[": [("Ba", "ArrPart", "Arr", ","), ("Bi", "A", "E", ",")],
        "{": [("Ob", "Stmts", "Stmts", ";Z"), ("Oo", "ObjElem", "Objs", ","), ("Oc", "CBody", "CBody", ";Z"), ("Om", "ImpElem", "Imps", ","), ("Os", "SwBody", "SwBody", ";Z")],
    }
    if typed:
        roles["("] += [("Pt", "", "Types", "")]
        roles["["] += [("Bt", "TupPart", "Tups", ","), ("Bs", "", "Sig", "")]
        roles["{"] += [("Oi", "IBody", "IBody", ";Z"), ("Oe", "EnumElem", "Enums", ",")]
    lang = Language(g, roles, ("Stmts", "Stmts", ";Z"))
    lang.symbols["[", frozenset({"empty"})] = ""
    serves[""] = frozenset({"Bz", "Ba", "Bt"})
    lang.groups["[", ""] = ""

    def other(t: str) -> str:
        c = t[0]
        if c in "'\"":
            return "s" if len(t) > 1 else "X"
        if c == "`":
            return "t" if len(t) > 1 else "X"
        if c == "\n":
            return "\n"
        if c == "/" and t[1:2] in ("/", "*"):
            return "\n" if "\n" in t else ""
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "1" if not re.fullmatch(r"0\d+n?", t) else "X"
        if c == "#":
            return "h" if len(t) > 1 else "X"
        if c.isalpha() or c in "_$\\":
            m = re.match(r"([a-z]+)[ \t]*/", t)
            return (fixed.get(m.group(1), "n") + "r") if m else ("n" if c != "\\" or len(t) > 1 else "X")
        m = re.match(r"([^\s/]+|[-+*/%&|^<]=)\s*/", t) if len(t) > 2 else None
        if m and m.group(1) in _OPS:
            return _OPS[m.group(1)] + "r"
        return "X"

    fixed = char | _OPS | dict.fromkeys(_LITERALS, "L")
    classes = _Classes(fixed, other)
    words_class = "".join(re.escape(c) for c in char.values())
    no_start = "".join(re.escape(char[w]) for w in ("in", "instanceof", "else", "catch", "finally", "extends", "as", *(["satisfies", "implements"] if typed else [])))
    enders = "n1strhJL)\\]}U" + "".join(re.escape(char[w]) for w in ("this", "super", "return", "break", "continue", "debugger", *_CONTEXTUAL, *(_TS_CONTEXTUAL if typed else [])))
    keep = re.compile(rf"(?<=[{enders}])\n+(?=[n1shL@!~UJ{words_class}])(?![\n]*[{no_start}])")
    return lang, classes, keep


_SUBST = re.compile(r"\$\{")


def _script_classes(text: str, typed: bool, jsx: bool) -> tuple[Language, str, list[tuple[float, float]]]:
    """Language, token classes, and (cost, place as a share) of the faults inside templates and JSX braces."""
    lang, classes, keep = _script(typed)
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    extra: list[tuple[float, float]] = []
    if jsx and "<" in text:
        n = len(text)
        text, inner = _cut_jsx(text)
        extra += [(cost, at / n) for x, at in inner if (cost := _inner_fault(x, typed, jsx))]
    tokens = _TOKEN.findall(text)
    s = "".join(map(classes.__getitem__, tokens))
    costs = {t: sum(_inner_fault(x, typed, jsx) for x in _substitutions(t)) for t in set(tokens) if t[0] == "`" and "${" in t}
    if any(costs.values()):
        extra += [(cost, m.start() / len(text)) for m in _TOKEN.finditer(text) if (cost := costs.get(m.group()))]
    s = keep.sub("Z", s).replace("\n", "")
    return lang, s, extra


@functools.lru_cache(maxsize=100_000)
def _inner_fault(x: str, typed: bool, jsx: bool) -> float:
    """What it costs to make the expression inside a template or JSX braces one; 0 if it is."""
    lang, s, inner = _script_classes(x, typed, jsx)
    extra = sum(cost for cost, _ in inner)
    s = s.replace("Z", "")
    if not s:
        return extra
    t, faults = reduce(lang, s)
    if not faults and not _ANY.search(t) and lang.grammar.serves[got := lang.group("(", t)] & {"Pe", "Pa"} and got not in lang.bad:
        return extra
    return extra + max(1, min(mend(lang, s, ("A", "E", ","))[0], mend(lang, s, ("Arg", "Args", ","))[0]))


def _substitutions(t: str) -> list[str]:
    """The expressions inside a template's ``${}``."""
    out, at = [], 0
    while True:
        at = t.find("${", at)
        if at < 0:
            return out
        if at and t[at - 1] == "\\":
            at += 2
            continue
        end = _braces(t, at + 1)
        if end < 0:
            return out
        out.append(t[at + 2 : end - 1])
        at = end


_STRETCH = re.compile(rf"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|{_TEMPLATE}|//[^\n]*|/\*[\s\S]*?\*/|[{{}}]")


def _braces(t: str, at: int) -> int:
    """Where the brace that opens at ``at`` is closed, or -1."""
    depth = 0
    for m in _STRETCH.finditer(t, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


_JSX_START = re.compile(r"(?:[(=,?:&|\[{>;]|\breturn|\bdefault)\s*(<)(?=(?:[A-Za-z_][\w.:-]*(?:\s+(?!extends\b)[\w{/-]|\s*/?>)|>))|//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|" + _TEMPLATE)
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")


def _cut_jsx(text: str) -> tuple[str, list[tuple[str, int]]]:
    """The text with JSX elements replaced by one mark each, and the code inside their braces with its place."""
    out, inner, at = [], [], 0
    pos = 0
    while True:
        m = _JSX_START.search(text, pos)
        if not m:
            break
        if m.group(1) is None:
            pos = m.end()
            continue
        start = m.start(1)
        got: list[str] = []
        end = _element(text, start, got)
        if end < 0:
            pos = m.end()
            continue
        out += [text[at:start], "\x01"]
        inner += [(x, text.find(x, start)) for x in got]
        at = pos = end
    return "".join(out) + text[at:], inner


def _element(t: str, i: int, inner: list[str]) -> int:
    """End of the JSX element or fragment that begins at ``i``, or -1."""
    n = len(t)
    i += 1
    m = _JSX_NAME.match(t, i)
    name = m.group() if m else ""
    i = m.end() if m else i
    while name:
        while i < n and t[i].isspace():
            i += 1
        if t.startswith("/>", i):
            return i + 2
        if t.startswith(">", i):
            break
        if t.startswith("{", i):
            e = _braces(t, i)
            if e < 0:
                return -1
            inner.append(t[i + 1 : e - 1].strip().removeprefix("..."))
            i = e
            continue
        m = _JSX_NAME.match(t, i)
        if not m:
            return -1
        i = m.end()
        e = re.compile(r"\s*=\s*").match(t, i)
        if e:
            i = e.end()
            if t[i : i + 1] in ("'", '"'):
                i = t.find(t[i], i + 1) + 1
                if i == 0:
                    return -1
            elif t[i : i + 1] == "{":
                e2 = _braces(t, i)
                if e2 < 0:
                    return -1
                inner.append(t[i + 1 : e2 - 1])
                i = e2
            elif t[i : i + 1] == "<":
                i = _element(t, i, inner)
                if i < 0:
                    return -1
            else:
                return -1
    if not t.startswith(">", i):
        return -1
    i += 1
    while i < n:
        c = t[i]
        if c == "{":
            e = _braces(t, i)
            if e < 0:
                return -1
            x = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", t[i + 1 : e - 1]).strip()
            if x:
                inner.append(x.removeprefix("..."))
            i = e
        elif c == "<":
            if t.startswith("</", i):
                m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(t, i)
                return m.end() if m and m.group(1) == name else -1
            i = _element(t, i, inner)
            if i < 0:
                return -1
        elif c in ">}":
            return -1
        else:
            i += 1
    return -1


# --- Python ---------------------------------------------------------------------------------------------------------

_PY_KEYWORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_PY_SOFT = ("match", "case", "type")
_PY_GRAMMAR = """
Line = Simple { ';' Simple } [ ';' ] | Head
Head = if Named ':' Rest | elif Named ':' Rest | else ':' Rest | while Named ':' Rest | [ async ] for Exprs in Exprs ':' Rest | try ':' Rest | except [ '*' ] [ Exprs [ as n ] ] ':' Rest
  | finally ':' Rest | [ async ] with With ':' Rest | [ async ] def n [ Bl ] Pd [ ret T ] ':' Rest | class n [ Bl ] [ Pc ] ':' Rest | match Exprs ':' | case Pattern [ if Named ] ':' Rest | '@' Named
Rest = [ Simple { ';' Simple } [ ';' ] ]
With = WItem { ',' WItem } | Pw
WItem = T [ as Target ]
Target = Post | Pt | Bl | '*' Target
Simple = pass | break | continue | return [ Exprs ] | raise [ T [ from T ] ] | global Ns | nonlocal Ns | del Exprs | assert T [ ',' T ] | import Mods | from Rel import ImpNames | type n [ Bl ] '=' T
  | Exprs | Yield | Assign | Post ':' T [ '=' Val ] | Post assign Val
Assign = Exprs '=' Val | Exprs '=' Assign
Val = Exprs | Yield
Yield = yield [ Exprs ] | yield from T
Ns = n { ',' n }
Dotted = n | Dotted '.' n
Mods = Dotted [ as n ] { ',' Dotted [ as n ] }
Rel = Dotted | Dots | Dots Dotted
Dots = '.' | ell | Dots '.' | Dots ell
ImpNames = '*' | ImpName { ',' ImpName } | Pi
ImpName = n [ as n ]
Imps = ImpName { ',' ImpName } [ ',' ]
Exprs = Elem { ',' Elem } [ ',' ]
Elem = Named | '*' B
Named = T | n walrus T
T = B | B if B else T | lambda [ LParams ] ':' T
LParams = LP { ',' LP } [ ',' ]
LP = n [ '=' T ] | '*' [ n ] | pow n | op
B = U | B Bop U
Bop = op | '+' | '*' | pow | '@' | '|' | and | or | in | not in | is | is not
U = not U | '+' U | tilde U | await U | Post
Post = Atom | Post '.' n | Post Pc | Post Bl | Post Bs
Atom = n | '1' | Strs | Pt | Bl | Od | lit | ell
Strs = s | Strs s
Comp = For { For | if B2 }
For = [ async ] for Exprs in B2
B2 = T | n walrus T
Paren = [ Exprs ] | Yield | Elem Comp
List = [ Exprs ] | Elem Comp
Slices = Slice { ',' Slice } [ ',' ]
Slice = Elem | [ T ] ':' [ T ] [ ':' [ T ] ]
Pair = T ':' T | pow B
Dict = [ Pair { ',' Pair } [ ',' ] ] | T ':' T Comp | Exprs | Elem Comp
DictPart = Pair | Elem
Arg = Named | n '=' T | '*' T | pow T
Args = [ Arg { ',' Arg } [ ',' ] ] | Named Comp
Param = n [ ':' T ] [ '=' T ] | '*' [ n [ ':' T ] ] | '*' n ':' '*' T | pow n [ ':' T ] | op
Params = [ Param { ',' Param } [ ',' ] ]
Withs = WItem { ',' WItem } [ ',' ]
Pattern = PAs { ',' PAs } [ ',' ]
PAs = POr [ as n ]
POr = PAtom | POr '|' PAtom
PAtom = '*' n | Post | '+' '1' | PAtom '+' '1'
PyTop = Line
"""
_PY_TOKEN = re.compile(
    r"[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?''')"
    r"|[rRbBuUfFtT]{0,2}(?:'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")"
    r"|\\\r?\n"
    r"|\n[ \t\f\r]*"
    r"|#[^\n]*"
    r"|[^\W\d]\w*"
    r"|(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^]=|==|!=|<=|>=|\*\*|//|<<|>>|[{}()\[\];,<>+\-*/%&|^~:=.@]"
    r"|\S"
)
_PY_OPS = {
    "...": "E", "->": "a", ":=": "W", "**": "p", "*": "*", "+": "+", "-": "+", "~": "~", "@": "@", "|": "|", ":": ":", ",": ",", ".": ".", ";": ";", "=": "=",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
} | dict.fromkeys("== != <= >= < > // / % & ^ << >>".split(), "o") | dict.fromkeys("**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split(), "A")
_PY_NAMES = {"E": "ell", "a": "ret", "W": "walrus", "p": "pow", "~": "tilde", "o": "op", "A": "assign"}


@functools.cache
def _python():
    words = [*_PY_KEYWORDS, *_PY_SOFT]
    char = {w: chr(0x100 + i) for i, w in enumerate(words)}
    serves = {char[w]: frozenset({w} | ({"n"} if w in _PY_SOFT else set())) for w in words}
    serves |= {"n": frozenset({"n"}), "1": frozenset({"1"}), "s": frozenset({"s"}), "L": frozenset({"lit"})}
    for c in set(_PY_OPS.values()) - set("()[]{}"):
        serves[c] = frozenset({_PY_NAMES.get(c, c)})
    g = Grammar(_PY_GRAMMAR, serves)
    roles = {
        "(": [("Pt", "Elem", "Paren", ","), ("Pc", "Arg", "Args", ","), ("Pd", "Param", "Params", ","), ("Pi", "", "Imps", ""), ("Pw", "", "Withs", "")],
        "[": [("Bl", "Elem", "List", ","), ("Bs", "Slice", "Slices", ",")],
        "{": [("Od", "DictPart", "Dict", ",")],
    }
    lang = Language(g, roles, ("", "PyTop", ""))

    def other(t: str) -> str:
        c = t[0]
        if c == "\n":
            return "\n"
        if c == "#" or (c == "\\" and len(t) > 1):
            return ""
        if t[-1] in "'\"" and len(t) > 1:
            return "s"
        if c.isdigit() or (c == "." and len(t) > 1):
            return "1" if not re.fullmatch(r"0[\d_]*[1-9][\d_]*", t) else "X"
        return "n" if c == "_" or c.isalpha() else "X"

    return lang, _Classes(char | _PY_OPS | dict.fromkeys(("None", "True", "False"), "L"), other), char


_PY_MARK = re.compile(r"[()\[\]{}\n]")
_AFTER = {"elif": ("if", "elif"), "except": ("try", "except"), "finally": ("try", "except", "else"), "else": ("if", "elif", "for", "while", "try", "except")}


def _loose(s: str) -> list[int]:
    """Where the brackets without partner are."""
    stack: list[int] = []
    out = []
    for m in _ANY.finditer(s):
        if m.group() in "([{":
            stack.append(m.start())
        elif stack and s[stack[-1]] + m.group() in ("()", "[]", "{}"):
            stack.pop()
        else:
            out.append(m.start())
    return sorted(out + stack)


def _python_lines(text: str, tokens: list[str], cs: list[str], cut: set[int]) -> list[tuple[str, int]]:
    """Logical lines and their indents; the line ends in ``cut`` end one whatever is open."""
    lines: list[tuple[str, int]] = []
    depth, now, width = 0, [], 0
    head = re.match(r"[ \t\f]*", text)
    width = len(head.group().expandtabs())
    for i, (t, c) in enumerate(zip(tokens, cs, strict=True)):
        if c == "\n":
            if depth <= 0 or i in cut:
                if now:
                    lines.append(("".join(now), width))
                    now = []
                width = len(t[1:].replace("\r", "").expandtabs())
                depth = 0
        elif c:
            depth += (c in "([{") - (c in ")]}")
            now.append(c)
    if now:
        lines.append(("".join(now), width))
    return lines


def _python_cost(text: str) -> tuple[int, list[float]]:
    if text.startswith("﻿") or "\x00" in text:
        return 1, [0.0]
    lang, classes, char = _python()
    tokens = [t for t in _PY_TOKEN.findall(text)]
    cs = list(map(classes.__getitem__, tokens))
    lines = _python_lines(text, tokens, cs, set())
    cut: set[int] = set()
    while lines:
        # An opener without partner swallows what follows; where that is no line even with the partner at its end, the line ends with its own row.
        openers = [x for x in _loose(lines[-1][0]) if lines[-1][0][x] in "([{"]
        if not openers or mend(lang, lines[-1][0], ("", "Line", ""))[0] <= len(openers):
            break
        nth = sum(len(s) for s, _ in lines[:-1]) + openers[0]
        at = next(i for i, n in enumerate(accumulate(len(c) for c in cs if c != "\n")) if n > nth)
        at = [i for i, c in enumerate(cs) if c != "\n"][at]
        row = next((i for i in range(at, len(cs)) if cs[i] == "\n"), None)
        if row is None:
            break
        cut.add(row)
        lines = _python_lines(text, tokens, cs, cut)
    cost, places = 0, []
    start, total = 0, max(1, sum(len(s) for s, _ in lines))
    stack, opened = [0], False
    last: dict[int, str] = {}
    back = {v: k for k, v in char.items()}
    for no, (s, width) in enumerate(lines):
        r, faults = reduce(lang, s)
        bad, edits = 0, []
        if faults or _ANY.search(r) or not lang.grammar.ok("Line", r):
            bad, edits = mend(lang, s, ("", "Line", ""))
            r = _ANY.sub("", r)
        word = back.get(r[:1], "")
        if word == "async":
            word = back.get(r[1:2], "")
        if opened and width <= stack[-1]:
            bad += 1
        elif not opened and width > stack[-1]:
            bad += 1
        if width > stack[-1]:
            stack.append(width)
            last.pop(width, None)
        else:
            while width < stack[-1]:
                last.pop(stack.pop(), None)
            if width != stack[-1]:
                bad += 1
        if word in _AFTER and "J" not in r and last.get(width) not in _AFTER[word] and r[-1:] == ":":
            bad += 1
        if no and lines[no - 1][0][:1] == "@" and r[:1] != "@" and word not in ("def", "class"):
            bad += 1
        last[width] = word
        opened = r[-1:] == ":" and not bad and lang.grammar.ok("Head", r) or (r[-1:] == ":" and bool(bad))
        if bad:
            cost += bad
            places += [(start + x) / total for x in edits or [0]]
        start += len(s)
    if opened:
        cost += 1
        places.append(1.0)
    return cost, places


# --- JSON -----------------------------------------------------------------------------------------------------------

_JSON_TOKEN = re.compile(
    r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w)|[{}\[\]:,]|[^ \t\r\n]"
)


@functools.cache
def _json():
    serves = {c: frozenset({c}) for c in ":,"} | {"s": frozenset({"s"}), "v": frozenset({"v"})}
    g = Grammar("V = s | v | Or | Ar\nPair = s ':' V\nPairs = [ Pair { ',' Pair } ]\nVs = [ V { ',' V } ]", serves)
    roles = {"{": [("Or", "Pair", "Pairs", ",")], "[": [("Ar", "V", "Vs", ",")], "(": [("Pr", "", "V", "")]}
    lang = Language(g, roles, ("", "V", ""))

    def other(t: str) -> str:
        if t[0] == '"' and len(t) > 1:
            return "s"
        return "v" if len(t) > 1 or t.isdigit() and t.isascii() else "X"

    return lang, _Classes({c: c for c in "{}[]:,"}, other)


# --- The operator ---------------------------------------------------------------------------------------------------

SUFFIX = re.compile(r"\.(ts|tsx|js|mjs|py|json)$")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)", re.M)


def check(text: str, suffix: str) -> tuple[float, list[float]]:
    """(repair cost, places of the edits) of a text in the language of ``suffix``; cost 0 means it is valid, an infinite one is unknown."""
    if suffix == "py":
        return _python_cost(text)
    if suffix == "json":
        lang, classes = _json()
        if text.startswith("﻿"):
            return 1, [0.0]
        return cost_of(lang, "".join(map(classes.__getitem__, _JSON_TOKEN.findall(text))))
    lang, s, extra = _script_classes(text, suffix in ("ts", "tsx"), suffix == "tsx")
    cost, places = cost_of(lang, s)
    return cost + sum(n for n, _ in extra), places + [x for _, x in extra]


def cause(text: str, cost: float, places: list[float]) -> str:
    """What the places of the edits say: ``conflict``, ``truncated``, ``mismatch`` or ``local``."""
    marks = [m.start() / len(text) for m in _CONFLICT.finditer(text)]
    if any(abs(x - m) <= 0.1 for m in marks for x in places):  # edits where the marks stand
        return "conflict"
    if places and min(places) >= 0.97:
        return "truncated"
    if len(places) >= 3 and max(places) - min(places) > 0.4 and cost >= 4:
        return "mismatch"
    return "local"


def unparsable(df: DataFrame, id_col: str = "paste_id", path_col: str = "path", text_col: str = "content", repo_col: str = "repo") -> DataFrame:
    """Whether each source text is valid in the language its path names.

    One row per row with non-empty text whose path ends in ts, tsx, js, mjs, py or json:
    ``paste_id``, ``repo``, ``language``, ``valid``, ``cost`` (tokens to edit; 0 if
    valid, null if no repair was found), ``cause`` (null if valid) and ``place`` (first
    edit, as a share of the text's tokens).
    The stored extension is not used. Null and empty texts, null paths and other
    languages give no row; repeated rows are checked each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, repo, path, text in b.itertuples(index=False):
                suffix = SUFFIX.search(path).group(1)
                cost, places = check(text, suffix)
                rows.append((i, repo, suffix, cost == 0, int(cost) if cost < math.inf else None, cause(text, cost, places) if cost else None, min(places) if places else None))
            yield pd.DataFrame(rows, columns=["paste_id", "repo", "language", "valid", "cost", "cause", "place"]).astype({"cost": "Int64"})

    src = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(repo_col).alias("repo"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    src = src.where(F.col("path").rlike(SUFFIX.pattern) & F.col("text").isNotNull() & (F.col("text") != ""))
    return src.mapInPandas(run, "paste_id bigint, repo string, language string, valid boolean, cost bigint, cause string, place double")


def invalid_rates(checked: DataFrame) -> DataFrame:
    """``n_files``, ``n_invalid`` and ``rate`` per ``repo`` and ``language`` (null repos form a group)."""
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.avg((~F.col("valid")).cast("int")).alias("rate")
    )
