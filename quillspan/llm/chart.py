"""Chart parsing with error correction over strings of token classes.

A text is lexed into one character per token. Brackets are reduced from the inside: the
body of each innermost pair is parsed under every role such a pair can have (block,
object, arguments, ...) and replaced by one character that stands for the roles it can
fill. Equal bodies are parsed once and remembered, so a corpus costs little more than its
lexing. Lists and statement sequences are parsed part by part; where a part fails, the
whole body is parsed, so that splitting never decides.

A body that fills no role is repaired whole, under each role its surroundings take: where
no reading goes on, each token that could stand there is inserted or exchanged, or the next
one deleted (a bracket pair with all its tokens), and what lets most of the body be read is
kept. A bracket without partner is closed at the end or deleted. The cost is the number of
tokens edited, an upper bound of the least one; cost 1 is the least.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property


# (offset, roles, limit) -> (cost, character, places of the edits) for each of the roles that the pair at the offset can take below the limit
Inner = Callable[[int, set[str], float], list[tuple[float, str, list[int]]]]
_MOST, _ENTRY = 48_000_000, 100  # what a memory of parsed bodies may hold in characters, and what an entry takes besides
_ANYTHING = "\uffff"  # in front of it nothing is ruled out


class Grammar:
    """Rules as text: ``name = alt | alt``; quoted or unknown words are terminals, ``[x]`` is optional, ``{x}`` repeated."""

    def __init__(self, text: str, serves: dict[str, frozenset[str]]) -> None:
        self.serves = serves  # character -> terminals it can stand for
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.names: set[str] = set()
        self.extra = 0
        parsed: list[tuple[str, str]] = []
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if line.strip() and not line.lstrip().startswith("#"):
                name, _, body = line.partition(" = ")
                parsed.append((name.strip(), body))
                self.names.add(name.strip())
        for name, body in parsed:
            for alt in self._split(body.split(), "|"):
                self.rules.append((name, self._expand(alt)))
        self.by: dict[str, list[int]] = {}
        for i, (n, _) in enumerate(self.rules):
            self.by.setdefault(n, []).append(i)
        self.start: list[int] = []
        self.sym: list[str | None] = []
        self.lhs: list[str] = []
        for n, rhs in self.rules:
            self.start.append(len(self.sym))
            for s in (*rhs, None):
                self.sym.append(s)
                self.lhs.append(n)
        self.nullable: set[str] = set()
        while True:
            more = {n for n, rhs in self.rules if all(s in self.nullable for s in rhs)} - self.nullable
            if not more:
                break
            self.nullable |= more
        first: dict[str, set[str]] = {n: set() for n in self.by}
        changed = True
        while changed:
            changed = False
            for n, rhs in self.rules:
                got = self._first(rhs, first)
                if not got <= first[n]:
                    first[n] |= got
                    changed = True
        self.rule_first = [frozenset(self._first(rhs, first)) for _, rhs in self.rules]
        self.rule_null = [all(s in self.nullable for s in rhs) for _, rhs in self.rules]
        self.pairs: dict[str, str] = {}  # role terminal -> what its bracket pair holds
        self.predicted: dict[tuple[str, str], list[int]] = {}
        self.memo: dict[tuple[str, str], bool] = {}
        self.held = 0

    def _first(self, rhs: tuple[str, ...], first: dict[str, set[str]]) -> set[str]:
        out: set[str] = set()
        for s in rhs:
            out |= first[s] if s in first else {s}
            if s not in self.nullable:
                break
        return out

    @staticmethod
    def _split(words: list[str], sep: str) -> list[list[str]]:
        out: list[list[str]] = [[]]
        depth = 0
        for w in words:
            depth += (w in ("[", "{")) - (w in ("]", "}"))
            if w == sep and depth == 0:
                out.append([])
            else:
                out[-1].append(w)
        return out

    def _expand(self, words: list[str]) -> tuple[str, ...]:
        out: list[str] = []
        i = 0
        while i < len(words):
            w = words[i]
            if w in ("[", "{"):
                depth, j = 1, i
                while depth:
                    j += 1
                    depth += (words[j] in ("[", "{")) - (words[j] in ("]", "}"))
                self.extra += 1
                name = f"_{self.extra}"
                self.names.add(name)
                self.rules.append((name, ()))
                for alt in self._split(words[i + 1 : j], "|"):
                    rhs = self._expand(alt)
                    self.rules.append((name, (name, *rhs) if w == "{" else rhs))
                out.append(name)
                i = j
            elif w != "-":
                out.append(w.strip("'") if w not in self.names else w)
            i += 1
        return tuple(out)

    def _predict(self, nt: str, c: str) -> list[int]:
        got = self.predicted.get((nt, c))
        if got is None:
            s = self.serves.get(c, frozenset())
            got = self.predicted[nt, c] = [self.start[r] for r in self.by[nt] if c == _ANYTHING or self.rule_null[r] or not self.rule_first[r].isdisjoint(s)]
        return got

    def parse(self, start: str, s: str) -> tuple[int, set[str]]:
        """(-1, {}) if ``s`` can be read as ``start``, else where no reading goes on and what could stand there."""
        at, expected, _ = self._parse(start, s, [], [])
        return at, expected

    def _parse(self, start: str, s: str, waiting: list[dict[str, list[tuple[int, int]]]], kernel: list[tuple[int, int]], ends: list[int] | None = None, head: str = "", skip: int = 0) -> tuple[int, set[str], list[tuple[int, int]]]:
        """As ``parse``, from the columns in ``waiting`` and the items ``kernel`` after them on; returns the items at the end, too.

        ``ends`` takes the places up to which ``s`` is a ``start``. What is read is ``head``,
        at most one character, and then ``s`` from ``skip`` on.
        """
        sym, lhs, nullable, by = self.sym, self.lhs, self.nullable, self.by
        begin = len(waiting)
        shift = skip - begin - len(head)
        n = len(s) - shift
        current = list(kernel) if waiting else [(x, 0) for x in self._predict(start, head or s[skip : skip + 1])]
        for i in range(begin, n + 1):
            kept = len(current)
            c = head if i == begin and head else s[i + shift] if i < n else ""
            serve = self.serves.get(c, frozenset())
            seen = set(current)
            wait: dict[str, list[tuple[int, int]]] = {}
            waiting.append(wait)
            after: list[tuple[int, int]] = []
            done = set()
            k = 0
            ended = False
            while k < len(current):
                st, o = item = current[k]
                k += 1
                x = sym[st]
                if x is None:
                    name = lhs[st]
                    if name == start and o == 0:
                        ended = True
                    done.add((name, o))
                    for p in waiting[o].get(name, ()):
                        q = (p[0] + 1, p[1])
                        if q not in seen:
                            seen.add(q)
                            current.append(q)
                elif x in by:
                    w = wait.get(x)
                    if w is None:
                        wait[x] = [item]
                        for y in self._predict(x, c):
                            q = (y, i)
                            if q not in seen:
                                seen.add(q)
                                current.append(q)
                    else:
                        w.append(item)
                    if x in nullable or (x, i) in done:
                        q = (st + 1, o)
                        if q not in seen:
                            seen.add(q)
                            current.append(q)
                elif x in serve:
                    after.append((st + 1, o))
            if ended and ends is not None:
                ends.append(i)
            if i == n:
                return (-1, set(), []) if ended else (n, {sym[st] for st, _ in current if sym[st] is not None and sym[st] not in by}, current[:kept])
            if not after:
                expected = {sym[st] for st, _ in current if sym[st] is not None and sym[st] not in by}
                return i, expected, current[:kept]
            current = list(dict.fromkeys(after))
        return -1, set(), []

    def _column(self, start: str, waiting: list[dict[str, list[tuple[int, int]]]], kernel: list[tuple[int, int]]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
        """The whole column behind those in ``waiting``, whatever comes next: what waits in it, and the items each terminal leads to."""
        sym, lhs, nullable, by = self.sym, self.lhs, self.nullable, self.by
        i = len(waiting)
        current = list(kernel) if waiting else [(x, 0) for x in self._predict(start, _ANYTHING)]
        seen, done = set(current), set()
        wait: dict[str, list[tuple[int, int]]] = {}
        shifts: dict[str, list[tuple[int, int]]] = {}
        waiting.append(wait)
        k = 0
        while k < len(current):
            st, o = item = current[k]
            k += 1
            x = sym[st]
            more: list[tuple[int, int]] = []
            if x is None:
                name = lhs[st]
                done.add((name, o))
                more = [(a + 1, b) for a, b in waiting[o].get(name, ())]
            elif x in by:
                if x in wait:
                    wait[x].append(item)
                else:
                    wait[x] = [item]
                    more = [(y, i) for y in self._predict(x, _ANYTHING)]
                if x in nullable or (x, i) in done:
                    more.append((st + 1, o))
            else:
                shifts.setdefault(x, []).append((st + 1, o))
            for q in more:
                if q not in seen:
                    seen.add(q)
                    current.append(q)
        waiting.pop()
        return wait, shifts

    def ok(self, start: str, s: str) -> bool:
        key = (start, s)
        got = self.memo.get(key)
        if got is None:
            self.held += len(s) + _ENTRY
            if self.held > _MOST:
                self.memo.clear()
                self.held = len(s)
            got = self.memo[key] = self.parse(start, s)[0] < 0
        return got

    @cached_property
    def stands_for(self) -> dict[str, str]:
        """Terminal -> a single token for it; bracket pairs are none."""
        return {t: c for c, ts in sorted(self.serves.items(), reverse=True) if c < "\ue000" for t in ts}

    @cached_property
    def least(self) -> dict[str, float]:
        """The fewest tokens that make up a symbol."""
        out: dict[str, float] = dict.fromkeys(self.stands_for, 1)
        changed = True
        while changed:
            changed = False
            for name, rhs in [*self.rules, *((r, (x,)) for r, x in self.pairs.items())]:
                n = sum(out.get(x, math.inf) for x in rhs) + 2 * (name in self.pairs)
                if n < out.get(name, math.inf):
                    out[name], changed = n, True
        return out

    def _finish(self, start: str, waiting: list[dict[str, list[tuple[int, int]]]], kernel: list[tuple[int, int]]) -> float:
        """The fewest tokens to append where the text ends too early."""
        if not waiting:
            return self.least.get(start, math.inf)

        def rest(st: int) -> float:
            n = 0.0
            while (x := self.sym[st]) is not None:
                n += self.least.get(x, math.inf)
                st += 1
            return n

        heap = [(rest(st), self.lhs[st], o) for st, o in kernel]
        heapq.heapify(heap)
        done = set()
        while heap:
            n, name, o = heapq.heappop(heap)
            if (name, o) == (start, 0):
                return n
            if n < math.inf and (name, o) not in done:
                done.add((name, o))
                for st, origin in waiting[o].get(name, ()):
                    heapq.heappush(heap, (n + rest(st + 1), self.lhs[st], origin))
        return math.inf

    def repair(self, start: str, s: str, offsets: list[int] | None = None, most: float = math.inf, inner: Inner | None = None) -> tuple[float, list[int]]:
        """(cost, places of the edits) to make ``s`` a ``start``; infinite from ``most`` on.

        ``offsets``: where the tokens of each character begin, and where the last ends.
        ``inner``: what it costs to give the bracket pair at an offset another role.
        """
        offsets = offsets or list(range(len(s) + 1))
        cost, places = 0.0, []
        waiting: list[dict[str, list[tuple[int, int]]]] = []
        kernel: list[tuple[int, int]] = []
        head, skip = "", 0
        while True:
            begin = len(waiting) + len(head)
            at, _, kernel = self._parse(start, s, waiting, kernel, None, head, skip)
            if at < 0:
                return cost, places
            del waiting[at:]
            if cost + 1 >= most:
                return math.inf, places
            skip += at - begin
            here, left = offsets[skip], offsets[-1] - offsets[skip]
            wait, shifts = self._column(start, waiting, kernel)
            expected = set(shifts)
            tokens = sorted({self.stands_for[x] for x in expected if x in self.stands_for})
            tries: list[tuple[float, str, int, list[int]]] = [(1, c, skip, [here]) for c in tokens]
            if skip < len(s):
                size = offsets[skip + 1] - here
                tries += [(size, c, skip + 1, [here]) for c in ("", *tokens)]
                if inner is not None:
                    tries += [(n, c, skip + 1, edits) for n, c, edits in inner(here, expected, size)]
            best: tuple[float, float] = (math.inf, 0)
            chosen, solved, where = None, math.inf, []
            for price, head, after, edits in sorted(tries, key=lambda x: x[0]):
                if price >= solved:
                    break
                if head:  # what it leads to is known from the column already
                    waiting.append(wait)
                    got = self._parse(start, s, waiting, list(dict.fromkeys(x for t in self.serves[head] for x in shifts.get(t, ()))), None, "", after)[0]
                else:
                    got = self._parse(start, s, waiting, kernel, None, "", after)[0]
                del waiting[at:]
                if got < 0:
                    solved, where = price, edits
                    continue
                unread = offsets[-1] - offsets[after + got - at - len(head)]
                if unread < left and (unread + price, price) < best:
                    best, chosen = (unread + price, price), (price, head, after, edits)
            if skip == len(s):
                more = min(solved, self._finish(start, waiting, kernel))
                return (cost + more, places + [here] * int(more)) if cost + more < most else (math.inf, places)
            if solved < math.inf:
                return (cost + solved, places + where) if cost + solved < most else (math.inf, places)
            price, head, skip, edits = chosen
            cost += price
            places += edits


@dataclass
class Language:
    """How to lex and parse one language.

    ``roles``: bracket -> list of (role terminal, part symbol or "", whole symbol, separators).
    """

    grammar: Grammar
    roles: dict[str, list[tuple[str, str, str, str]]]
    top: tuple[str, str, str]  # part, whole, separators
    groups: dict[tuple[str, str], str] = field(default_factory=dict)
    symbols: dict[tuple[str, frozenset[str]], str] = field(default_factory=dict)
    bad: set[str] = field(default_factory=set)
    held: int = 0

    def __post_init__(self) -> None:
        self.grammar.pairs |= {r: whole for roles in self.roles.values() for r, _, whole, _ in roles}

    def fits(self, body: str, part: str, whole: str, seps: str) -> bool:
        g = self.grammar
        if seps == "," and body and part != "ArrPart":
            if ",," in body or body[0] == ",":
                return False
            if part in _NO_TRAILING and body[-1] == ",":
                return False
            if body[-1] == "," and part and len(body) > 1 and all(g.ok(part, p) for p in set(body[:-1].split(","))):
                return True
        if part and body:
            if len(seps) > 1:
                parts = {x for x in re.split(f"(?<=[{seps}])", body) if x}
            else:
                parts = set(body.split(seps))
            if all(g.ok(part, p) for p in parts):
                return True
        return g.ok(whole, body)

    def group(self, bracket: str, body: str) -> str:
        """The character for a bracket pair with this body."""
        key = (bracket, body)
        got = self.groups.get(key)
        if got is None:
            can = frozenset(r for r, part, whole, seps in self.roles[bracket] if self.fits(body, part, whole, seps))
            self.held += len(body) + _ENTRY
            if self.held > _MOST:
                self.groups.clear()
                self.held = len(body)
            if can:
                got = self.symbol(bracket, can)
            else:  # goes on as if it could be anything; the fault is counted where it stands
                got = chr(ord(self.symbol(bracket, frozenset(r for r, *_ in self.roles[bracket]))) + 0x800)
                self.grammar.serves[got] = frozenset(r for r, *_ in self.roles[bracket])
                self.bad.add(got)
            self.groups[key] = got
        return got

    def symbol(self, bracket: str, can: frozenset[str]) -> str:
        got = self.symbols.get((bracket, can))
        if got is None:
            got = self.symbols[bracket, can] = chr(0xE000 + len(self.symbols))
            self.grammar.serves[got] = can
        return got


# Lists that may not end in their separator: sequence expressions, JSON, and slices and Python lists parse it themselves.
_NO_TRAILING = frozenset({"A", "V", "Pair"})
_ANY = re.compile(r"[(){}\[\]]")


_CLOSER = {"(": ")", "[": "]", "{": "}"}


def reduce(lang: Language, s: str) -> tuple[str, int]:
    """``s`` with its bracket pairs replaced by group characters, and how many pairs hold a fault.

    Brackets without partner stay; one that is closed by another's closer is left inside it
    and makes that pair faulty.
    """
    faults, at = 0, 0
    group, bad = lang.group, lang.bad
    opened = dict.fromkeys(")]}", 0)
    stack: list[tuple[str, list[str]]] = []
    now: list[str] = []
    for m in _ANY.finditer(s):
        i = m.start()
        if i > at:
            now.append(s[at:i])
        at = i + 1
        c = s[i]
        if c in _CLOSER:
            stack.append((c, now))
            opened[_CLOSER[c]] += 1
            now = []
            continue
        if not opened[c]:
            now.append(c)
            continue
        while _CLOSER[stack[-1][0]] != c:
            o, before = stack.pop()
            opened[_CLOSER[o]] -= 1
            now = [*before, o, *now]
        o, before = stack.pop()
        opened[c] -= 1
        g = group(o, "".join(now))
        faults += g in bad
        now = before
        now.append(g)
    now.append(s[at:])
    while stack:
        o, before = stack.pop()
        before.append(o)
        before += now
        now = before
    return "".join(now), faults


class _Pairs(dict[int, tuple[str, str, list[int]]]):
    """Offset of a bracket pair -> its bracket, its body and the offsets of that."""

    def __init__(self, lang: Language) -> None:
        super().__init__()
        self.lang = lang
        self.known: dict[tuple[int, str], tuple[float, list[int]]] = {}

    def mended(self, at: int, role: str, most: float) -> tuple[float, list[int]]:
        got = self.known.get((at, role))
        if got is None:
            bracket, body, offsets = self[at]
            whole = next(w for r, _, w, _ in self.lang.roles[bracket] if r == role)
            got = self.lang.grammar.repair(whole, body, offsets, most, self.inner)
            if got[0] < math.inf:
                self.known[at, role] = got
        return got

    def inner(self, at: int, roles: set[str], most: float) -> list[tuple[float, str, list[int]]]:
        if at not in self:
            return []
        out = []
        for role, *_ in self.lang.roles[self[at][0]]:
            if role in roles:
                n, edits = self.mended(at, role, most)
                if n < most:
                    out.append((n, self.lang.symbol(self[at][0], frozenset({role})), edits))
        return out


def _settle(lang: Language, body: str, offsets: list[int], pairs: _Pairs, spans: list[tuple[str, str, str]]) -> tuple[str, float, list[int]]:
    """``body`` with its faulty pairs in the role that repairs them at least cost, and what these repairs cost where.

    ``spans``: (part, whole, separators) of the roles of the body itself.
    """
    cost, places = 0.0, []
    for k, c in enumerate(body):
        if c not in lang.bad:
            continue
        bracket, inside, _ = pairs[offsets[k]]
        roles = lang.roles[bracket]
        reach: dict[str, float] = {}
        for alone in (True, False):  # the part it stands in decides, or the whole body
            reach = {role: 0 for role, *_ in roles}
            for part, whole, seps in spans:
                before, after = 0, len(body)
                if alone and part:
                    before = max(body.rfind(x, 0, k) for x in seps) + 1
                    after = min((x for x in (body.find(x, k) for x in seps) if x >= 0), default=after - (len(seps) > 1)) + (len(seps) > 1)
                for role in reach:
                    got = lang.grammar.parse(part if alone and part else whole, body[before:k] + lang.symbol(bracket, frozenset({role})) + body[k + 1 : after])[0]
                    reach[role] = max(reach[role], math.inf if got < 0 else before + got)
            far = max(reach.values())
            if far > k:
                break
        best, edits, chosen = math.inf, [], roles[0][0]
        fits = [(lang.grammar.parse(whole, inside)[0], role) for role, _, whole, _ in roles if reach[role] == far]
        for _, role in sorted(fits, key=lambda x: (x[0] >= 0, -x[0])):
            n, at = pairs.mended(offsets[k], role, best)
            if n < best:
                best, edits, chosen = n, at, role
        cost += best
        places += edits
        if far > k:  # else nothing says which role it has, and it goes on as any
            body = body[:k] + lang.symbol(bracket, frozenset({chosen})) + body[k + 1 :]
    return body, cost, places


def _partner(lang: Language, t: str, k: int, top: tuple[str, str, str]) -> int:
    """Where the partner of the opener at ``k`` makes ``t`` valid, or -1; the end is tried first."""
    found: dict[int, set[str]] = {}
    for role, _, whole, _ in lang.roles[t[k]]:
        ends: list[int] = []
        lang.grammar._parse(whole, t[k + 1 :], [], [], ends)
        for x in ends:
            found.setdefault(k + 1 + x, set()).add(role)
    for at in sorted(found, reverse=True):
        if lang.fits(t[:k] + lang.symbol(t[k], frozenset(found[at])) + t[at:], *top):
            return at
    return -1


def mend(lang: Language, s: str, top: tuple[str, str, str]) -> tuple[float, list[int]]:
    """(cost, places of the edits in ``s``) to make the token classes ``s`` a ``top``."""
    cost, places = 0.0, []
    pairs = _Pairs(lang)
    faulty = False
    stack: list[tuple[str, int, list[str], list[int]]] = []
    opened = dict.fromkeys(")]}", 0)
    now: list[str] = []
    offsets: list[int] = []
    for i, c in enumerate(s):
        if c in _CLOSER:
            stack.append((c, i, now, offsets))
            opened[_CLOSER[c]] += 1
            now, offsets = [], []
            continue
        if c in ")]}":
            if opened[c]:
                while _CLOSER[stack[-1][0]] != c:
                    o, at, before, where = stack.pop()
                    opened[_CLOSER[o]] -= 1
                    now, offsets = [*before, o, *now], [*where, at, *offsets]
                o, at, before, where = stack.pop()
                opened[c] -= 1
                body = "".join(now)
                if faulty:
                    body, n, edits = _settle(lang, body, offsets, pairs, [r[1:] for r in lang.roles[o]])
                    cost += n
                    places += edits
                g = lang.group(o, body)
                pairs[at] = (o, body, [*offsets, i])
                faulty |= g in lang.bad
                now, offsets = [*before, g], [*where, at]
                continue
        now.append(c)
        offsets.append(i)
    while stack:
        o, at, before, where = stack.pop()
        now, offsets = [*before, o, *now], [*where, at, *offsets]
    loose = [(c, i) for c, i in zip(now, offsets, strict=True) if _ANY.match(c)]
    if loose:
        if len(loose) == 1 and not faulty and loose[0][0] in _CLOSER:
            at = _partner(lang, "".join(now), offsets.index(loose[0][1]), top)
            if at >= 0:
                return 1, [[*offsets, len(s)][at]]
        # Openers whose text runs to the end may lack their partners there.
        gone = {i for _, i in loose}
        keep = [i for i in range(len(s)) if i not in gone]
        best, edits = mend(lang, "".join(s[i] for i in keep), top)
        keep.append(len(s))
        edits = [*sorted(gone), *(keep[x] for x in edits)]
        if all(c in _CLOSER for c, _ in loose):
            n, at = mend(lang, s + "".join(_CLOSER[c] for c, _ in reversed(loose)), top)
            if n <= best:
                best, edits = n, [len(s)] * len(loose) + [min(x, len(s)) for x in at]
        return best + len(loose), edits
    body = "".join(now)
    if faulty:
        body, n, edits = _settle(lang, body, offsets, pairs, [top])
        cost += n
        places += edits
    if not lang.fits(body, *top):
        n, edits = lang.grammar.repair(top[1], body, [*offsets, len(s)], inner=pairs.inner)
        cost += n
        places += edits
    return cost, places


def cost_of(lang: Language, s: str) -> tuple[float, list[float]]:
    """(repair cost, places of the edits as shares of the text's tokens) of a string of token classes; (0, []) if it is valid.

    An infinite cost is an unknown one: no repair was found.
    """
    t, faults = reduce(lang, s)
    if not faults and not _ANY.search(t) and lang.fits(t, *lang.top):
        return 0, []
    cost, places = mend(lang, s, lang.top)
    return max(1, cost), [x / max(1, len(s)) for x in places]
