"""Credentials embedded in source code: found, scored and redacted.

Candidate values are quoted literals (also when put together from several), values of
assignments in configuration and comments, authorization values, URLs with a password,
strings in providers' formats and private key blocks. Each is scored by a logistic
regression on how likely its characters are under a Markov model of ordinary code, on
its shape, on the words of the identifiers around it, on how it was found, and on the path.

The texts are read once: a pass writes all candidates and the character counts of the
Markov model, which cover all texts. The regression is trained on weak labels that
patterns give (``weak_label``) to a sample of candidates bounded by ``sample_rows``, and on
seeds that are made from the same vocabulary. A part is held out: on it the scores are
calibrated (Platt), and the threshold is set where the held-out F1 is best. Then every
candidate is scored. Only figures of the sample come to the driver, never texts.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import stored

# Formats of issued credentials, with the text that must be present for a search to be worth it.
PROVIDERS = (
    ("AWS_KEY", ("AKIA", "ASIA"), r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("GITHUB_TOKEN", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("GITLAB_TOKEN", ("glpat-",), r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{16,}"),
    ("SLACK_TOKEN", ("xox",), r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("WEBHOOK", ("/services/", "/webhooks/"), r"https://[\w.-]+/(?:services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}|api/webhooks/\d{10,})/[A-Za-z0-9_-]{16,}"),
    ("NPM_TOKEN", ("npm_",), r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{24,}"),
    ("PAYMENT_KEY", ("sk_live_", "sk_test_", "rk_live_", "rk_test_", "sk-", "whsec_"), r"(?<![A-Za-z0-9_-])(?:[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{24,}|whsec_[A-Za-z0-9+/=]{16,})"),
    ("GOOGLE_KEY", ("AIza", "ya29."), r"(?<![A-Za-z0-9])(?:AIza[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,})"),
    ("MAIL_KEY", ("SG.",), r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    ("MODEL_HUB_TOKEN", ("hf_",), r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{24,}"),
    ("PACKAGE_TOKEN", ("pypi-", "dop_v1_"), r"(?<![A-Za-z0-9])(?:pypi-[A-Za-z0-9_-]{32,}|dop_v1_[a-f0-9]{32,})"),
    ("JWT", ("eyJ",), r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_=-]{10,}\.eyJ[A-Za-z0-9_=-]{10,}\.[A-Za-z0-9_=-]{8,}"),
)
STRONG = re.compile(r"passw|passwd|pwd|passphrase|admin_?pass|(?:^|[_.-])pass(?:$|[\d_])|secret|token|api_?key|x_api|auth(?!or)|credential|hmac|signing|private_?key|access_?key|jwt|bearer|master_?key|encryption_?key|licen[sc]e_?key")
NOT_ONE = re.compile(r"name|hint|field|header|checksum|integrity|commit|revision|hash|digest(?!_?key)|uuid|etag|fingerprint|public|cert|icon|pixel|image|(?:^|_)id\d*$|[a-z](?<!key)(?<!apik)_id\d*$|placeholder|example|label|type|prefix|length|count|size|kind|policy|pattern|regex|total|limit|budget|timeout|ttl|expir|(?:^|[_.])(?:max|min)_")
PLACEHOLDER = re.compile(r"(?i)^<.*>?$|^\W*$|your[-_ ]?|change[-_]?me|replace[-_]?(?:me|this)|example|dummy|placeholder|todo|redacted|^x{4,}|\*{3,}|\.{3}|^\$|\{\{|\$\{|%\(|%s|^(?:null|none|undefined|true|false|test|password|secret|token|passwd|pass)$|insert[-_ ]|fill[-_]?in|goes[-_]?here|1234567|^0+$|^-+$")
WORDLIKE = re.compile(r"[A-Za-z]?[a-z]*(?:[-_./ :#@][A-Z]?[a-z]+|[A-Z][a-z]+)*\d{0,4}(?:[-_./:]\d{1,4})*")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@'\"`<>]*:(?P<p>[^\s/@'\"`]+)@[^\s'\"`<>]*")
AUTH = re.compile(r"\b(?:Bearer|Basic)\s+(?P<p>[A-Za-z0-9+/=._~-]{4,})")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
LITERAL = re.compile(
    r"(?P<q>['\"`])(?P<v>[^'\"`\s\\]{4,})(?P=q)|(?<=[:=])[ \t]*(?P<u>[^\s'\"`,;{}()\[\]<>$]{6,})[ \t]*(?:\*/|-->)?[ \t]*\r?$", re.M
)
_NEXT = re.compile(r"['\"`]\s*(?:\+|\\)?\s*(?:\r?\n)?[ \t]*(?:\+[ \t]*)?[rbfuRBFU]?['\"`]([^'\"`\n\\]*)(?=['\"`])")
_MORE = re.compile(r"[ \t]*(?:\+|\\?\r?\n[ \t]*[+'\"`])")
# Values that a telling identifier names are candidates whatever their characters.
# Fixed values, in lower case: what a telling identifier holds.
HINTS = (
    "pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "credential", "hmac", "signing", "privatekey", "private_key", "private-key", "accesskey", "access_key", "access-key",
    "jwt", "bearer", "masterkey", "master_key", "master-key", "encryptionkey", "encryption_key", "encryption-key", "licensekey", "license_key", "license-key", "licencekey", "licence_key", "licence-key",
)
_HINT = re.compile("(?i)" + "|".join(HINTS))
_NAMED = re.compile(
    r"[\w$-]*+(?:['\"`]\s*,|['\"`]?\]?\s*(?P<t>:\s*(?:string|str)\s*(?==))?(?::|\??=)(?![=>]))\s*(?:\(\s*)?[rbuRBU]?"
    r"(?:(?P<q>['\"`])(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n])+)(?P=q)|(?<=[:=])[ \t]*(?P<u>[^\s'\"`,;{}()\[\]<>$]+)[ \t]*(?:\*/|-->)?[ \t]*\r?$)", re.M
)
_DIGIT = re.compile(r"\d")
_ASSIGN = re.compile(r"[A-Za-z][\w.-]+=(?=[^\s=]{6})")
_TARGET = re.compile(r"(?<![\w$-])([\w$-]++)['\"`]?\]?\s*(?::|\??=)(?![=>])")
_ARGUMENT = re.compile(r"\(\s*['\"`]([\w.$-]+)['\"`]\s*,\s*\(?\s*(?=['\"`])")
# What ends the reach of an identifier; comments and short literals are passed over.
_BREAK = re.compile(r"/\*[\s\S]*?\*/|'[^'\n]*'|\"[^\"\n]*\"|([;{}]|\n[ \t\r]*(?=\n))")
_KEY_LINE = re.compile(r"[ \t'\"`+,\\rn]*(?:[A-Za-z0-9+/=]{12,}|[A-Za-z-]+: [^\n]*)?[ \t'\"`+,;)\\rn]*\r?(?:\n|$)")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HEX = re.compile(r"[0-9a-fA-F]{8,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CONFIG = (".env", ".yml", ".yaml", ".json", ".md", ".toml", ".ini", ".cfg")
# Words of identifiers, by what they say about the value.
WORDS = {
    "password": r"passw|passwd|pwd|passphrase|admin_?pass|(?:^|[_.-])pass(?:$|[\d_])", "secret": r"secret|credential", "token": r"token|jwt|bearer", "key": r"api_?key|x_api|private_?key|access_?key|master_?key|encryption_?key|licen[sc]e_?key",
    "authorization": r"auth(?!or)", "signing": r"hmac|signing", "naming": r"name|hint|field|header|label|type|prefix|placeholder|example|kind|policy|pattern|regex", "digest": r"checksum|integrity|commit|revision|hash|digest(?!_?key)|etag|fingerprint",
    "id": r"uuid|(?:^|_)id\d*$|[a-z](?<!key)(?<!apik)_id\d*$", "public": r"public|cert", "media": r"icon|pixel|image", "number": r"length|count|size|total|limit|budget|timeout|ttl|expir|(?:^|[_.])(?:max|min)_",
}
_WORDS = [re.compile(p) for p in WORDS.values()]
_ORIGINS = ("literal", "joined", "assigned", "named", "issued", "address", "header", "block")


@dataclass
class Candidate:
    """A value that may be a credential. ``spans`` are the stretches to replace, ``at`` where it begins."""

    kind: str
    at: int
    value: str
    key: str
    spans: list[tuple[int, int]]
    certain: bool
    origin: str = "literal"


class _Names:
    """The identifiers that name values of a text, found once and only if one is asked for; lookups are by bisection."""

    def __init__(self, text: str) -> None:
        self.text = text

    @functools.cached_property
    def targets(self) -> list[tuple[int, int, str]]:
        return [(m.end(), m.start(), m.group(1)) for m in _TARGET.finditer(self.text)]

    @functools.cached_property
    def ends(self) -> list[int]:
        return [t[0] for t in self.targets]

    @functools.cached_property
    def arguments(self) -> dict[int, str]:
        return {m.end(): m.group(1) for m in _ARGUMENT.finditer(self.text)}

    @functools.cached_property
    def breaks(self) -> list[int]:
        return [m.start() for m in _BREAK.finditer(self.text) if m.group(1)]

    def key(self, at: int) -> str:
        """The identifiers that name the value at ``at``, flattened to lower case with underscores.

        The last one on the value's line counts; a value on a line of its own belongs to
        the last one before, unless a statement, a block or a paragraph ends in between.
        """
        line = self.text.rfind("\n", 0, at) + 1
        names = []
        i = bisect.bisect_right(self.ends, at) - 1
        if i >= 0:
            end, start, name = self.targets[i]
            own = start >= line
            if own or not self.text[line:at].strip(" \t+('\"`\\"):
                k = bisect.bisect_left(self.breaks, end)
                if k == len(self.breaks) or self.breaks[k] >= at:
                    names.append(name)
        if at in self.arguments:
            names.append(self.arguments[at])
        return ".".join("_".join(p.lower() for p in _PART.findall(n)) or n.lower() for n in names)


def _key_block(text: str, at: int) -> int:
    """Where a private key block without an end ends: its lines of key characters and headers are read on."""
    m = _KEY_LINE.match(text, at)
    while m and m.end() > at:
        at = m.end()
        m = _KEY_LINE.match(text, at) if at < len(text) else None
    return at


def candidates(text: str) -> list[Candidate]:
    """All candidate values of a text, by where they begin; a stretch belongs to one candidate only."""
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []  # sorted, disjoint
    names = _Names(text)
    _key = names.key

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (b, -1))
        return not i or taken[i - 1][1] <= a

    def take(a: int, b: int) -> None:
        if free(a, b):
            bisect.insort(taken, (a, b))

    def add(c: Candidate, a: int, b: int) -> None:
        out.append(c)
        take(a, b)

    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            end = text.find("-----END", m.end())
            end = _key_block(text, m.end()) if end < 0 else end
            body = text[m.end() : end]
            runs = [(m.end() + r.start(), m.end() + r.end()) for r in re.finditer(r"[A-Za-z0-9+/=]{12,}", body)]
            if runs and sum(b - a for a, b in runs) >= 32:
                add(Candidate("PRIVATE_KEY", m.start(), body, "", runs, True, "block"), m.start(), end)
    if "PUBLIC KEY-----" in text or "CERTIFICATE-----" in text or "data:" in text:
        for m in re.finditer(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)-----.*?(?:-----END|\Z)|data:[\w/+.-]+;base64,[A-Za-z0-9+/=]*", text, re.S):
            take(m.start(), m.end())
    if "://" in text:
        for m in URL.finditer(text):
            p = m.group("p")
            if free(*m.span()) and not PLACEHOLDER.search(p):
                add(Candidate("URL_PASSWORD", m.start(), p, _key(m.start()), [m.span("p")], True, "address"), *m.span())
            elif free(*m.span()):
                take(*m.span())
    for kind, marks, pattern in PROVIDERS:
        if any(x in text for x in marks):
            for m in re.finditer(pattern, text):
                if free(*m.span()) and not re.search(r"(?i)example|x{6}|your", m.group()):
                    add(Candidate(kind, m.start(), m.group(), _key(m.start()), [m.span()], True, "issued"), *m.span())
    if "Bearer" in text or "Basic" in text:
        for m in AUTH.finditer(text):
            if free(*m.span()):
                value, spans = _joined(text, *m.span("p"))
                if len(value) >= 10 and not WORDLIKE.fullmatch(value) and not PLACEHOLDER.search(value):
                    add(Candidate("AUTHORIZATION", m.start(), value, _key(m.start()), spans, True, "header"), m.start(), spans[-1][1])
    for m in LITERAL.finditer(text):
        v = m.group("v")
        span = m.span("v") if v is not None else m.span("u")
        first = text[span[0] : span[1]]
        inner = _ASSIGN.match(first) if v is None else None
        if inner:  # "# note: name=value": the value is what follows the last sign
            span = (span[0] + inner.end(), span[1])
            first = text[span[0] : span[1]]
        # Most literals are words; what could be a secret has digits, or goes on in a further literal.
        more = v is not None and _MORE.match(text, span[1] + 1)
        if not more and (len(first) < 8 or not _DIGIT.search(first) or first.isdigit() or WORDLIKE.fullmatch(first)):
            continue
        if "{" in first and ("${" in first or "}" in first) or not free(*span):
            continue
        value, spans = _joined(text, *span) if more else (first, [span])
        if len(value) < 8 or not _DIGIT.search(value) or value.isdigit() or WORDLIKE.fullmatch(value):
            continue
        key = _key(span[0] if inner else m.start())
        kind = _issued(value) if len(spans) > 1 else None
        origin = "issued" if kind else "joined" if len(spans) > 1 else "literal" if v is not None else "assigned"
        add(Candidate(kind or "SECRET", span[0], value, key, spans, kind is not None, origin), span[0], spans[-1][1])
    for begin, end in _hints(text):
        m = _NAMED.match(text, end)
        if m and free(*(span := m.span("v") if m.group("q") else m.span("u"))):
            at = m.start("q") if m.group("q") else span[0]
            key = _key(at)
            if m.group("t"):  # the name stands before its type
                start = begin
                while start and (text[start - 1].isalnum() or text[start - 1] in "_$-"):
                    start -= 1
                name = text[start:end] + re.compile(r"[\w$-]*").match(text, end).group()
                key = "_".join(x.lower() for x in _PART.findall(name))
            value, spans = _joined(text, *span) if m.group("q") else (text[span[0] : span[1]], [span])
            if STRONG.search(key) and "${" not in value:
                add(Candidate("SECRET", span[0], value, key, spans, False, "named"), span[0], spans[-1][1])
    return sorted(out, key=lambda c: c.at)


def _hints(text: str) -> list[tuple[int, int]]:
    """Where telling words stand, from left to right and without overlaps."""
    low = text.lower()
    if len(low) != len(text):  # some letters have longer lower-case forms
        return [h.span() for h in _HINT.finditer(text)]
    found = []
    for h in HINTS:
        at = low.find(h)
        while at >= 0:
            found.append((at, at + len(h)))
            at = low.find(h, at + len(h))
    out: list[tuple[int, int]] = []
    for span in sorted(found):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def _issued(value: str) -> str | None:
    """The format that a value put together from several literals has."""
    u = URL.match(value)
    if u:
        return None if PLACEHOLDER.search(u.group("p")) else "URL_PASSWORD"
    return next((k for k, marks, p in PROVIDERS if any(x in value for x in marks) and re.search(p, value)), None)


def _joined(text: str, a: int, b: int) -> tuple[str, list[tuple[int, int]]]:
    """A literal's value with the literals it is concatenated with."""
    value, spans = text[a:b], [(a, b)]
    while True:
        m = _NEXT.match(text, b)
        if not m or ("+" not in text[b : m.start(1)] and "\n" not in text[b : m.start(1)]):
            break
        a, b = m.span(1)
        value += m.group(1)
        spans.append((a, b))
    return value, spans


class Markov:
    """Character bigrams of the words and names of ordinary code, over printable ASCII."""

    def __init__(self) -> None:
        self.n = np.full((96, 96), 0.05)

    @staticmethod
    def codes(s: str) -> np.ndarray:
        c = np.frombuffer(s.encode("ascii", "replace"), np.uint8).astype(np.int64) - 32
        return np.clip(c, 0, 95)

    @staticmethod
    def counts(words: Counter[str]) -> np.ndarray:
        n = np.zeros((96, 96), np.int64)
        for w, k in words.items():
            c = Markov.codes(w)
            np.add.at(n, (c[:-1], c[1:]), k)
        return n

    def add(self, counts: np.ndarray) -> None:
        self.n += counts

    def fit(self) -> None:
        self.log = np.log(self.n / self.n.sum(1, keepdims=True))

    def score(self, s: str) -> tuple[float, float]:
        """Mean log-likelihood of a character given the one before: of the value, and of its least likely stretch of six."""
        c = self.codes(s)
        if len(c) < 2:
            return 0.0, 0.0
        x = self.log[c[:-1], c[1:]]
        return float(x.mean()), float((np.convolve(x, np.ones(5), "valid") / 5).min()) if len(x) >= 5 else float(x.mean())


_WORD_RUN = re.compile(r"[A-Z]?[a-z]{2,}")
_CODE_WORD = re.compile(r"[A-Za-z_$][\w$-]*")


def features(c: Candidate, path: str, markov: Markov) -> list[float]:
    """What the regression sees; none of these is a condition of ``weak_label`` as a whole."""
    v = c.value
    n = len(v)
    counts = Counter(v)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    digit = sum(map(str.isdigit, v)) / n
    upper = sum(map(str.isupper, v)) / n
    space = sum(map(str.isspace, v)) / n
    mark = sum(not x.isalnum() for x in v) / n
    like, worst = markov.score(v)
    wordy = sum(map(len, _WORD_RUN.findall(v))) / n
    p = path.lower()
    return [
        1.0, like, worst, like < -3.2, like < -4.0, worst < -4.5, worst < -6.0, math.log(min(n, 64)), n < 8, digit, digit == 0, digit == 1, digit == 1 and n < 6, upper, 0 < upper < 1, mark, space, space > 0, wordy, wordy + mark == 1, entropy / 4,
        bool(_HEX.fullmatch(v)), bool(_UUID.fullmatch(v)), *(bool(w.search(c.key)) for w in _WORDS), not c.key, *(c.origin == o for o in _ORIGINS), p.endswith(_CONFIG), "test" in p or "spec" in p,
    ]


def weak_label(c: Candidate) -> int:
    """1 or 0 by patterns alone."""
    if PLACEHOLDER.search(c.value):
        return 0
    if c.certain:
        return 1
    kinds = sum(any(map(f, c.value)) for f in (str.isdigit, str.isupper, str.islower, lambda x: not x.isalnum()))
    mixed = any(map(str.isdigit, c.value)) and any(map(str.isalpha, c.value)) or len(c.value) >= 6 and c.value.isdigit() or len(c.value) >= 8 and kinds >= 3
    return int(bool(STRONG.search(c.key)) and not NOT_ONE.search(c.key) and mixed and not any(map(str.isspace, c.value)) and not WORDLIKE.fullmatch(c.value) and not _UUID.fullmatch(c.value))


def seeds() -> list[tuple[Candidate, int]]:
    """Made cases of every kind, so that a sample without credentials still trains; the same each time."""
    rng = random.Random(7)
    letters, some = string.ascii_letters + string.digits, lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: "".join(rng.choice(("ba", "ter", "lin", "mo", "sel", "ra", "to", "nist", "cor", "ven", "pa", "del")) for _ in range(rng.randint(2, 3)))
    strong = ("db_password", "password", "admin_pass", "client_secret", "session_secret", "api_key", "api_token", "access_token", "private_key", "auth", "signing_key", "hmac", "jwt_key", "licence_key", "pwd", "encryption_key")
    benign = ("checksum", "commit", "revision", "integrity", "etag", "request_id", "file_uuid", "public_key", "secret_name", "password_hint", "token_count", "token_limit", "auth_header", "icon", "content_hash", "certificate")
    neutral = ("", "title", "cell", "message", "path", "version", "route", "selector", "state", "theme")
    random_ = (
        lambda: some(letters, rng.randint(16, 64)), lambda: some("0123456789abcdef", rng.choice((32, 40, 64))), lambda: word().title() + rng.choice("-_%.") + some(letters, 8), lambda: some(letters, 6) + rng.choice("!%&#?") + some(letters, rng.randint(5, 9)),
        lambda: some(string.digits, rng.randint(6, 10)), lambda: some(string.ascii_letters, 5) + "!" + some(string.ascii_letters, 6), lambda: some(string.ascii_letters, 1) + some(string.digits, 1) + some(string.ascii_uppercase, 1) + "!",
        lambda: f"{word()} {word().title()}, {word()} {some(string.digits, 1)}",
    )
    plain = (lambda: f"{word()}-{word()}-{rng.randint(1, 900)}", lambda: f"{word()}{word().title()}", lambda: f"the {word()} of the {word()}", lambda: word().title(), lambda: f"{word()}_{word()}", lambda: f"{word()}/{word()}-{rng.randint(1, 99)}", lambda: some(string.digits, rng.randint(2, 5)))
    uuid = lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
    out = []
    for i in range(24):
        for k in strong:
            out.append((Candidate("SECRET", 0, random_[(i + len(k)) % len(random_)](), k, [], False, rng.choice(("literal", "assigned", "named", "joined"))), 1))
            out.append((Candidate("SECRET", 0, plain[(i + len(k)) % len(plain)](), k, [], False, rng.choice(("literal", "assigned", "named"))), 0))
        for k in (*benign, *neutral):
            out.append((Candidate("SECRET", 0, random_[(i + len(k)) % 3](), k, [], False, rng.choice(("literal", "assigned", "joined"))), 0))
        out += [(Candidate("SECRET", 0, uuid(), rng.choice((*strong, *benign, *neutral)), [], False), 0), (Candidate("SECRET", 0, plain[i % len(plain)](), rng.choice(neutral), [], False), 0)]
        for origin in _ORIGINS[4:]:
            out.append((Candidate("SECRET", 0, rng.choice(("ghp_", "AKIA", "", "")) + some(letters, rng.randint(8, 40)), rng.choice((*strong, *neutral)), [], True, origin), 1))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """``scale``: Platt's slope and offset; ``threshold`` on calibrated scores; the rest are figures of the held-out part."""

    markov: Markov
    weights: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    n_fit: int = 0
    n_held_out: int = 0
    precision: float = 1.0
    recall: float = 1.0

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * (x @ self.weights) + b, -30, 30)))

    def score(self, c: Candidate, path: str) -> float:
        return float(self.calibrated(np.asarray([features(c, path, self.markov)], float))[0])


def _held(value: str) -> bool:
    """Whether a value is among the three tenths that are held out; equal values are on the same side."""
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) % 10 < 3


def fit(markov: Markov, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """A model of labelled feature rows and the seeds, calibrated and cut on the rows ``held`` out."""
    made = seeds()
    x = np.vstack([x.reshape(-1, len(features(made[0][0], "", markov))), np.asarray([features(c, "src/a.ts", markov) for c, _ in made], float)])
    y = np.concatenate([y, np.asarray([k for _, k in made], float)])
    held = np.concatenate([held, np.asarray([_held(c.value) for c, _ in made])])
    m = Model(markov, fit_logistic(x[~held], y[~held]), n_fit=int((~held).sum()), n_held_out=int(held.sum()))
    z, k = x[held] @ m.weights, y[held]
    # Platt's targets keep the slope finite where the held-out part is separated.
    up, down = (k.sum() + 1) / (k.sum() + 2), 1 / (len(k) - k.sum() + 2)
    a, b = fit_logistic(np.column_stack([z, np.ones(len(z))]), np.where(k == 1, up, down), l2=1e-9)
    m.scale = (float(a), float(b))
    p = m.calibrated(x[held])
    order = np.argsort(-p, kind="stable")
    p, k = p[order], k[order]
    hits = np.cumsum(k)
    f1 = 2 * hits / (np.arange(1, len(k) + 1) + k.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # a threshold lies between scores
    best = int(np.argmax(f1))
    m.threshold = float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)
    m.precision, m.recall = float(hits[best] / (best + 1)), float(hits[best] / k.sum())
    return m


def train(samples: list[tuple[str, str]]) -> Model:
    """A model from (path, text) samples."""
    markov = Markov()
    words: Counter[str] = Counter()
    for _, t in samples:
        words.update(_CODE_WORD.findall(t))
    markov.add(Markov.counts(words))
    markov.fit()
    cs = [(c, p or "") for p, t in samples for c in candidates(t)]
    return fit(markov, np.asarray([features(c, p, markov) for c, p in cs], float), np.asarray([weak_label(c) for c, _ in cs], float), np.asarray([_held(c.value) for c, _ in cs], bool))


def find(text: str, path: str, model: Model, threshold: float | None = None) -> list[tuple[Candidate, float]]:
    """The candidates of a text whose calibrated score passes the threshold and that are no placeholders."""
    out = []
    for c in candidates(text):
        if not PLACEHOLDER.search(c.value):
            s = model.score(c, path)
            if s >= (model.threshold if threshold is None else threshold):
                out.append((c, s))
    return out


def redact(text: str, found: list[Candidate]) -> str:
    """``text`` with each credential's first stretch replaced by a marker and its others emptied."""
    edits = sorted((a, b, f"[REDACTED_{c.kind}]" if i == 0 else "") for c in found for i, (a, b) in enumerate(c.spans))
    out, at = [], 0
    for a, b, mark in edits:
        if a >= at:
            out += [text[at:a], mark]
            at = b
    return "".join(out) + text[at:]


_CANDIDATES = "source_table string, record_id bigint, path string, line_no bigint, kind string, value string, key string, certain boolean, origin string, gram int, n bigint"


def _texts(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("source_table"), F.col(i).cast("bigint").alias("rid"), F.col("path").alias("path"), F.col(t).cast("string").alias("text")) for name, (df, i, t) in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def extracted(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One pass over all texts, written: a row per candidate, and rows (``gram``, ``n``) of each task's character bigrams."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in _CANDIDATES.split(", ")]
        grams = np.zeros((96, 96), np.int64)
        for b in batches:
            rows, words = [], Counter()
            for name, i, path, text in zip(b.source_table, b.rid, b.path, b.text, strict=True):
                line, at = 1, 0
                words.update(_CODE_WORD.findall(text))
                for c in candidates(text):
                    line, at = line + text.count("\n", at, c.at), c.at
                    rows.append((name, i, path or "", line, c.kind, c.value, c.key, c.certain, c.origin, None, None))
            grams += Markov.counts(words)
            yield pd.DataFrame(rows, columns=columns).astype({"gram": "Int32", "n": "Int64"})
        none = (None,) * (len(columns) - 2)
        yield pd.DataFrame([(*none, int(g), int(grams.flat[g])) for g in np.flatnonzero(grams)], columns=columns).astype({"record_id": "Int64", "line_no": "Int64", "certain": "boolean", "gram": "Int32", "n": "Int64"})

    return stored(_texts(tables).where("text is not null and text <> ''").mapInPandas(scan, _CANDIDATES))


def trained(found: DataFrame, sample_rows: int = 20_000) -> Model:
    """The model of ``extracted`` candidates; its sample is drawn by a hash of table, record and line."""
    markov = Markov()
    grams = found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most 96 x 96 rows
    n = np.zeros(96 * 96)
    n[grams.gram.to_numpy(np.int64)] = grams.n.to_numpy(float)
    markov.add(n.reshape(96, 96))
    markov.fit()
    cs = found.where("gram is null")
    part = max(1, -(-cs.count() // sample_rows))

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(Candidate(k, 0, v, key, [], c, o), p) for k, v, key, c, o, p in zip(b.kind, b.value, b.key, b.certain, b.origin, b.path, strict=True)]
            yield pd.DataFrame({"x": [[float(f) for f in features(c, p, markov)] for c, p in got], "y": [float(weak_label(c)) for c, _ in got], "held": [_held(c.value) for c, _ in got]})

    sample = cs.where(F.pmod(F.xxhash64("source_table", "record_id", "line_no"), F.lit(part)) == 0).limit(2 * sample_rows)
    rows = sample.mapInPandas(figures, "x array<double>, y double, held boolean").toPandas()
    return fit(markov, np.asarray(rows.x.tolist(), float), rows.y.to_numpy(float), rows.held.to_numpy(bool))


def credentials(tables: dict[str, tuple[DataFrame, str, str]], threshold: float | None = None, sample_rows: int = 20_000, with_text: bool = False) -> DataFrame:
    """Credentials in the texts of several tables (name -> (table, id column, text column); each also has ``path``).

    Without ``with_text`` one row per credential: ``source_table``, ``record_id``,
    ``line_no`` (from 1; where the value begins), ``kind``, ``score`` (calibrated). With
    it, one row per input row: ``source_table``, ``record_id``, ``n_credentials`` and
    ``redacted``, the text with only the credentials replaced. ``threshold`` is by default the
    one that the held-out part sets. Null and empty texts have none (their ``redacted`` is
    the text itself); a null path says nothing; repeated rows are scanned each. Empty
    tables give no rows.
    """
    found = extracted(tables)
    model = trained(found, sample_rows)
    least = model.threshold if threshold is None else threshold

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[not PLACEHOLDER.search(v) for v in b.value]]
            x = [features(Candidate(k, 0, v, key, [], c, o), p, model.markov) for k, v, key, c, o, p in zip(b.kind, b.value, b.key, b.certain, b.origin, b.path, strict=True)]
            if x:
                yield b[["source_table", "record_id", "line_no", "kind"]].assign(score=model.calibrated(np.asarray(x, float)))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [[c for c, _ in find(t, p or "", model, least)] if t else [] for p, t in zip(b.path, b.text, strict=True)]
            texts = [redact(t, h) if h else t for t, h in zip(b.text, hits, strict=True)]
            yield pd.DataFrame({"source_table": b.source_table, "record_id": b.rid, "n_credentials": [len(h) for h in hits], "redacted": texts})

    if with_text:
        return _texts(tables).mapInPandas(clean, "source_table string, record_id bigint, n_credentials bigint, redacted string")
    scores = found.where("gram is null").mapInPandas(scored, "source_table string, record_id bigint, line_no bigint, kind string, score double")
    return scores.where(F.col("score") >= least)


def quality(tables: dict[str, tuple[DataFrame, str, str]], sample_rows: int = 20_000) -> DataFrame:
    """One row on the model: ``n_fit``, ``n_held_out``, ``threshold``, and ``precision`` and ``recall`` against the weak labels of the held-out part."""
    m = trained(extracted(tables), sample_rows)
    spark = next(iter(tables.values()))[0].sparkSession
    return spark.createDataFrame([(m.n_fit, m.n_held_out, m.threshold, m.precision, m.recall)], "n_fit bigint, n_held_out bigint, threshold double, precision double, recall double")
