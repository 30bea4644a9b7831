"""Credentials in source code and pasted configuration (problem 1).

Candidates are all odd values (digits, signs or mixed case within) that stand quoted, assigned, in the login of a URL or of
a command, after a scheme or a word for access, in a vendor's format, and private key blocks.  A logistic regression
scores each from the character Markov likelihood of the value under the corpus' ordinary words, its shape, the identifiers
before it in its statement and the file's path.  Its weights begin at nothing and are learned from weak labels: patterns
that are surely credentials (vendor formats, private keys, logins in URLs, random values under secret names) and surely
none (placeholders, digests, public keys, plain words), found in all texts and in some made-up ones; other candidates are
left to the model.  Tasks sum up the likelihood's counts and the steps of the regression over every candidate, so only
sums of a fixed size come to the driver.  A held-out part calibrates the scores (Platt).  Values that score at least 0.5
are reported and can be masked exactly, leaving the rest of the text as it is.

Defined cases: null texts and null keys give nothing; rows repeated count once; texts, values and identifiers of any length
are read whole; values of fewer than four characters are no candidates; what stands between two quotes on a line is one
value; a value alone on its line belongs to the name that ends the line before (blank lines between do not count); a private
key without its END line is no whole key and is not reported; the path may be null.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.text import least_by_hash, spread
from archspark.session import drop_durable, durable

#: Weakly labelled candidates a task of the regression takes, about; there are as many tasks as they need.
LESSONS_OF_A_TASK = 50_000
#: Calibrated score from which a value is reported.
THRESHOLD = 0.5
_BUCKETS = 64

#: Formats of keys that vendors publish.
VENDOR = re.compile(
    r"(?<![\w-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|sk-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"rk_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{30,}|AIza[\w-]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_[0-9a-f]{40,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})"
)
_VENDOR_STARTS = ("AKIA", "ASIA", "gh", "glpat-", "xox", "sk-", "sk_", "rk_", "npm_", "pypi-", "AIza", "hf_", "SG.", "dop_v1_", "eyJ")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?:(?!-----BEGIN ).)*?-----END \1-----", re.S)
_RUN = r"[^\s\"'`\\<>(){}\[\],;]{4,}+"
_QUOTED = tuple(re.compile(p) for p in (r"\"([^\"\\\n]{4,}+)(?=[\"\\])", r"(?<![\w)])[rbufRBUFL]{0,2}'([^'\\\n]{4,}+)(?=['\\])", r"`([^`\\\n]{4,}+)(?=[`\\])"))
_ASSIGNED = re.compile(rf"(?<![\w.\-])([A-Za-z_][\w.\-]*+)[\"']?(\s?(?<![=!<>])=\s?(?!=)|:[ \t]++|:(?![:/]))({_RUN})")
_SETTING = re.compile(r"(?m)^[ \t]*+(?:- |export )?[ \t]*+([A-Za-z_][\w.\-]*+)(: |=)[ \t]*+([^\s\"'`#{}\[<$(][^\s\"'`]*+)[ \t]*+(?:#[^\n]*+)?$")
_SAID = re.compile(rf"(?i)\b(password|passphrase|passwd|pass|pwd|pw|secret|token|key)(?: is| was)? +({_RUN})")
_SPOKEN = re.compile(r"(?:pass(?:word|phrase|wd)?|pwd?|secret|token|key)(?: is| was)? +[^\s=(]")
_SCHEME = re.compile(rf"(?i)\b(bearer|basic) +({_RUN})")
_USER = re.compile(r"(?:^|\s)(?:-u|--user)[ =]?[\"']?([^\s:\"']*+):([^\s\"'`\\]{4,}+)")
_URL = re.compile(r"[^\s\"'`\\<>]*+")
_LOGIN = re.compile(r"://[^\s:@/\"']*+:([^\s\"']+)@")
_NAME = re.compile(r"[A-Za-z_][\w\-]*")
_BREAK = re.compile(r"[;{}]")
_SEPARATOR = re.compile(r"[,;()\[\]{}]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Texts that stand for a credential without being one.
_PLACEHOLDER = re.compile(
    r"[x*.\-_#?]{3,}|.*(?:change.?me|replace.?me|your[-_ ]|placeholder|redacted|set.?me|insert|dummy|sample|fill.?in|todo).*|example\w*|none|null|true|false|undefined|\$.*|%\w+%|%[sdr]|.*\{.*|<.*|(.)\1{5,}", re.I | re.S
)
_SECRET_WORDS = frozenset("password passwd pwd pw pass passphrase secret token apikey key auth authorization bearer basic login credential credentials signing webhook client private pat session account access cred creds".split())
_STRONG_WORDS = frozenset("password passwd pwd pw pass passphrase secret apikey bearer basic login credential credentials".split())
_OTHER_WORDS = frozenset("sha sha1 sha256 sha512 md digest hash checksum commit etag trace request uuid guid icon label name url path public packed data version revision build id fingerprint span color image cache size host prompt file dir message".split())

_ENDINGS = ("password", "passwd", "passphrase", "secret", "token", "apikey")
_LOGIN_WORDS = frozenset(("login",))
_KEY_OF = frozenset("public primary foreign sort partition cache hash group row dict map".split())

#: Kinds of place a value stands in.
KINDS = ("quoted", "pair", "url", "bearer", "basic", "userpass", "word", "bare", "pem")


@dataclass(slots=True)
class Candidate:
    """A value with its place: kind, nearest identifier, further identifiers of the line."""

    start: int
    value: str
    kind: str
    key: str
    around: tuple[str, ...]
    call: bool
    config: bool = False
    secret_around: bool = False
    other_around: bool = False
    login_around: bool = False


_ODD = re.compile(r"[0-9!@#$%^&*]")


def _odd(value: str) -> bool:
    """Looks like more than a word or a name: digits, mixed case or signs within."""
    if _ODD.search(value):
        return True
    return len(value) >= 8 and not value.islower() and sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha()) >= 4


class _Context:
    """The identifiers of a text's lines; each line is read once, however many values stand on it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lines: dict[int, tuple] = {}

    def line(self, at: int) -> tuple:
        """(begin, names, their ends, words of secrets, of other things and of logins up to each, ends of statements)."""
        begin = self.text.rfind("\n", 0, at) + 1
        found = self.lines.get(begin)
        if found is None:
            end = self.text.find("\n", begin)
            end = len(self.text) if end < 0 else end
            names = [m for m in _NAME.finditer(self.text, begin, end) if m.end() - m.start() <= 32]
            sums: list[list[int]] = [[0], [0], [0]]
            for m in names:
                words = _words_of(m[0])
                for total, kind in zip(sums, (_SECRET_WORDS, _OTHER_WORDS, _LOGIN_WORDS)):
                    total.append(total[-1] + any(w in kind for w in words))
            found = self.lines[begin] = (begin, [m[0] for m in names], [m.end() for m in names], sums, [m.end() for m in _BREAK.finditer(self.text, begin, end)])
        return found

    def before(self, at: int) -> tuple[str, tuple[str, ...], tuple[bool, bool, bool]]:
        """(nearest name, up to four names before it, whether any of these or earlier ones of the statement speak of secrets,
        other things, logins); a value alone on its line belongs to the line before that is not blank."""
        for _ in range(2):
            begin, names, ends, sums, breaks = self.line(at)
            stop = bisect.bisect_right(ends, at)
            k = bisect.bisect_right(breaks, at)
            start = bisect.bisect_left(ends, breaks[k - 1]) if k else 0
            if stop > start or not begin:
                break
            last = len(self.text[:begin].rstrip()) if begin < 4096 else self._end_before(begin)
            if not last or self.text[last - 1] not in "=:([{\\" or self.text[begin:at].strip(" \t\"'`-([{"):
                break
            at = last
        if stop <= start:
            return "", (), (False, False, False)
        known = tuple(total[stop - 1] > total[start] for total in sums)
        return names[stop - 1], tuple(names[max(start, stop - 5) : stop - 1]), known

    def _end_before(self, at: int) -> int:
        while at and self.text[at - 1].isspace():
            at -= 1
        return at


def candidates(text: str) -> list[Candidate]:
    """All values that stand quoted, assigned, in a login or after a word for access, in text order.

    Where two overlap, the one in the more telling place holds (a header's token, not the quoted header).
    """
    found: list[tuple[int, int, int, str, str]] = []  # rank, start, end, kind, name
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        found.append((0, *m.span(), "pem", "private_key"))
    at, end = text.find("://"), 0
    while at >= 0:  # each address of a run by itself
        if at >= end:
            end = _URL.match(text, at).end()
        following = text.find("://", at + 3)
        login = _LOGIN.match(text, at, end if following < 0 else min(end, following))
        if login:
            found.append((1, *login.span(1), "url", "login"))
        at = following
    for m in _USER.finditer(text) if "-u" in text else ():
        found.append((2, *m.span(2), "userpass", "user"))
    low = text.lower()
    for m in _SCHEME.finditer(text) if "bearer " in low or "basic " in low else ():
        if _odd(m[2]):
            found.append((3, m.start(2), m.start(2) + len(m[2].rstrip(".,:")), m[1].lower(), m[1].lower()))
    for m in VENDOR.finditer(text) if any(x in text for x in _VENDOR_STARTS) else ():
        if not text[m.end() : m.end() + 1].isalnum():
            found.append((7, *m.span(), "bare", ""))
    for m in _SETTING.finditer(text):
        if m[3][-1] not in ";,{([" and _SEPARATOR.search(m[3]) and _odd(m[3]):
            found.append((4, *m.span(3), "setting", m[1]))
    for m in _ASSIGNED.finditer(text):
        value, start = m[3], m.start(3)
        if _odd(value) and "://" not in value:
            if m.start() and text[m.start() - 1] in "?&":
                value = value.partition("&")[0]
            found.append((5, start, start + len(value.rstrip(".,:;!?")), "pair", m[1]))
    spans = []
    for pattern in _QUOTED:
        for m in pattern.finditer(text):
            if _odd(m[1]) and "://" not in m[1]:
                found.append((6 if " " not in m[1] else 9, *m.span(1), "quoted", ""))
                spans.append(m.span(1))
    for m in _SAID.finditer(text) if _SPOKEN.search(low) else ():
        if _odd(m[2]) and not _ASSIGNED.match(m[2]):
            found.append((8, m.start(2), m.start(2) + len(m[2].rstrip(".,:;!?")), "word", m[1].lower()))
    if not found:
        return []
    return _resolve(text, found, sorted(spans))


def _resolve(text: str, found: list[tuple[int, int, int, str, str]], quoted: list[tuple[int, int]]) -> list[Candidate]:
    """Candidates with their context, none overlapping another."""
    context, taken, out = _Context(text), _Spans(), []
    begins = [a for a, _ in quoted]
    reach = list(itertools.accumulate((b for _, b in quoted), max))
    for _, start, end, kind, name in sorted(found):
        if end - start < 4 or taken.overlaps(start, end):
            continue
        value = text[start:end]
        opened, closed = text[start - 1 : start] if start else "", text[end : end + 1]
        if kind == "pair":
            at = bisect.bisect_right(begins, start) - 1
            inside = at >= 0 and reach[at] >= end
            if inside and not any(w in _SECRET_WORDS for w in _parts(name)) and not VENDOR.fullmatch(value):
                continue  # a part of a quoted value, which is a candidate itself
        if kind in ("quoted", "bare") and (opened and opened in "})]" or value[0] == "@"):
            continue  # the rest of an expression or a template
        key, around, known = context.before(start)
        if name:
            key = name
        line = text[text.rfind("\n", 0, start) + 1 : start] if start - text.rfind("\n", 0, start) < 4096 else ""
        config = kind == "setting" or kind == "pair" and bool(re.fullmatch(r"\s*(?:- )?[\w.\-]+: +", line) or not re.search(r"\s[=:]\s|\s=|=\s", text[max(0, start - 3) : start]))
        lead = text[max(0, start - 60) : start].rstrip("\"'`")
        call = closed == "(" or lead.endswith("(") and bool(re.search(r"[A-Za-z_]\w*\($", lead))
        taken.add(start, end)
        out.append(Candidate(start, value, "pair" if kind == "setting" else kind, key, around, call, config, *known))
    out.sort(key=lambda c: c.start)
    return out


class _Spans:
    """Disjoint spans."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.ends, start + 1)
        return k < len(self.begins) and self.begins[k] < end

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.begins, start)
        self.begins.insert(k, start)
        self.ends.insert(k, end)


# --------------------------------------------------------------------------- features


_CODES = 97
_CODE_OF = np.full(1 << 8, 96, np.uint8)
_CODE_OF[32:127] = np.arange(1, 96)
_CODE_OF[10] = 0
_PLAIN = re.compile(r"[A-Za-z_]{3,}\d{0,3}")


def transitions(text: str) -> np.ndarray:
    """Counts of the steps from character to character within the ordinary words of a text (0: begin and end)."""
    codes = _CODE_OF[np.frombuffer(("\n" + "\n".join(m for m in _PLAIN.findall(text) if len(m) <= 40) + "\n").encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    counts = np.bincount(codes[:-1] * _CODES + codes[1:], minlength=_CODES * _CODES).reshape(_CODES, _CODES).astype(float)
    counts[0, 0] = 0.0  # a text without words counts nothing, so that texts can be counted together
    return counts


class Markov:
    """First-order model of the characters of ordinary words."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = counts + 0.05
        self.logp = np.log(counts / counts.sum(1, keepdims=True))

    def likelihood(self, word: str) -> float:
        """Mean log probability of a step."""
        codes = _CODE_OF[np.frombuffer(f"\n{word}\n".encode("latin-1", "replace"), np.uint8)]
        return float(self.logp[codes[:-1], codes[1:]].mean())


def _parts_of(name: str) -> list[str]:
    """Lower-case words of an identifier; PGPASSWORD and the like end in a secret word and count as it."""
    out = [p.lower() for p in _PART.findall(name)]
    return [next((w for w in _ENDINGS if p.endswith(w)), p) if len(p) > 6 else p for p in out]


_PARTS: dict[str, list[str]] = {}


def _parts(name: str) -> list[str]:
    """As :func:`_parts_of`, remembered for a bounded number of names."""
    found = _PARTS.get(name)
    if found is None:
        if len(_PARTS) > 100_000:
            _PARTS.clear()
        found = _PARTS[name] = _parts_of(name)
    return found


_words_of = _parts


NUMERIC = ("likelihood", "entropy", "length", "digits", "upper", "lower", "signs", "switches", "blanks")
FLAGS = ("vendor", "placeholder", "hex", "uuid", "wordy", "secret_key", "secret_last", "strong_key", "other_key", "secret_around", "other_around", "pathlike", "assigned_code", "call", "no_key", "test_path", "source_path", *KINDS)
#: Strength of the normal prior around 0 that keeps the weights finite.
RIDGE = 0.05


def _other_key(key: list[str]) -> bool:
    """The identifier names something else: a digest, an id, a label, or a key that opens nothing."""
    if not key:
        return False
    if key[-1] in _SECRET_WORDS:
        return key[-1] == "key" and len(key) > 1 and key[-2] in _KEY_OF and not (key[0] == "x" and len(key) > 2)
    return key[-1] in _OTHER_WORDS or any(p in ("public", "sha", "digest", "commit", "etag", "trace", "checksum") for p in key)


def _flags(c: Candidate, path: str) -> list[bool]:
    v = c.value
    key = _parts(c.key)
    secret = any(p in _SECRET_WORDS for p in key)
    login = c.kind == "quoted" and not secret and c.login_around  # an argument after another, such as login("user", "...")
    words = re.findall(r"[A-Za-z]+", v)
    wordy = not re.search(r"\d", v) and len(words) >= 1 and all(w.islower() or w.isupper() or w.istitle() for w in words) and not re.search(r"[!@#$%^&*]", v)
    return [
        bool(VENDOR.fullmatch(v)),
        c.kind != "pem" and bool(_PLACEHOLDER.fullmatch(v)),
        bool(re.fullmatch(r"[0-9a-f]{32,}", v)),
        bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", v)),
        wordy,
        secret or login or "login" in key,
        login or bool(key) and key[-1] in _SECRET_WORDS,
        login or any(p in _STRONG_WORDS for p in key),
        not login and _other_key(key),
        c.secret_around,
        c.other_around,
        bool(re.fullmatch(r"(?:[\w.\-]+/)+[\w.\-]*|[\w/]+\.(?:py|pyi|cpp|hpp|cc|cxx|hh|h|txt|md|json|yaml|yml)", v)) and not re.search(r"[=+]", v) and len(v) / (v.count("/") + 1) < 18,
        c.kind in ("pair", "bare") and not c.config and bool(re.fullmatch(r"[A-Za-z_][\w.\-]*(?:>|::)?[\w.:]*", v)) and not VENDOR.fullmatch(v) and not (c.kind == "pair" and re.search(r"\d[a-zA-Z]|[a-z][A-Z0-9]{2}", v)),
        c.call,
        c.kind in ("quoted", "pair", "bare") and not c.key,
        bool(re.search(r"(?:^|/)(?:tests?|examples?|fixtures?|docs?|samples?)/", path)),
        bool(path),
        *[c.kind == k for k in KINDS],
    ]


_KIND_OF = np.full(256, 3, np.uint8)  # 0 digit, 1 upper, 2 lower, 3 sign
_KIND_OF[48:58], _KIND_OF[65:91], _KIND_OF[97:123] = 0, 1, 2


def numbers_of(values: list[str], markov: Markov) -> np.ndarray:
    """The numeric features of each value, a row each; all characters count."""
    if not values:
        return np.zeros((0, len(NUMERIC)))
    data = np.frombuffer(("\n" + "\n".join(values) + "\n").encode("latin-1", "replace"), np.uint8)
    n = np.fromiter(map(len, values), np.int64, len(values))
    starts = np.r_[0, np.cumsum(n + 1)[:-1]] + 1  # of each value; its line ends stand around it
    owner = np.repeat(np.arange(len(values)), n)
    inner = data[np.arange(n.sum()) + np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n)]
    kinds = np.stack([np.bincount(owner[_KIND_OF[inner] == k], minlength=len(values)) for k in range(4)], 1) / n[:, None]
    cells, counts = np.unique(owner * 256 + inner, return_counts=True)
    share = counts / n[cells // 256]
    entropy = np.bincount(cells // 256, -share * np.log2(share), len(values))
    codes = _CODE_OF[data]
    steps = markov.logp[codes[:-1], codes[1:]]
    total = np.r_[0.0, np.cumsum(steps)]
    likelihood = (total[starts + n] - total[starts - 1]) / (n + 1)
    same = owner[1:] == owner[:-1]
    k = _KIND_OF[inner]
    switches = np.bincount(owner[1:][same & ((k[1:] == 0) != (k[:-1] == 0)) | same & ((k[1:] == 2) != (k[:-1] == 2))], minlength=len(values)) / n
    blanks = np.log1p(np.bincount(owner[inner == 32], minlength=len(values)))
    return np.stack([likelihood, entropy, np.log(n), *kinds.T, switches, blanks], 1)


def _numbers(c: Candidate, markov: Markov) -> list[float]:
    return numbers_of([c.value], markov)[0].tolist()


def _hashed(c: Candidate) -> int:
    """The buckets of the names, as the bits of a signed number."""
    names = {"k:" + p for p in _parts(c.key)} | {"a:" + p for name in c.around[-2:] for p in _parts(name)}
    bits = 0
    for x in names:
        bits |= 1 << zlib.crc32(x.encode()) % _BUCKETS
    return bits - (1 << _BUCKETS) if bits >> _BUCKETS - 1 else bits


def _packed(flags: list[bool]) -> int:
    return sum(1 << k for k, f in enumerate(flags) if f)


def weak_label(c: Candidate, flags: list[bool], numbers: list[float]) -> int | None:
    """1: surely a credential, 0: surely none, None: unsure, left to the model."""
    f = dict(zip(FLAGS, flags))
    if c.kind == "pem":
        return 1
    if f["placeholder"] or f["uuid"] or f["assigned_code"] or (f["wordy"] and not f["vendor"] and c.kind in ("quoted", "pair", "bare")):
        return 0
    if f["other_key"] and not f["vendor"]:
        return 0
    if f["vendor"]:
        return 1
    random = numbers[7] > 0.2 or numbers[1] > 3.4
    if c.kind in ("url", "userpass", "bearer", "basic") and not f["placeholder"]:
        return 1
    if (f["strong_key"] or c.kind == "word") and random:
        return 1
    key = _parts(c.key)
    if f["secret_key"] and key and key[-1] in _SECRET_WORDS and c.kind in ("quoted", "pair") and len(c.value) >= 10 and numbers[1] > 2.8 and re.search(r"\d", c.value):
        return 1
    if not f["secret_key"] and not f["secret_around"]:
        return 0
    return None


@dataclass
class Model:
    """Everything a worker needs to score a candidate; a few kilobytes, whatever the corpus."""

    markov: Markov
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def scores(self, found: list[tuple[Candidate, str]]) -> np.ndarray:
        """Calibrated scores of candidates with their paths."""
        return self.scores_of([c.value for c, _ in found], [_packed(_flags(c, path)) for c, path in found], [_hashed(c) for c, _ in found])

    def scores_of(self, values: list[str], flags: list[int], names: list[int]) -> np.ndarray:
        """The same of values with their flags and names as bits, some thousands at a time."""
        out = np.zeros(len(values))
        for k in range(0, len(values), 4096):
            part = slice(k, k + 4096)
            x = _matrix(numbers_of(values[part], self.markov), np.array(flags[part], np.int64), np.array(names[part], np.int64), self.mean, self.deviation)
            out[part] = _sigmoid(self.slope * (x @ self.weights) + self.shift)
        return out

    def secrets(self, text: str, path: str = "") -> list[tuple[int, str]]:
        """(offset, value) of the credentials in a text."""
        return self.secrets_of([(text, path)])[0]

    def secrets_of(self, texts: list[tuple[str | None, str]]) -> list[list[tuple[int, str]]]:
        """The same for many texts, their candidates scored together some thousands at a time."""
        out: list[list[tuple[int, str]]] = [[] for _ in texts]
        held: list[tuple[Candidate, str]] = []
        owners: list[int] = []

        def settle() -> None:
            for k, (c, _), score in zip(owners, held, self.scores(held)):
                if score >= THRESHOLD:
                    out[k].append((c.start, c.value))
            held.clear()
            owners.clear()

        for k, (text, path) in enumerate(texts):
            for c in candidates(text) if text else ():
                held.append((c, path))
                owners.append(k)
                if len(held) >= 4096:
                    settle()
        if held:
            settle()
        return out


_WIDTH = 1 + len(NUMERIC) + len(FLAGS) + _BUCKETS


def _matrix(numbers: np.ndarray, flags: np.ndarray, names: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """A row of the regression for each candidate."""
    x = np.ones((len(flags), _WIDTH))
    x[:, 1 : 1 + len(NUMERIC)] = (numbers - mean) / deviation
    x[:, 1 + len(NUMERIC) : _WIDTH - _BUCKETS] = flags[:, None] >> np.arange(len(FLAGS)) & 1
    x[:, _WIDTH - _BUCKETS :] = np.unpackbits(names.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """First and second derivatives of the logistic loss, one after the other: sums over the rows."""
    p = _sigmoid(x @ w)
    return np.r_[x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]


def _fit(slopes: Callable[[np.ndarray], np.ndarray], centre: np.ndarray, strength: float) -> np.ndarray:
    """Logistic regression with a normal prior around ``centre``, by damped Newton steps on ``slopes`` of all rows."""
    w, d = centre.copy(), len(centre)
    for _ in range(50):
        sums = slopes(w)
        gradient = sums[:d] + strength * (w - centre)
        hessian = sums[d:].reshape(d, d) + strength * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def lessons() -> list[tuple[str, str]]:
    """Made-up texts that are always learned from, so that a table of a few rows still gives a model: random values in the
    usual places of credentials, and digests, ids, placeholders and texts in places much like them."""
    rng = random.Random(11)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed, hexes, words = string.ascii_letters + string.digits, "0123456789abcdef", "amber basil cedar delta ember fjord grove heron".split()
    out = []
    for k in range(60):
        uuid = "-".join(key(hexes, n) for n in (8, 4, 4, 4, 12))
        name = rng.choice(("password", "api_key", "client_secret", "auth_token", "db_passwd", "signing_key", "passphrase", "store_pw", "access_key", "adminPassword", "apiKey", "secret", "pwd", "webhook_secret"))
        leet = rng.choice(words).translate(str.maketrans("aeio", "4310")) + f"-{rng.randint(1000, 9999)}-" + key(string.ascii_lowercase, 4)
        value = rng.choice((key(mixed, rng.randint(12, 40)), key(mixed + "!#$%&*", 14), key(hexes, rng.choice((32, 40))), "_".join(rng.choices(words, k=2)) + str(rng.randint(10, 99)), leet, key(mixed, 20).title() + "7"))
        out += [
            f'{name} = "{value}"', f"{name}: {value}", f"{name.upper()}={value}", f'const char* {name} = "{value}";', f'headers = {{"Authorization": "Bearer {value}"}}', f'auth = "Basic {key(mixed, 24)}="',
            f'dsn = "postgres://svc:{value}@db.invalid:5432/x"', f"curl -u svc:{value} https://h.invalid/x", f'session = login("svc_{words[k % 8]}", "{value}")', f"log in as svc with password {value} to look", f'token = "ghp_{key(mixed, 36)}"', f'conn = "AccountName=x;AccountKey={key(mixed, 60)}=="',
            f'commit = "{key(hexes, 40)}"', f'sha256 = "{key(hexes, 64)}"', f'request_id = "{uuid}"', f'version = "{k}.4.{k + 1}"', f'{name} = "REPLACE_ME_{k}"', f'{name} = "${{{name.upper()}}}"', f'{name}_label = "Enter the value of field {k}"', f'{name} = os.environ["{name.upper()}_{k}"]', f"{name} = load_value_{k}(path)",
            f'name = "{rng.choice(words)}_{k}"', f'raise ValueError("bad token at line {k}")', f'public_key = "{key(mixed, 44)}"', f"row_{k} = table_{k + 1}", f'color = "#{key(hexes, 6)}"', f'path = "data/{rng.choice(words)}/{k}.json"', f'etag = "{key(hexes, 32)}"', f"offset_{k}: {k * 37}", f'cache_key = "rows:{k}:{rng.choice(words)}"',
            f'primary_key = "order_{k}"', f'"{key(mixed + "+/", 60)}",', f'{name} = "****{k}"', f'timeout = "{k}s"', f'{name} = "example{k}"',
            f'setenv("{name.upper()}", "{value}", 1)', f'os.environ.setdefault("{name.upper()}", "{value}")', f"export {name.upper()}='{value}'", f'dsn = "postgres://{{user}}:{{{name}_{k}}}@h.invalid/x"', f'dsn = "redis://svc:${{{name}{k}}}@h.invalid/x"', f'dsn = "redis://svc:${name.upper()}{k}@h.invalid/x"', f'dsn = "redis://<user>:<{name}{k}>@h.invalid/x"', f'auth = "Bearer <token{k}>"', f'"""Some words about {k} {words[k % 8]} rows of a {words[k % 5]} table."""', f'"A note on {words[k % 7]} with a default of {k}."', f"Load: a={k} b={k + 3} c=0.{k}", f"return {words[k % 8]}_{k}.value", f'log("{words[k % 8]} {k} of {{}}", n)',
            f'{name} = "{key(string.ascii_letters + "*#%", 11)}*"', f"# account: ops / pw {value}", f"'X-Some-Key: {value}'",
        ]
    return [("\n".join(out[i : i + 50]), "src/a.py") for i in range(0, len(out), 50)]


#: (offset, value, flags, names, weak label or -1, hash) of a candidate; flags and names are bits.
Lesson = tuple[int, str, int, int, int, int]
#: What a sum over lessons is taken of: numbers (a row each), flags, names, labels and hashes.
Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def study(texts: list[tuple[str | None, str]]) -> list[list[Lesson]]:
    """What a model learns from and judges: every candidate of each text with its features and weak label."""
    out: list[list[Lesson]] = [[] for _ in texts]
    held: list[tuple[int, Candidate, str]] = []

    def settle() -> None:
        for (k, c, path), numbers in zip(held, numbers_of([c.value for _, c, _ in held], _NO_WORDS).tolist()):
            flags = _flags(c, path)
            label = weak_label(c, flags, numbers)
            out[k].append((c.start, c.value, _packed(flags), _hashed(c), -1 if label is None else label, xxhash.xxh3_64_intdigest(f"{c.kind}\0{c.key}\0{c.value}") - (1 << 63)))
        held.clear()

    for k, (text, path) in enumerate(texts):
        for c in candidates(text) if text else ():
            held.append((k, c, path))
            if len(held) >= 4096:
                settle()
    settle()
    return out


#: Weak labels look at shapes alone, which need no likelihood.
_NO_WORDS = Markov(np.zeros((_CODES, _CODES)))


def _columns(found: list[list[Lesson]], markov: Markov) -> Columns:
    """The labelled candidates of texts, each different one once."""
    rows = list(dict.fromkeys(x[1:] for own in found for x in own if x[4] >= 0))
    flags, names, labels, hashes = (np.array([x[k] for x in rows], np.int64) for k in range(1, 5))
    return numbers_of([x[0] for x in rows], markov), flags, names, labels, hashes


def fit(total: Callable[[Callable[..., np.ndarray]], np.ndarray], markov: Markov) -> Model:
    """Model from weakly labelled candidates, of which ``total`` gives the sum of any function of their columns; a fifth of
    them by hash is held out for calibration."""
    n = len(NUMERIC)
    sums = total(lambda numbers, flags, names, y, h: np.r_[len(y), y.sum(), (h % 5 == 4).sum(), y[h % 5 == 4].sum(), numbers.sum(0)])
    count, positive, held, held_positive = sums[:4]
    mean = sums[4:] / max(count, 1)
    deviation = np.sqrt(total(lambda numbers, *_: ((numbers - mean) ** 2).sum(0)) / max(count, 1)) + 1e-3
    model = Model(markov, mean, deviation, np.zeros(_WIDTH), 1.0, 0.0)
    if not 0 < positive - held_positive < count - held:
        return model

    def fitted(w: np.ndarray) -> np.ndarray:
        def slopes(numbers: np.ndarray, flags: np.ndarray, names: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
            own = h % 5 != 4
            return _slopes(_matrix(numbers[own], flags[own], names[own], mean, deviation), y[own], w)

        return total(slopes)

    model.weights = weights = _fit(fitted, np.zeros(_WIDTH), RIDGE)
    if 0 < held_positive < held:

        def calibrated(w: np.ndarray) -> np.ndarray:
            def slopes(numbers: np.ndarray, flags: np.ndarray, names: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
                own = h % 5 == 4
                z = _matrix(numbers[own], flags[own], names[own], mean, deviation) @ weights
                return _slopes(np.c_[z, np.ones(len(z))], y[own], w)

            return total(slopes)

        model.slope, model.shift = map(float, _fit(calibrated, np.array([1.0, 0.0]), 5.0))
        model.slope = max(model.slope, 0.05)
    return model


def train(texts: list[tuple[str, str]]) -> Model:
    """Model from (text, path) pairs held in memory; :func:`learn` does the same for tables."""
    made_up = lessons()
    markov = Markov(sum(transitions(t) for t, _ in [*made_up, *texts]))
    parts = [_columns(study(made_up), markov), _columns(study(texts), markov)]
    return fit(lambda f: sum(f(*columns) for columns in parts), markov)


#: (name, table, id column, text column, path column or None).
Source = tuple[str, DataFrame, str, str, str | None]
_READ = "tbl string, k bigint, t string, starts array<bigint>, found array<string>, flags array<bigint>, names array<bigint>, labels array<int>, hashes array<bigint>, cells array<int>, counts array<double>"


def gather(sources: list[Source], with_texts: bool = False) -> DataFrame:
    """One pass over all texts, each different row once: a written table of every row's candidates with their features and
    weak labels (all rows with their texts if asked, else those that have candidates), and the counts of character
    transitions of each task in rows of their own (``cells``).

    Rows without an id are not learned from.
    """
    rows = []
    for name, df, id_column, text_column, path_column in sources:
        place = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")
        rows.append(df.select(F.lit(name).alias("tbl"), F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"), place.alias("p")))
    texts = reduce(DataFrame.unionByName, rows)
    if not with_texts:
        texts = texts.where("k is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = [x.split()[0] for x in _READ.split(", ")]
        total, held, size = np.zeros((_CODES, _CODES)), [], 0
        for batch in batches:
            values = batch.column(2).to_pylist()
            for key, text in zip(batch.column(1).to_pylist(), values):
                if key is not None and text:
                    held.append(text)
                    size += len(text)
                    if size >= 1 << 20:
                        total += transitions("\n".join(held))
                        held, size = [], 0
            found = study(list(zip(values, batch.column(3).to_pylist())))
            if not with_texts:
                batch = batch.filter(pa.array([bool(x) for x in found], pa.bool_()))
                found = [x for x in found if x]
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
            flat = list(zip(*itertools.chain.from_iterable(found))) or [()] * 6
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, k)) for c, k in zip(flat, kinds)]
            n = len(found)
            kept = batch.column(2) if with_texts else pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, *lists, pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.float64()))], names)
        if held:
            total += transitions("\n".join(held))
        used = np.flatnonzero(total)
        nothing = [pa.nulls(1, k) for k in (pa.string(), pa.int64(), pa.string(), *map(pa.list_, kinds))]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([used], pa.list_(pa.int32())), pa.array([total.ravel()[used]], pa.list_(pa.float64()))], names)

    return durable(texts.distinct().mapInArrow(run, _READ))


def _total(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array of fixed size over all batches; only the sum comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(f(batch) for batch in batches)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["cell", "n"])

    found = df.mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(found))
    for cell, n in found:
        out[cell] = n
    return out


def learn_from(read: DataFrame) -> Model:
    """Model from all texts of :func:`gather`, with the made-up ones."""
    made_up = lessons()
    counts = sum(transitions(t) for t, _ in made_up)
    for cell, n in read.where("cells is not null").select(F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy("x.cells").agg(F.sum("x.counts").alias("n")).collect():
        counts[divmod(cell, _CODES)] += n
    markov = Markov(counts)
    own = _columns(study(made_up), markov)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = numbers_of(batch.column(0).to_pylist(), markov)
            ends = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * len(NUMERIC))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(numbers.ravel())), *batch.columns[1:]], ["numbers", "flags", "names", "labels", "hashes"])

    each = read.where("k is not null").select(F.explode(F.arrays_zip("found", "flags", "names", "labels", "hashes")).alias("x")).select("x.*").where("labels >= 0").distinct()
    found = durable(each.mapInArrow(measure, "numbers array<double>, flags bigint, names bigint, labels int, hashes bigint"))
    tasks = found.count() // LESSONS_OF_A_TASK + 1

    def total(f: Callable[..., np.ndarray]) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            numbers, *others = batch.columns
            return f(numbers.flatten().to_numpy().reshape(-1, len(NUMERIC)), *(c.to_numpy().astype(np.int64) for c in others))

        got = _total(found.coalesce(tasks), of)
        return f(*own) + got if len(got) else f(*own)

    model = fit(total, markov)
    drop_durable(found)
    return model


def learn(sources: list[tuple[DataFrame, str, str, str | None]], rows: int | None = None) -> Model:
    """Model from all texts of (table, id, text, path column) of each source; ``rows`` bounds the texts of each for trials
    (those of least hash)."""
    named = [(str(k), least_by_hash(df, id_column, rows) if rows is not None else df, id_column, *others) for k, (df, id_column, *others) in enumerate(sources)]
    read = gather(named)
    model = learn_from(read)
    drop_durable(read)
    return model


def found_in(read: DataFrame, model: Model) -> DataFrame:
    """``tbl, row_id, secret`` of a gathered table: one row per different credential of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, keys, found, flags, names = batch.columns
            owner = found.value_parent_indices()
            values = found.flatten()
            hit = pa.array(model.scores_of(values.to_pylist(), flags.flatten().to_pylist(), names.flatten().to_pylist()) >= THRESHOLD)
            owner = owner.filter(hit)
            yield pa.RecordBatch.from_arrays([tables.take(owner), keys.take(owner), values.filter(hit)], ["tbl", "row_id", "secret"])

    rows = read.where("k is not null and size(found) > 0").select("tbl", "k", "found", "flags", "names")
    return spread(rows).mapInArrow(run, "tbl string, row_id bigint, secret string").distinct()


def redacted_in(read: DataFrame, model: Model) -> DataFrame:
    """``tbl, row_id, text`` of a table gathered with its texts, credentials masked, for every row (null text stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, keys, texts, starts, found, flags, names = batch.columns
            scores = model.scores_of(found.flatten().to_pylist(), flags.flatten().to_pylist(), names.flatten().to_pylist())
            hits: dict[int, list[tuple[int, str]]] = {}
            for k, at, value, score in zip(found.value_parent_indices().to_pylist(), starts.flatten().to_pylist(), found.flatten().to_pylist(), scores):
                if score >= THRESHOLD:
                    hits.setdefault(k, []).append((at, value))
            masked = [_masked(t, hits[k]) if k in hits else t for k, t in enumerate(texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([tables, keys, pa.array(masked, pa.string())], ["tbl", "row_id", "text"])

    rows = read.where("cells is null").select("tbl", "k", "t", "starts", "found", "flags", "names")
    return spread(rows).mapInArrow(run, "tbl string, row_id bigint, text string")


def find(df: DataFrame, model: Model, *, id_column: str, text_column: str, path_column: str | None = None) -> DataFrame:
    """``row_id, secret``: one row per different credential of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for key, found in zip(batch.column(0).to_pylist(), model.secrets_of(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))):
                for value in dict.fromkeys(v for _, v in found):
                    ids.append(key)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["row_id", "secret"])

    place = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")
    rows = df.select(F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"), place.alias("p"))
    return spread(rows.where(F.col("k").isNotNull() & F.col("t").isNotNull())).mapInArrow(run, "row_id bigint, secret string").distinct()


def redact(text: str | None, model: Model, path: str = "", mask: str = "*") -> str | None:
    """The text with each credential's characters masked one for one (line breaks kept), so every offset still holds."""
    return _masked(text, model.secrets(text, path), mask) if text else text


def _masked(text: str, found: list[tuple[int, str]], mask: str = "*") -> str:
    out, at = [], 0
    for start, value in sorted(found):
        if start >= at:
            out += [text[at:start], "".join(c if c in "\r\n" else mask for c in value)]
            at = start + len(value)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, model: Model, *, id_column: str, text_column: str, path_column: str | None = None) -> DataFrame:
    """``row_id, text`` with credentials masked, for every row (null text stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = model.secrets_of(list(zip(texts, batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_masked(t, f) if f else t for t, f in zip(texts, found)], pa.string())], ["row_id", "text"])

    place = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")
    rows = df.select(F.col(id_column).cast("bigint").alias("row_id"), F.col(text_column).cast("string").alias("text"), place.alias("p"))
    return spread(rows).mapInArrow(run, "row_id bigint, text string")
