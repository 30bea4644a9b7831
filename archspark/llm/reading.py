"""Reading level of each prose document (problem 10).

Running text is what is left when code, logs, traces, tables, data, headings and markup are taken off.  Features of it -
length of words and sentences, share of long words, lexical diversity, rarity of its words in the whole corpus,
connectives, a clause-depth proxy - feed a regularised ordinal regression (cumulative logit) fitted to the graded
sample.  Word counts are taken over all documents, in a fixed number of hashed buckets, so what is sent to the workers
does not grow with the corpus.

Defined cases: null, empty and blank texts, texts of fewer than ``MIN_WORDS`` words of running text and texts mainly in
another language have no grade; grades outside 1 to 5, of unknown documents or null are ignored; a document graded
several times counts with its mean; without any usable grade there is no model and no result; repeated rows count once;
texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.pairs import FUNCTION_WORDS
from archspark.llm.text import least_by_hash, spread

MIN_WORDS = 60
#: Graded documents the regression is fitted to at most (those of least hash).
TRAIN_GRADES = 20_000
BUCKETS = 1 << 16

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)|<(pre|code|script|style|table)\b.*?</\2>")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&\w{1,8};|<!--.*?-->", re.S)
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_NO_PROSE = re.compile(r"[ \t]*(?:\||[{\[\"']?\{|\}|\+[-=+]{3,}|[-=~_*]{4,}\s*$|\d{4}-\d\d-\d\d[T ]|\d\d:\d\d:\d\d|\[?(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL)\b|Traceback |  File \"|at [\w.$]+\(|[A-Za-z.]*(?:Error|Exception)\b:)")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:def |class \w+[:(]|@\w+|#include|#pragma|import \w+(?:$|\.| as)|from [\w.]+ import|return\b[^.]*;?$|(?:if|for|while|elif|else|try|except|with)\b.*:\s*$|(?:if|for|while|switch) ?\(.*|//|/\*|\*/|namespace |std::|auto |const |#\s)|(?:==|!=|->|::|\+=|&&|\|\|)|\w\(.*\)\s*[;:]?\s*$|^\s*[\w.\[\]]+ = |\w+_\w+\(")
_ASIDE = re.compile(r"\((?:see|cf\.|approx\.|e\.g\.|i\.e\.)[^()]*(?:\([^()]*\)[^()]*)*\)|\[#?\d+\]|`[^`\n]*`|https?://\S+|(?<![\w./\\-])[\w.\\-]*+/[\w./\\-]++|\b\w+_\w+\b(?:\(\))?|\bv?\d[\d.,]*(?: ?ms| ?%| ?KB| ?MB)?\b")
_CODE_SIGNS = re.compile(r"[;{}=&|#@:(/]|^\s*(?:import|return|from|class|def|auto|const|namespace)\b")
_ASIDE_SIGNS = re.compile(r"[\d_`/]|\((?:see|cf|approx|e\.g|i\.e)")
_CODE_START = re.compile(r"[ \t]*(?:(?:async )?def \w+ ?\(|class \w+ ?[(:{]|#include|#pragma|/\*|//|template ?<|namespace \w+ ?\{)")
_INDENTS = frozenset(("  ", "\t\t", "\t ", " \t"))
_BREAK = re.compile(r"(?i)</?(?:p|li|div|br|h\d|ul|ol|tr)\b[^<>]*>")
_BLANK = re.compile(r"\n[ \t]*\n")
_STOP = re.compile(r"[.!?]['\")\]]*\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
#: English connectives that open a clause or link two.
CONNECTIVES = frozenset(
    "because although though unless whereas while whenever when since if whether which that who whose whom where so therefore thus hence however moreover furthermore nevertheless consequently but yet or nor after before until once as provided despite".split()
)
_SUBORDINATE = frozenset("because although though unless whereas while whenever when since if whether which that who whose whom where until once".split())
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
FEATURES = ("word_length", "long_words", "syllables", "sentence_length", "log_sentence", "spread", "diversity", "rarity", "rare_words", "connectives", "subordinate", "commas", "clause_depth")


def sentences(text: str) -> list[str]:
    """Sentences and list items of the running text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text or "</" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _BREAK.sub("\n\n", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    out: list[str] = []
    after_code = False
    for block in _BLANK.split(text):
        lines = [x for x in block.split("\n") if x.strip()]
        kept = [x for x in lines if not _NO_PROSE.match(x)]
        if not kept:
            continue
        bodies = [_ITEM.sub("", x, count=1) if _ITEM.match(x) else x for x in kept]
        if _CODE_START.match(lines[0]) or after_code and all(x[:2] in _INDENTS for x in lines):  # a body or docstring goes on
            after_code = True
            continue
        codey = sum(bool(_CODE_SIGNS.search(b) and _CODE.search(b) and _CODE.search(_ASIDE.sub(" ", b))) for b in bodies)
        after_code = codey > 0.4 * len(bodies)
        if after_code:
            continue
        units: list[str] = []
        for raw, body in zip(kept, bodies):
            if re.match(r"[ \t]*#{1,6}[ \t]", raw) or re.match(r"[ \t]*>?[ \t]*$", raw):
                units.append("")
            elif _ITEM.match(raw) or not units or units[-1] == "":
                units.append(body.strip())
            else:
                units[-1] += " " + body.strip()
        for unit in units:
            if _ASIDE_SIGNS.search(unit):
                unit = _ASIDE.sub(" ", unit)
            for s in _SENTENCE.split(unit):
                words = len(s.split())
                if words >= 3 and not (len(units) == 1 and words <= 7 and not _STOP.search(s)):  # else a heading
                    out.append(s)
    return out


def _bucket(word: str, memo: dict[str, int] = {}) -> int:  # noqa: B006 - a memo of the process
    found = memo.get(word)
    if found is None:
        h = 2166136261
        for c in word.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        if len(memo) > 200_000:
            memo.clear()
        found = memo[word] = h % BUCKETS
    return found


class Lexicon(dict):
    """What is known of each word, as columns that a text's word numbers select; a text that might not fit begins anew."""

    def __init__(self, rarity: np.ndarray, size: int = 1 << 18) -> None:
        super().__init__()
        self.rarity, self.SIZE = rarity, size
        self.columns = np.zeros((self.SIZE, 7), np.float32)  # length, long, syllables, rarity, rare, connective, subordinate
        self.languages = np.zeros((self.SIZE, len(_SETS)), np.int16)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        low = word.lower()
        rare = self.rarity[_bucket(low)]
        self.columns[at] = len(word), len(word) >= 9, len(_VOWELS.findall(low)), rare, rare > 9.0, low in CONNECTIVES, low in _SUBORDINATE
        self.languages[at] = [low in x for x in _SETS.values()]
        return at


_VOWELS = re.compile(r"[aeiouy]+")


def features(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """The features of a document's running text, None if it has too little of it or not in English."""
    if len(text) < 2 * MIN_WORDS:
        return None
    most = len(text) // 2 + 1  # different words it can have
    if most > lexicon.SIZE:  # a text that could fill the lexicon gets its own
        lexicon = Lexicon(lexicon.rarity, most)
    elif len(lexicon) + most > lexicon.SIZE:
        lexicon.clear()
    parts = [p for p in map(_WORD.findall, sentences(text)) if p]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    n = int(lengths.sum())
    if n < MIN_WORDS:
        return None
    ids = [lexicon[w] for p in parts for w in p]
    at = np.array(ids)
    votes = np.add.reduceat(lexicon.languages[at], np.r_[0, np.cumsum(lengths)[:-1]])
    best = votes.argmax(1)
    voted = votes.max(1) > 0
    english = lengths[voted & (best == 0)].sum()
    if not english or english < 0.5 * lengths[voted].sum():
        return None
    windows = [*range(0, max(1, n - 49), 50), *([n - 50] if n > 50 and n % 50 else [])]  # the last one over the final 50 words
    diversity = sum(len(set(ids[i : i + 50])) / len(ids[i : i + 50]) for i in windows) / len(windows)
    size, long, syllables, rare, rarest, linked, below = (lexicon.columns[at].sum(0, dtype=np.float64) / n).tolist()
    k, commas = len(parts), text.count(",")
    mean = n / k
    spread_of = math.sqrt(max(0.0, float(lengths @ lengths) / k - mean * mean)) / mean
    return np.array([
        size, long, syllables, mean, math.log(mean), spread_of, diversity,
        rare, rarest, linked, below * mean, commas / k, (below + linked) * mean,
    ])


@dataclass
class Model:
    """Cumulative logit: P(grade <= k) = sigmoid(cut[k] - x w)."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray
    rarity: np.ndarray

    def grade(self, x: np.ndarray) -> int:
        """The most likely grade."""
        z = self.cuts - (x - self.mean) / self.deviation @ self.weights
        below = np.r_[0.0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1.0]
        return int(self.grades[int(np.argmax(np.diff(below)))])


def fit(x: np.ndarray, y: np.ndarray, rarity: np.ndarray, strength: float = 0.002) -> Model:
    """Ordinal regression by gradient steps (Adam) on the penalised likelihood; cuts stay ordered by their gaps' logs."""
    grades = np.unique(y)
    k = np.searchsorted(grades, y)
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / deviation
    n, d = z.shape
    classes = len(grades)
    share = np.cumsum(np.bincount(k, minlength=classes)) / n
    start = np.log(share[:-1] / (1 - share[:-1] + 1e-9) + 1e-9) * 2
    theta = np.r_[np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 0.1))] if classes > 1 else np.zeros(d)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 1501):
        w = theta[:d]
        gaps = np.exp(theta[d + 1 :])
        cuts = theta[d] + np.r_[0.0, np.cumsum(gaps)] if classes > 1 else np.zeros(0)
        s = z @ w
        upper = np.r_[cuts, 40.0][k] - s
        lower = np.r_[-40.0, cuts][k] - s
        a, b = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_cut = np.zeros(classes + 1)
        np.add.at(g_cut, k + 1, -da)
        np.add.at(g_cut, k, db)
        g_cut = g_cut[1:-1] / n if classes > 1 else np.zeros(0)
        gradient = np.r_[z.T @ (da - db) / n + strength * w]
        if classes > 1:
            gradient = np.r_[gradient, g_cut.sum(), [gaps[i] * g_cut[i + 1 :].sum() for i in range(classes - 2)]]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta - 0.03 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    cuts = theta[d] + np.r_[0.0, np.cumsum(np.exp(theta[d + 1 :]))] if classes > 1 else np.zeros(0)
    return Model(mean, deviation, theta[:d], cuts, grades, rarity)


def rarity_of(df: DataFrame, text_column: str = "text") -> np.ndarray:
    """-log share of each word bucket over all documents (an array of ``BUCKETS`` numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                counts.update(_ASCII_WORD.findall(text.as_py().lower()))
            for word, n in counts.items():
                totals[_bucket(word)] += n
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used], pa.int64())], ["bucket", "n"])

    rows = spread(df.select(F.col(text_column).cast("string").alias("t")).where("t is not null"))
    out = np.zeros(BUCKETS)
    for r in rows.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return np.log(out.sum() + BUCKETS) - np.log(out + 1)


def train(documents: DataFrame, labels: DataFrame, rarity: np.ndarray, limit: int = TRAIN_GRADES) -> Model | None:
    """Model fitted to the graded documents."""
    graded = labels.where("grade between 1 and 5 and doc_id is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    graded = least_by_hash(graded, "doc_id", limit)
    texts = documents.where("text is not null").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(rarity)
        for batch in batches:
            xs, ys = [], []
            for grade, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = features(text, lexicon)
                if x is not None:
                    xs.append(x.tolist())
                    ys.append(grade)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["x", "y"])

    rows = texts.join(F.broadcast(graded), "doc_id").dropDuplicates(["doc_id"]).select("grade", "text").mapInArrow(run, "x array<double>, y double").collect()
    if not rows:
        return None
    return fit(np.array([r["x"] for r in rows]), np.rint([r["y"] for r in rows]).astype(int), rarity)


def grades(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of each prose document."""
    rarity = rarity_of(documents)
    model = train(documents, labels, rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Lexicon(own.rarity) if own else None
        for batch in batches:
            ids, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = features(text.as_py(), lexicon) if own else None
                if x is not None:
                    ids.append(key)
                    found.append(own.grade(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32())], ["doc_id", "grade"])

    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return spread(rows).mapInArrow(run, "doc_id bigint, grade int").dropDuplicates(["doc_id"])
