"""Defective pairs of prompt and response (problem 6).

Each pair gets at most one defect, tried in this order:

* ``empty``: no response, or one without content, and no ``error``;
* ``copy``: nearly all word triples of the response stand in the request or the prompt;
* ``refusal``: the first sentence declines and the rest brings nothing about the subject;
* ``language``: the language posteriors of request and response differ (character n-gram naive Bayes over the prose;
  its classes are labelled weakly by function words), unless the request names the response's language;
* ``truncated``: the likelihood of the text's last n-gram as an end of text is not clearly higher than as an inner place, or a fence,
  quote or bracket is left open.  Both likelihoods are learned from the responses themselves: their ends, and cuts at
  every place within them.

Both models are trained on all pairs with a response: language counts are summed up in tasks, and n-grams are counted and
looked up by joins, so neither is held whole by any process (:func:`found`; :func:`train` does the same in memory).

Defined cases: a null response with an error is a failed call and no pair; a null request is compared by the prompt
alone and has no language; null ids give nothing; rows repeated count once; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.text import least_by_hash, spread
from archspark.session import drop_durable, durable

#: Rows of a sample for trials in memory; the query does not use it.
TRAIN_ROWS = 5_000
#: N-grams a task counts before it hands its counts on.
GRAMS_AT_ONCE = 500_000
_DIM = 1 << 15
#: Characters of prose from which a text is learned from.
LEAST_PROSE = 15
#: Log of how much likelier an end than an inner place a text's last n-gram must be for the text to be whole.
WHOLE = 1.5

#: Frequent function words of each language, for weak labels only.
FUNCTION_WORDS = {
    "en": "the of and to is that which in for not with be are it as on this from was have".split(),
    "de": "der die das und nicht mit ist ein eine sich auf bei zu den werden sie wir ohne lässt wie".split(),
    "fr": "le la les des une est pas avec il que pour dans du sur au nous et sans plus trop".split(),
    "es": "el los las una es con que por hay del se como sin más para hacia porque antes qué hay".split(),
    "pt": "os uma é com que por há do da não para mais sem ser antes depois deve dos das pelo".split(),
    "it": "il gli una è con che per del della non sono più di nel alla questo anche deve".split(),
    "nl": "het een van is niet met dat voor zijn op te en bij naar wordt ook deze maar".split(),
}
#: Names of languages as a request may give them.
LANGUAGE_NAMES = {
    "en": r"english|englisch|anglais|inglés|inglese|inglês|engels",
    "de": r"german|deutsch|allemand|alemán|tedesco|alemão|duits",
    "fr": r"french|französisch|français|francés|francese|francês|frans",
    "es": r"spanish|spanisch|espagnol|español|spagnolo|espanhol|spaans",
    "pt": r"portuguese|portugiesisch|portugais|portugués|portoghese|português|portugees",
    "it": r"italian|italienisch|italien|italiano|italiaans",
    "nl": r"dutch|niederländisch|néerlandais|neerlandés|olandese|holandês|nederlands",
}
_NAMED = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in LANGUAGE_NAMES.items()}
_REFUSAL = re.compile(
    r"\b(?:sorry\b(?! for)|apologi[sz]e\b|unfortunately\b|regrettably\b|i am unable|i'm unable|unable to (?:assist|help|answer|comply|provide)|not able to|can(?:'|’)?t (?:help|assist|answer|comply|discuss|provide)|"
    r"cannot (?:help|assist|answer|comply|provide|discuss|comment|be given)|won(?:'|’)t be able|will not be able|must decline|have to decline|i decline|(?:would|'d) rather not|(?:do not|don(?:'|’)t) feel comfortable|"
    r"guidelines (?:do not|don(?:'|’)t)|not allow(?:ed)? (?:me )?to|falls outside|outside (?:of )?what i (?:may|can)|against my|no answer can be given|refuse to|not something i|"
    r"tut mir leid|leider|kann (?:ich )?.{0,40}nicht (?:helfen|beantworten|unterstützen)|désolée?|je ne peux (?:pas )?|je regrette|lo siento|lamento|no puedo (?:ayudar|responder)|desculp|não posso (?:ajudar|responder)|mi dispiace|non posso|het spijt me)",
    re.I,
)
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)")
_CODE = re.compile(r"`[^`\n]*`|(?<![\w./\\-])[\w.\\-]*+/[\w./\\-]++|\b(?=\w+?_\w)\w++|\b\w++\(\)?|https?://\S+|\b\w*\d\w*\b|[A-Z]\w*[A-Z]\w*")
_WORD = re.compile(r"\w+", re.UNICODE)
_NOTHING = re.compile(r"(?:null|none|nil|n\s*/?\s*a|nan|undefined|(?:final )?(?:answer|response|output|result|reply)|no (?:content|answer|response|output)|empty|tbd|todo|text|json|python|cpp)*", re.I)


def is_empty(response: str | None) -> bool:
    """No word of content: nothing, signs only, empty tags or containers, or a word that stands for nothing."""
    if response is None:
        return True
    bare = re.sub(r"<[^<>]*>", " ", response)
    return bool(_NOTHING.fullmatch(re.sub(r"[\W_]+", "", bare))) or bool(_NOTHING.fullmatch(" ".join(re.findall(r"[^\W_]+", bare))))


def prose(text: str | None) -> str:
    """The text without code, paths, names and numbers, in lower case."""
    return " ".join(re.sub(r"[^\w'’¿¡?]+", " ", _CODE.sub(" ", _FENCE.sub(" ", text or ""))).lower().split())


def is_copy(response: str, request: str | None, prompt: str | None) -> bool:
    """At least 0.6 of the response's word triples stand in the request or the prompt, in a response of at least 4 words."""
    words = [w.lower() for w in _WORD.findall(response)]
    if len(words) < 4:
        return bool(words) and request is not None and words == [w.lower() for w in _WORD.findall(request)]
    known: set = set()
    for source in (request, prompt):
        w = [x.lower() for x in _WORD.findall(source or "")]
        known.update(zip(w, w[1:], w[2:]))
    triples = list(zip(words, words[1:], words[2:]))
    return sum(t in known for t in triples) >= 0.6 * len(triples)


def is_refusal(response: str) -> bool:
    """Declines in its first sentence and says nothing of the subject after it."""
    text = response.strip()
    first = re.match(r".*?(?:[.!?](?=\s)|\n|\Z)", text, re.S)[0]
    rest = text[len(first) :].strip()
    if not _REFUSAL.search(first) or len(first.split()) > 40:
        return False
    return not _CODE.search(rest) and "`" not in rest and len(rest.split()) <= 40


class Languages:
    """Naive Bayes over hashed character 1- to 3-grams of prose."""

    def __init__(self) -> None:
        self.names = list(FUNCTION_WORDS)
        self.counts = np.zeros((len(self.names), _DIM))
        self.logp = np.zeros((len(self.names), _DIM))

    @staticmethod
    def grams(text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        one = codes * np.uint64(2654435761)
        two = (codes[:-1] * np.uint64(40503) + codes[1:]) * np.uint64(2654435761) + np.uint64(1)
        three = ((codes[:-2] * np.uint64(40503) + codes[1:-1]) * np.uint64(40503) + codes[2:]) * np.uint64(2654435761) + np.uint64(2)
        mixed = np.concatenate([one, two, three])
        return ((mixed ^ (mixed >> np.uint64(17))) % np.uint64(_DIM)).astype(np.int64)

    def fit(self, texts: list[str]) -> None:
        """Weak labels by function words, then once more by the model's own posteriors."""
        self.take(self.count(texts, weak_language))
        self.take(self.count(texts, self.sure))

    def sure(self, text: str) -> int | None:
        return self.best(text, 3.0) if len(text) >= 30 else None

    @classmethod
    def count(cls, texts: list[str], label: Callable[[str], int | None]) -> np.ndarray:
        """Grams of the texts of each class."""
        counts = np.zeros((len(FUNCTION_WORDS), _DIM))
        for text in texts:
            k = label(text)
            if k is not None:
                counts[k] += np.bincount(cls.grams(text), minlength=_DIM)
        return counts

    def take(self, counts: np.ndarray) -> None:
        """The model of these counts."""
        self.counts = counts.copy()
        for name, words in FUNCTION_WORDS.items():  # a class without texts knows its function words
            np.add.at(self.counts[self.names.index(name)], self.grams(" ".join(words)), 1.0)
        smooth = self.counts + 0.05
        self.logp = np.log(smooth / smooth.sum(1, keepdims=True))

    def scores(self, text: str) -> np.ndarray:
        """Log posteriors up to a constant."""
        return self.logp[:, self.grams(text)].sum(1)

    def best(self, text: str, margin: float = 0.0) -> int | None:
        if not text:
            return None
        s = self.scores(text)
        order = np.argsort(s)
        return int(order[-1]) if s[order[-1]] - s[order[-2]] >= margin else None

    def differ(self, request: str | None, asked: str, answered: str) -> bool:
        """Whether the prose of a request and of its response are of two languages, the second one not asked for."""
        if len(asked) < 12 or len(answered) < 20 or len(answered.split()) < 4:
            return False
        a, b = self.scores(asked), self.scores(answered)
        i, k = int(np.argmax(a)), int(np.argmax(b))
        if i == k or _NAMED[self.names[k]].search(request):
            return False
        # both posteriors must be clear, and neither text may pass for the other's language
        return bool(a[i] - a[k] > 2.0 and b[k] - b[i] > 0.05 * len(answered))


_SETS = [frozenset(v) for v in FUNCTION_WORDS.values()]


def weak_language(text: str) -> int | None:
    """The class whose function words clearly prevail."""
    words = text.split()
    votes = [sum(w in s for w in words) for s in _SETS]
    best = int(np.argmax(votes))
    second = sorted(votes)[-2]
    return best if votes[best] >= 2 and votes[best] >= 2 * second and votes[best] >= 0.08 * len(words) else None


_PIECE = re.compile(r"```|~~~|(?<![\w./\\-])[\w.\\-]*+/[\w./\\-]++|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+(?:\.\d+)?|\w+|\n+|[^\w\s]", re.UNICODE)


def pieces(text: str) -> list[str]:
    """Words, classes of names, numbers and paths, and signs."""
    out = []
    for p in _PIECE.findall(text):
        if p[0] == "\n":
            out.append("<nl>")
        elif "/" in p and len(p) > 1:
            out.append("<path>")
        elif p[0].isdigit():
            out.append("<num>")
        elif "_" in p or any(c.isdigit() for c in p):
            out.append("<name>")
        else:
            out.append(p.lower())
    return out


def _kind(piece: str) -> str:
    return "<word>" if piece[:1].isalpha() else piece


@dataclass
class Ends:
    """Likelihood of the last pieces of a text as an end against as an inner place, with back-off 3, 2, 1, kind."""

    end: list[Counter] = field(default_factory=lambda: [Counter() for _ in range(4)])
    inner: list[Counter] = field(default_factory=lambda: [Counter() for _ in range(4)])
    ends: int = 0
    inners: int = 0

    @staticmethod
    def keys(p: list[str], at: int) -> list:
        tail = ["<s>", "<s>", *p[max(0, at - 3) : at]][-3:]
        return [_kind(tail[-1]), tail[-1], tuple(tail[-2:]), tuple(tail)]

    def fit(self, texts: list[str], levels: int = 3) -> None:
        for text in texts:
            p = pieces(text.rstrip())
            if not p:
                continue
            padded = ["<s>", "<s>", *p]
            grams = ([_kind(x) for x in p], p, list(zip(padded[1:], p)), list(zip(padded, padded[1:], p)))
            for level, keys in enumerate(grams[: levels + 1]):
                self.inner[level].update(keys[:-1])
                self.end[level][keys[-1]] += 1
            self.ends += 1
            self.inners += len(p) - 1

    def fit_clean(self, texts: list[str]) -> None:
        """Fit, then fit again without the texts whose last piece is of a kind that mostly stands within texts: they are
        cut themselves and would teach their cuts as ends."""
        self.fit(texts, levels=0)
        whole = [t for t in texts if not left_open(t) and self.ratio(t, levels=0) >= 0.0]
        self.__init__()
        self.fit(whole)

    def ratio(self, text: str, levels: int = 3) -> float:
        """Log of the last n-gram's likelihood as an end over its likelihood as an inner place (odds over prior odds)."""
        p = pieces(text.rstrip())
        if not p:  # nothing to go by
            return math.inf
        return end_ratio([(self.end[level][key], self.inner[level][key]) for level, key in enumerate(self.keys(p, len(p))[: levels + 1])], self.ends, self.inners)


def end_ratio(counts: list[tuple[int, int]], ends: int, inners: int) -> float:
    """Log ratio from the (end, inner) counts of each level, the shortest n-gram first, and of all places."""
    if not ends:
        return math.inf
    prior = ends / (ends + inners)
    at_end = prior
    for e, i in counts:
        at_end = (e + 5.0 * at_end) / (e + i + 5.0)  # each level leans on the one before with five observations
    return math.log(at_end / (1 - at_end)) - math.log(prior / (1 - prior)) if 0 < at_end < 1 and 0 < prior < 1 else math.inf


def left_open(text: str) -> bool:
    """A code fence, an inline code span or a bracket at the end of the prose is not closed."""
    fences = re.findall(r"(?m)^[ \t]*(```|~~~)", text)
    for mark in ("```", "~~~"):
        if fences.count(mark) % 2:
            return True
    tail = _FENCE.sub(" ", text).rstrip().rpartition("\n")[2]
    return tail.count("`") % 2 == 1 or tail.count("(") > tail.count(")")


@dataclass
class Model:
    languages: Languages
    ends: Ends

    def is_other_language(self, request: str | None, response: str) -> bool:
        return self.languages.differ(request, prose(request), prose(response))

    def is_truncated(self, response: str) -> bool:
        return left_open(response) or self.ends.ratio(response) < WHOLE

    def defect(self, request: str | None, prompt: str | None, response: str | None, error: str | None) -> str | None:
        if is_empty(response):
            return "empty" if error is None else None
        if is_copy(response, request, prompt):
            return "copy"
        if is_refusal(response):
            return "refusal"
        if self.is_other_language(request, response):
            return "language"
        return "truncated" if self.is_truncated(response) else None


def train(rows: list[tuple[str | None, str | None]]) -> Model:
    """Both models from (request, response) pairs."""
    languages, ends = Languages(), Ends()
    languages.fit([p for pair in rows for t in pair if len(p := prose(t)) >= LEAST_PROSE])
    ends.fit_clean([r for q, r in rows if not is_empty(r) and not is_copy(r, q, None) and not is_refusal(r)])
    return Model(languages, ends)


def sample(df: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str | None, str | None]]:
    """The rows of least hash, each id once."""
    part = least_by_hash(df.select("id", "request", "response").where("response is not null"), "id", rows)
    return [(r["request"], r["response"]) for r in part.collect()]


def defects(df: DataFrame, model: Model) -> DataFrame:
    """``id, defect`` of each defective pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for key, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                d = model.defect(*texts)
                if d:
                    ids.append(key)
                    found.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "defect"])

    rows = df.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("request", "prompt", "response", "error")]).where("id is not null")
    return spread(rows).mapInArrow(run, "id bigint, defect string").dropDuplicates(["id"])


_STUDY = "id bigint, fate string, request string, asked string, answered string, open boolean, a string, b string, c string, kind string, tail string, ends bigint, inners bigint, cells array<int>, counts array<double>"
_STUDY_NAMES = [x.split()[0] for x in _STUDY.split(", ")]
_STUDY_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}[x.split()[1]] for x in _STUDY.split(", ")]


def _batch(n: int, **columns: list) -> pa.RecordBatch:
    """A batch of the study; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(_STUDY_NAMES, _STUDY_TYPES)], _STUDY_NAMES)


def _cells(counts: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(counts)
    return _batch(1, cells=[used], counts=[counts.ravel()[used]])


def _fate(request: str | None, prompt: str | None, response: str | None, error: str | None) -> str | None:
    """The defect that no model is needed for; "none" for a failed call, null where the models decide."""
    if is_empty(response):
        return "empty" if error is None else "none"
    if is_copy(response, request, prompt):
        return "copy"
    return "refusal" if is_refusal(response) else None


def _study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its fate, prose and last n-gram; in rows of their own the trigrams of the texts that ends are learned from,
    by whether a text is left open and the kind of its last piece (``tail``), and the grams of weakly labelled prose."""
    counts = np.zeros((len(FUNCTION_WORDS), _DIM))
    inner: dict[tuple[bool, str], Counter] = {}
    end: dict[tuple[bool, str], Counter] = {}
    held = 0

    def grams() -> pa.RecordBatch:
        rows = [(left, tail, *gram, _kind(gram[2]), end[left, tail][gram], inner[left, tail][gram]) for left, tail in end for gram in end[left, tail].keys() | inner[left, tail].keys()]
        left, tail, a, b, c, kind, ends, inners = map(list, zip(*rows)) if rows else ([],) * 8
        end.clear()
        inner.clear()
        return _batch(len(rows), open=left, tail=tail, a=a, b=b, c=c, kind=kind, ends=ends, inners=inners)

    for batch in batches:
        out = []
        for key, request, prompt, response, error in zip(*(c.to_pylist() for c in batch.columns)):
            fate = _fate(request, prompt, response, error)
            row = [key, fate, request, None, None, None, None, None, None, None]
            out.append(row)
            if response is None:
                continue
            row[3], row[4] = asked, answered = prose(request), prose(response)
            for text in (asked, answered):
                if len(text) >= LEAST_PROSE and (k := weak_language(text)) is not None:
                    counts[k] += np.bincount(Languages.grams(text), minlength=_DIM)
            if fate and not (fate == "copy" and not is_copy(response, request, None) and not is_refusal(response)):
                continue
            row[5] = left = left_open(response)
            p = pieces(response.rstrip())
            if not p:
                continue
            padded = ["<s>", "<s>", *p]
            of = left, _kind(p[-1])
            places = list(zip(padded, padded[1:], p))
            inner.setdefault(of, Counter()).update(places[:-1])
            end.setdefault(of, Counter())[places[-1]] += 1
            row[6:10] = *places[-1], of[1]
            held += len(p)
            if held >= GRAMS_AT_ONCE:
                yield grams()
                held = 0
        columns = list(map(list, zip(*out))) or [[]] * 10
        yield _batch(len(out), **dict(zip(("id", "fate", "request", "asked", "answered", "open", "a", "b", "c", "kind"), columns)))
    yield grams()
    yield _cells(counts)


def _summed(df: DataFrame) -> np.ndarray:
    """Grams of each language, of the tasks' counts."""
    each = df.where("cells is not null").select(F.explode(F.arrays_zip("cells", "counts")).alias("x"))
    got = each.groupBy(F.col("x.cells").alias("cell")).agg(F.sum("x.counts").alias("n")).toArrow()
    out = np.zeros(len(FUNCTION_WORDS) * _DIM)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(-1, _DIM)


def _languages(study: DataFrame) -> Languages:
    """The language model of all pairs: grams under weak labels, then once more under the model's own."""
    first = Languages()
    first.take(_summed(study))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(FUNCTION_WORDS), _DIM))
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    if text and len(text) >= LEAST_PROSE and (k := first.sure(text)) is not None:
                        counts[k] += np.bincount(first.grams(text), minlength=_DIM)
        yield _cells(counts)

    last = Languages()
    last.take(_summed(spread(study.where("id is not null and answered is not null").select("asked", "answered")).mapInArrow(again, _STUDY)))
    return last


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("ends").alias("ends"), F.sum("inners").alias("inners"))


def _rated(df: DataFrame, keys: list[str], levels: int, ends: int, inners: int) -> DataFrame:
    """``keys, ratio`` from columns ``e0, i0, e1, ...`` of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([c.to_numpy() for c in batch.columns[len(keys) :]]).T.reshape(batch.num_rows, levels, 2).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([end_ratio(x, ends, inners) for x in counts], pa.float64())], [*keys, "ratio"])

    numbers = [F.coalesce(F.col(f"{x}{k}"), F.lit(0)).alias(f"{x}{k}") for k in range(levels) for x in "ei"]
    return df.select(*keys, *numbers).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", ratio double")


def _totals(df: DataFrame) -> tuple[int, int]:
    ends, inners = df.agg(F.sum("ends"), F.sum("inners")).first()
    return int(ends or 0), int(inners or 0)


def _cut_ends(study: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, c`` of each last n-gram that is no likely end, and the written table it is found by.

    As in :meth:`Ends.fit_clean`: texts left open, or that end in a kind of piece that mostly stands within texts, are not
    learned from.
    """
    grams = study.where("ends is not null")
    kinds = _sums(grams, "kind").withColumnsRenamed({"ends": "e0", "inners": "i0"})
    ending = _rated(kinds, ["kind"], 1, *_totals(grams)).where("ratio >= 0").select(F.col("kind").alias("tail"))
    whole = durable(_sums(grams.where("not open").join(ending, "tail", "left_semi"), "a", "b", "c", "kind"))
    tails = study.where("id is not null and c is not null").select("a", "b", "c", "kind").distinct()
    for k, by in enumerate((["kind"], ["c"], ["b", "c"], ["a", "b", "c"])):
        tails = tails.join(_sums(whole, *by).withColumnsRenamed({"ends": f"e{k}", "inners": f"i{k}"}), by, "left")
    return _rated(tails, ["a", "b", "c"], 4, *_totals(whole)).where(F.col("ratio") < WHOLE).select("a", "b", "c"), whole


def found(df: DataFrame) -> DataFrame:
    """``id, defect`` of each defective pair, the models learned from all pairs."""
    texts = [F.col(c).cast("string").alias(c) for c in ("request", "prompt", "response", "error")]
    rows = df.select(F.col("id").cast("bigint").alias("id"), *texts).where("id is not null").distinct()
    study = durable(rows.mapInArrow(_study, _STUDY))
    languages = _languages(study)
    cut, whole = _cut_ends(study)
    cut = durable(cut.withColumn("cut", F.lit(True)))
    drop_durable(whole)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fates, requests, asked, answered, left, *last = batch.columns
            out = []
            for fate, *texts, is_left in zip(*(c.to_pylist() for c in (fates, requests, asked, answered, left))):
                out.append(fate or ("language" if languages.differ(*texts) else "truncated" if is_left else None))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), *last], ["id", "defect", "a", "b", "c"])

    own = study.where("id is not null and (fate is null or fate != 'none')").select("id", "fate", "request", "asked", "answered", "open", "a", "b", "c")
    judged = spread(own).mapInArrow(judge, "id bigint, defect string, a string, b string, c string")
    defect = F.coalesce("defect", F.when(F.col("cut"), "truncated")).alias("defect")
    return judged.join(cut, ["a", "b", "c"], "left").select("id", defect).where("defect is not null").dropDuplicates(["id"])
