"""Evaluation passages inside a training corpus (problem 9).

The evaluation items are indexed with BM25 (term impacts of each item, posting lists in item order with block maxima).
Every passage of every document is a query; block-max WAND retrieves all items above a threshold and an exact word
comparison verifies them.  The threshold loses nothing: the impacts of an item are divided by the least sum of impacts
that any window of ``min_words`` of its words has, so a passage that holds such a window scores at least 1, and WAND
returns every item that scores 1 or more.

Passages are the longest stretches of words that all occur in some item (no leaked window can hold another word), cut
into overlapping pieces so that each window lies whole in a piece.

Defined cases: words are maximal runs of letters and digits, compared without case; null and empty texts and items of
fewer than ``min_words`` words leak nothing; repeated rows count once; an empty side gives an empty result; texts of any
length are read whole.  Items are taken in blocks of ``ITEM_BLOCK``, one index for each, so what is sent to the workers
is bounded however many items there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.text import spread

MIN_WORDS = 12
#: Items of one index; its size is bounded by that many item texts.
ITEM_BLOCK = 20_000
#: Words of a passage at most.
PASSAGE_WORDS = 40
_K1, _B, _POSTINGS = 1.2, 0.75, 16
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    return [w.casefold() for w in _WORD.findall(text or "")]


class Index:
    """BM25 inverted index of items with block maxima, impacts scaled so that 1 is each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        texts = {i: words(t) for i, t in sorted(items)}
        texts = {i: ws for i, ws in texts.items() if len(ws) >= min_words}
        self.ids = list(texts)
        self.terms: dict[str, int] = {}
        bags = [[self.terms.setdefault(w, len(self.terms) + 1) for w in ws] for ws in texts.values()]
        n, df = len(bags), Counter(t for bag in bags for t in set(bag))
        mean = sum(map(len, bags)) / n if n else 1.0
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.grams: list[set[tuple[int, ...]]] = []
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, bag in enumerate(bags):
            norm = _K1 * (1 - _B + _B * len(bag) / mean)
            impact = {t: idf[t] * f * (_K1 + 1) / (f + norm) for t, f in Counter(bag).items()}
            windows = {tuple(bag[i : i + min_words]) for i in range(len(bag) - min_words + 1)}
            least = min(sum(impact[t] for t in set(w)) for w in windows) * (1 - 1e-9)
            for t, x in impact.items():
                postings[t].append((k, x / least))
            self.grams.append(windows)
        self.lists = {}
        for t, p in postings.items():
            blocks = [p[i : i + _POSTINGS] for i in range(0, len(p), _POSTINGS)]
            self.lists[t] = ([k for k, _ in p], [x for _, x in p], max(x for _, x in p), [max(x for _, x in b) for b in blocks])

    def search(self, terms: set[int]) -> list[int]:
        """All items with a score of at least 1 for these terms, by block-max WAND."""
        end = len(self.ids)
        cursors = [[lst[0][0], 0, lst] for lst in (self.lists[t] for t in terms)]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += c[2][2]
                if bound >= 1.0:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # bound of the blocks in which the pivot item would stand, and the first item after the nearest block
            block_bound, next_item = 0.0, end if pivot + 1 == len(cursors) else cursors[pivot + 1][0]
            for c in cursors[: pivot + 1]:
                keys = c[2][0]
                at = c[1] - c[1] % _POSTINGS
                while at + _POSTINGS < len(keys) and keys[at + _POSTINGS - 1] < item:
                    at += _POSTINGS
                last = keys[min(at + _POSTINGS, len(keys)) - 1]
                if last >= item:
                    block_bound += c[2][3][at // _POSTINGS]
                    next_item = min(next_item, last + 1)
                elif at + _POSTINGS < len(keys):
                    next_item = min(next_item, keys[at + _POSTINGS])
            if block_bound < 1.0:
                target = max(next_item, item + 1)
            else:
                target = item + 1
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._seek(c, item, end)
                    if c[0] == item:
                        score += c[2][1][c[1]]
                if score >= 1.0:
                    found.append(item)
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    self._seek(c, target, end)

    @staticmethod
    def _seek(cursor: list, item: int, end: int) -> None:
        keys, at = cursor[2][0], cursor[1]
        while at + _POSTINGS < len(keys) and keys[at + _POSTINGS - 1] < item:
            at += _POSTINGS
        while at < len(keys) and keys[at] < item:
            at += 1
        cursor[1] = at
        cursor[0] = keys[at] if at < len(keys) else end

    def leaks(self, ids: list[int]) -> set[int]:
        """Numbers of the items that share a window with a text given as term ids (0: a word of no item)."""
        out: set[int] = set()
        size, step = self.min_words, PASSAGE_WORDS - self.min_words + 1
        n, start = len(ids), 0
        while start <= n - size:
            try:
                stop = ids.index(0, start)
            except ValueError:
                stop = n
            for a in range(start, max(start, stop - size + 1), step):
                passage = ids[a : min(a + PASSAGE_WORDS, stop)]
                candidates = [k for k in self.search(set(passage)) if k not in out]
                if candidates:
                    windows = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
                    out.update(k for k in candidates if not windows.isdisjoint(self.grams[k]))
            start = stop + 1
        return out


class _Terms(dict):
    """Memo from a word as written to its term id; words of no item are 0."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        found = self.terms.get(word.casefold(), 0)
        if len(self) < 500_000:
            self[word] = found
        return found


def leaks(documents: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs ``doc_id, item_id`` (of the items that share at least ``min_words`` consecutive words)."""
    asked = items.select(F.col(item_column).cast("bigint").alias("item"), F.col(item_text_column).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    blocks = max(1, -(-asked.count() // ITEM_BLOCK))
    if blocks > 1:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    rows = spread(documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("text is not null"))
    parts = []
    for b in range(blocks):
        block = asked.where(F.col("block") == b) if blocks > 1 else asked
        index = documents.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in block.collect()], min_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            memo = _Terms(own.terms)
            for batch in batches:
                docs, found = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = list(map(memo.__getitem__, _WORD.findall(text.as_py())))
                    for k in own.leaks(ids) if len(ids) >= min_words else ():
                        docs.append(doc)
                        found.append(own.ids[k])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        parts.append(rows.mapInArrow(run, "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, parts).distinct()
