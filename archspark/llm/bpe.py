"""Encoding with a public byte-level BPE vocabulary (problem 8).

The text is cut by the vocabulary's pattern; each piece starts as its bytes.  A segment tree over the ranks of adjacent
pairs holds at its root the leftmost pair of lowest rank; merging it changes two neighbouring leaves, whose paths to the
root are recomputed, until no pair can be merged.  A piece of n bytes so costs O(n log n), whatever it holds.  Pieces
repeat, so each Python worker remembers the ids of pieces it has seen (a bounded memo, which changes no result).

Defined cases: null and empty text give an empty list; strings of special tokens are ordinary text; unpaired surrogates
cannot occur in Arrow strings; any text length is processed whole.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.text import spread

#: Folder of the public vocabularies.
TOKENIZER_DIR = "/opt/tokenizers"

_SPACE = r"\t-\r \x85\xa0  -     　"  # Unicode White_Space
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PIECE_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

_NONE = 1 << 30
#: Pieces one worker remembers at most.
MEMO_PIECES = 400_000


def merge(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Merge ``parts`` by rank until no adjacent pair has one, with a segment tree over the pairs.

    Leaf i holds the rank of the pair that begins at part i, inner nodes the least of their children; going down from
    the root to the left wherever the left child holds the root's rank finds the leftmost such pair.
    """
    n = len(parts)
    if n < 2:
        return parts
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(parts[i] + parts[i + 1], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] != _NONE:
        low, k = tree[1], 1
        while k < size:
            k = 2 * k if tree[2 * k] == low else 2 * k + 1
        i = k - size
        j = after[i]
        parts[i] += parts[j]
        parts[j] = b""
        after[i] = right = after[j]
        if j < n - 1:
            put(j, _NONE)
        if right < n:
            before[right] = i
            put(i, get(parts[i] + parts[right], _NONE))
        else:
            put(i, _NONE)
        left = before[i]
        if left >= 0:
            put(left, get(parts[left] + parts[i], _NONE))
    return [p for p in parts if p]


class Encoder(dict):
    """Memo from piece to ids; missing pieces are merged by the segment tree."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = [bytes([i]) for i in range(256)]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        ranks = self.ranks
        one = ranks.get(raw)
        ids = (one,) if one is not None else tuple(ranks[p] for p in merge([self.bytes[x] for x in raw], ranks))
        if len(piece) <= 64:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of one text, as an iterator."""
        if not text:
            return iter(())
        pieces = _PIECE_ASCII.findall(text) if text.isascii() else _PIECE.findall(text)
        return chain.from_iterable(map(self.__getitem__, pieces))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``id_column`` and ``ids`` (array<int>) of each row of ``df``; one output row per input row, any ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat, ends = array("i"), array("i", [0])
                for text in part.column(1).to_pylist():
                    flat.extend(memo.encode(text))
                    ends.append(len(flat))
                offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = spread(df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)
