"""Oversized texts in pieces under a limit, cut at natural boundaries (problem 3).

Structure-tree packing: the lines of a text form a tree (a line's parent is the nearest line above that is indented
less; closing lines such as ``}`` belong to the block they close; Markdown headings, if asked for, are parents of what
stands below them).  Bottom-up, each node merges its own line and its children's pieces, neighbours first, as long as
they stay under the limit; a subtree that fits stays whole, and only oversized nodes are cut between their children.
A single line over the limit is cut after white space or punctuation where there is some, else between characters.

Each piece but the first begins with the last ``overlap`` bytes (or less: never part of a character, and never more
than the limit leaves room for) of the piece before.  Without their overlaps the pieces are the text, byte for byte.

Defined cases: null text or null key gives no piece; a text within the limit is one piece (or none with
``only_oversized``); rows repeated for one key count once; null ``byte_start`` gives null offsets; CRLF and any
characters are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 8_000, 200

_CLOSING = re.compile(rb"[ \t]*(?:[}\])]|else\b|elif\b|except\b|finally\b|catch\b|end\b|</)")
_HEADING = re.compile(rb" {0,3}(#{1,6})[ \t]")
_BREAK = re.compile(rb"[\s,;:.!?)\]}>|&]+")


def _boundary(raw: bytes, at: int) -> int:
    """``at``, or the begin of the character it would cut."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cut_line(raw: bytes, limit: int) -> list[int]:
    """Ends of the pieces of one oversized line: after the last break in the second half of the room, else forced."""
    ends, start = [], 0
    while len(raw) - start > limit:
        stop = _boundary(raw, start + limit)
        at = stop
        for m in _BREAK.finditer(raw, start + limit // 2, stop):
            at = m.end()
        start = at if at > start else max(stop, start + 1)
        ends.append(start)
    return [*ends, len(raw)]


def line_levels(lines: list[bytes], markup: bool) -> list[float]:
    """Depth of each line in the structure tree; blank lines go with the line above."""
    levels, level, heading = [], 0.0, 0
    for line in lines:
        body = line.lstrip(b" \t")
        if body.strip():
            mark = _HEADING.match(line) if markup else None
            if mark:
                heading = len(mark[1])
                level = float(heading - 7)
            else:
                level = float(len(line[: len(line) - len(body)].expandtabs(4)))
                if _CLOSING.match(line):
                    level += 0.5
        levels.append(level)
    return levels


def pack(raw: bytes, limit: int, markup: bool = False) -> list[tuple[int, int]]:
    """Byte ranges of the pieces, without overlap."""
    lines = raw.splitlines(keepends=True) if b"\r" not in raw and b"\x0b" not in raw and b"\x0c" not in raw else re.findall(rb"[^\n]*\n|[^\n]+", raw)
    levels = line_levels(lines, markup)
    n = len(lines)
    parent, stack = [-1] * n, []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parent[i] = stack[-1] if stack else -1
        stack.append(i)
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line)
    below: list[list[list[tuple[int, int]]]] = [[] for _ in range(n + 1)]

    def merged(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for part in parts:
            for a, b in part:
                if out and b - out[-1][0] <= limit:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
        return out

    for i in range(n - 1, -1, -1):
        line, a = lines[i], starts[i]
        own, last = [], 0
        for end in cut_line(line, limit) if len(line) > limit else (len(line),):
            own.append((a + last, a + end))
            last = end
        below[parent[i] if parent[i] >= 0 else n].append(merged([own, *reversed(below[i])]))
        below[i] = []
    return merged(list(reversed(below[n])))


def pieces(raw: bytes, limit: int = LIMIT, overlap: int = OVERLAP, markup: bool = False) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin without, end) of each piece."""
    if len(raw) <= limit:
        return [(0, 0, len(raw))]
    room = max(1, limit - overlap)
    out: list[tuple[int, int, int]] = []
    for a, b in pack(raw, room, markup):
        begin = a
        if out:
            begin = max(a - overlap, b - limit, out[-1][0], 0)
            while begin < a and raw[begin] & 0xC0 == 0x80:
                begin += 1
        out.append((begin, a, b))
    return out


def cut_kind(raw: bytes, limit: int = LIMIT) -> str:
    """'forced' if one line, with its line feed, is longer than the limit, else 'natural'."""
    return "forced" if any(len(x) > limit for x in re.findall(rb"[^\n]*\n|[^\n]+", raw)) else "natural"


def split(df: DataFrame, *, id_column: str = "chunk_no", text_column: str = "text", start_column: str = "byte_start", limit: int = LIMIT, overlap: int = OVERLAP, markup: bool = False, only_oversized: bool = True) -> DataFrame:
    """One row per piece: ``chunk_no, piece_no, cut, byte_start, byte_end, own_start, text``.

    ``own_start`` is where the piece begins without its overlap; offsets count from the row's ``byte_start``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8")
                cut = cut_kind(raw, limit)
                for no, (a, own, b) in enumerate(pieces(raw, limit, overlap, markup)):
                    at = [None if start is None else start + x for x in (a, b, own)]
                    rows.append((key, no, cut, *at, raw[a:b].decode("utf-8")))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk_no", "piece_no", "cut", "byte_start", "byte_end", "own_start", "text"])

    rows = df.select(F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"), F.col(start_column).cast("bigint").alias("s"))
    rows = rows.where(F.col("k").isNotNull() & F.col("t").isNotNull())
    if only_oversized:
        rows = rows.where(F.octet_length("t") > limit)
    out = rows.dropDuplicates(["k"]).mapInArrow(run, "chunk_no bigint, piece_no int, cut string, byte_start bigint, byte_end bigint, own_start bigint, text string")
    return out.withColumnRenamed("chunk_no", id_column)
