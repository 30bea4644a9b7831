"""Generated, minified, vendored files and data saved as code (problem 2).

Each file's statements (lines, and the parts of long lines) become tokens in which numbers and very short names are
alike; Re-Pair infers a grammar over them by replacing its most frequent pairs by rules until no pair repeats.

* High rule reuse (few symbols left for what is derived) flags machine-made text: over statements, generated code
  (accessors after a template); over tokens with very short names alike, minified code.  Comments at the head that name
  a generator flag a file too.
* A file that is nearly all literals, whose characters a Re-Pair grammar hardly shortens, and that holds no logic is a
  data blob.
* Phrases of whole lines (stretches of the corpus' grammar) that stand in several repositories are counted over all
  files by one pre-aggregated shuffle; a file mostly derived from such shared rules is a third party's copy, wherever it
  lies.  A vendor folder or an upstream notice at the head flags the rest.

Defined cases: null or empty content is never flagged; rows repeated for one file count once; null paths count as ``''``;
files of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.text import spread
from archspark.session import durable

#: Share of a file's weight in phrases of several repositories from which it is a copy.
SHARED = 0.6
#: Statements derived per symbol left in the grammar from which a file is machine-made.
REUSE = 1.25
#: Least statements for that, so that a few alike lines make no machine.
STATEMENTS = 15
#: Tokens derived per symbol left, with names of at most two characters alike, from which code is minified, and the share
#: of such names among all names from which that grammar is inferred at all.
TOKEN_REUSE, SHORT_NAMES = 3.5, 0.5
#: Symbols a Re-Pair grammar of the literals leaves per character from which they count as incompressible.
LITERAL_SIZE = 0.2
#: Lines of a phrase at most, and its least characters.
PHRASE_LINES, PHRASE_CHARS = 24, 60

_NUMBER = re.compile(r"0[xX][\da-fA-F]+|\d+")
_TOKEN = re.compile(r"[A-Za-z_]\w*+|\d[\w.]*+|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[^\s\w]")
_LITERAL = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[fFuUlL]*(?![\w.])", re.S)
_NAME = re.compile(r"[A-Za-z_]\w*")
_PACKED = re.compile(r"[A-Za-z0-9+/=]{40,}|(?:0[xX][\da-fA-F]+|-?\d+(?:\.\d+)?),")
_LOGIC = re.compile(r"\b(?:def|return|if|for|while|switch|lambda)\b|\)\s*(?:const\s*)?\{")
_COMMENT = re.compile(r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+|#[^\n]*+")
_HEAD = re.compile(r"(?:\s*(?://[^\n]*|/\*.*?\*/|#(?!\s*(?:include|pragma|define|if|ifdef|ifndef)\b)[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|#pragma once))*", re.S)
#: Notices of generators, of upstreams, and folders of third parties.
_GENERATED_NOTICE = re.compile(
    r"@generated|do not (?:edit|modify)|auto-?generated|(?:code|file|this file was|automatically) generated by|generated (?:code|file|from)|automatically (?:produced|generated|created)|machine (?:written|generated)|"
    r"(?:changes|manual changes|edits) (?:will be|are) (?:lost|overwritten)|wurde von \S+ (?:erzeugt|generiert)|g[eé]n[eé]r[eé] (?:par|automatiquement)|generado (?:por|autom)",
    re.I,
)
_UPSTREAM_NOTICE = re.compile(r"^[^\w\n]*upstream:|\bvendored (?:from|copy)|copyright (?:\(c\) )?(?:\d+ )?(?:the )?[\w.\- ]+ contributors\b|redistribution (?:and use )?(?:in source|permitted)|^[^\w\n]*[a-z][\w\-]+ (?:version \d+\.\d+(?:\.\d+)?|r\d{2,})\s*$", re.I | re.M)
_VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|3rd[_-]?party|external|extern|deps|site-packages|node_modules|bower_components)/", re.I)
_GENERATED_PATH = re.compile(r"(?:_pb2|_pb2_grpc|\.pb|_generated|\.generated|_gen|\.gen|\.g)\.\w+$|(?:^|/)moc_\w+\.\w+$|(?:^|/)ui_\w+_gen\.\w+$", re.I)

def statements(text: str) -> list[str]:
    """Statements with numbers and very short names made alike."""
    out = []
    for line in text.splitlines():
        parts = re.split(r"(?<=[;{}])", line) if len(line) > 160 else (line,)
        for part in parts:
            part = part.strip()
            if part:
                out.append(part)
    flat = _NUMBER.sub("0", "\n".join(out))
    return flat.split("\n")


def repair(tokens: list) -> tuple[int, int]:
    """(symbols left in the start rule and in the rules, number of rules) of a Re-Pair grammar of ``tokens``.

    Each round replaces all pairs at least half as frequent as the most frequent one, so rounds stay logarithmic.
    """
    names: dict = {}
    seq = np.fromiter((names.setdefault(t, len(names)) for t in tokens), np.int64, len(tokens))
    rules, fresh = 0, len(names)
    while len(seq) > 1:
        pairs, place, counts = np.unique(seq[:-1] * fresh + seq[1:], return_inverse=True, return_counts=True)
        top = int(counts.max())
        if top < 2:
            break
        hit = counts[place] >= max(2, top // 2)
        # of pairs that overlap the left one is taken: every second of a run of neighbouring places
        at = np.arange(len(hit))
        begun = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0))
        taken = np.flatnonzero(hit & ((at - begun) % 2 == 0))
        made, symbol = np.unique(place[taken], return_inverse=True)
        rules += len(made)
        if not len(taken):
            break
        seq[taken] = fresh + symbol
        seq = np.delete(seq, taken + 1)
        fresh += len(made)
    return len(seq) + 2 * rules, rules


def tokens(text: str) -> list[str]:
    """Tokens of the code without comments, in which numbers, strings and names of at most two characters are alike."""
    out = []
    for w in _TOKEN.findall(_COMMENT.sub(" ", text)):
        c = w[0]
        if c.isdigit():
            w = "0"
        elif c in "\"'" and len(w) > 1:
            w = "s"
        elif len(w) <= 2 and (c.isalpha() or c == "_"):
            w = "v"
        out.append(w)
    return out


def features(path: str, text: str) -> dict[str, float]:
    """What one file tells by itself."""
    n = len(text)
    code = [p for p in statements(text) if not p.startswith(("#", "//", "*", "/*"))]
    size, rules = repair(code)
    bare = _COMMENT.sub("", _LITERAL.sub("", text))
    words = _NAME.findall(bare)
    head = _HEAD.match(text)[0]
    values = "".join(_PACKED.findall(text))
    packed = len(values) / n if n else 0.0
    short = sum(len(w) <= 2 for w in words) / len(words) if words else 0.0
    symbols = tokens(text) if short >= SHORT_NAMES else []
    density = 1000 * len(words) / n if n else 0.0
    return {
        "short_names": short,
        "token_reuse": len(symbols) / repair(symbols)[0] if symbols else 0.0,
        "statements": len(code),
        "reuse": len(code) / size if size else 0.0,
        "rules": rules,
        "words": density,
        "packed": packed,
        "literal_size": repair(list(values))[0] / len(values) if packed > 0.4 and density < 3 else 0.0,
        "logic": float(bool(_LOGIC.search(bare))),
        "generated_notice": float(bool(_GENERATED_NOTICE.search(head))),
        "upstream_notice": float(bool(_UPSTREAM_NOTICE.search(head))),
        "vendor_dir": float(bool(_VENDOR_DIR.search(path))),
        "generated_path": float(bool(_GENERATED_PATH.search(path))),
    }


def cause(path: str, text: str) -> str | None:
    """Why a file is not hand-written, as far as it alone can tell."""
    f = features(path, text)
    if not f["logic"] and f["literal_size"] >= LITERAL_SIZE:
        return "blob"
    if f["token_reuse"] >= TOKEN_REUSE and f["statements"] >= STATEMENTS:
        return "minified"
    if f["generated_notice"] or f["reuse"] >= REUSE and f["statements"] >= STATEMENTS:
        return "generated"
    if f["vendor_dir"] or f["upstream_notice"]:
        return "vendored"
    return None


def phrases(text: str) -> Iterator[tuple[int, int]]:
    """(hash, characters) of the stretches of lines between blank lines, long ones cut at lines chosen by their hash.

    Equal stretches of two files are cut alike, so each is one rule of the corpus' grammar.
    """
    held: list[str] = []
    size = 0

    def rule() -> Iterator[tuple[int, int]]:
        if size >= PHRASE_CHARS:
            yield xxhash.xxh3_64_intdigest("\n".join(held)) - (1 << 63), size

    for line in text.splitlines():
        line = line.strip()
        if line:
            held.append(line)
            size += len(line)
        if not line and held or len(held) >= 8 and (len(held) >= PHRASE_LINES or zlib.crc32(line.encode()) % 8 == 0):
            yield from rule()
            held, size = [], 0
    yield from rule()


def files_to_remove(df: DataFrame, *, id_column: str = "file_id", repo_column: str = "repo", path_column: str = "path", text_column: str = "content") -> DataFrame:
    """``file_id, cause`` (generated, minified, blob or vendored) of each file that people did not write for their repository."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, repos, causes, hashes, sizes = [], [], [], [], []
            for key, repo, path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                found = list(phrases(text))
                own = cause(path, text)
                for at in range(0, max(1, len(found)), 4096):
                    part = found[at : at + 4096]
                    ids.append(key)
                    repos.append(repo)
                    causes.append(own)
                    hashes.append([h for h, _ in part])
                    sizes.append([w for _, w in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array(causes, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                ["file_id", "repo", "own", "h", "w"],
            )

    empty = F.lit("")
    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), F.coalesce(F.col(repo_column).cast("string"), empty).alias("repo"), F.coalesce(F.col(path_column).cast("string"), empty).alias("path"), F.col(text_column).cast("string").alias("content"))
    rows = spread(rows.where(F.col("file_id").isNotNull() & (F.octet_length("content") > 0)))
    seen = durable(rows.mapInArrow(run, "file_id bigint, repo string, own string, h array<bigint>, w array<int>"))
    uses = seen.where("own is null").select("file_id", F.explode(F.arrays_zip("h", "w")).alias("p")).select("file_id", F.col("p.h").alias("h"), F.col("p.w").alias("w"))
    owners = seen.select("repo", F.explode("h").alias("h")).groupBy("h").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("h", F.lit(True).alias("shared"))
    share = uses.join(owners, "h", "left").groupBy("file_id").agg((F.sum(F.when(F.col("shared"), F.col("w")).otherwise(0)) / F.sum("w")).alias("share"))
    copies = share.where(F.col("share") >= SHARED).select("file_id", F.lit("vendored").alias("cause"))
    own = seen.where("own is not null").groupBy("file_id").agg(F.min("own").alias("cause"))
    return own.unionByName(copies).withColumnRenamed("file_id", id_column)
