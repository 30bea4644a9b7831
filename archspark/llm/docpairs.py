"""Functions paired with their documentation (problem 7).

Signatures are found by regular expressions (Python ``def``, C++ declarators with a parameter list and a body); the body
of a Python function is delimited by an indentation stack, that of a C++ function by a stack of braces.  Documentation
is attached by line distance: in Python the first statement of the body if it is a plain string (comments before it do
not count), in C++ the documentation comments (``/** /*! /// //!``) of the comment block that stands directly above.

Documentation is trivial, and the function then gives no pair, if it is empty, a placeholder, or says nothing beyond the
function's name or its parameters' names.

Defined cases: null texts give nothing; an unterminated string or comment is no documentation; other strings (``usage =
"..."``, f-strings, bytes, strings in expressions or nested functions) and ordinary comments are none; rows repeated
for one key count once; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.text import spread

_PY_DEF = re.compile(r"[ \t]*(?:@[^\n]*\n[ \t]*)*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*\(")
_PY_TOKEN = re.compile(r"#[^\n]*|[rRbBfFuU]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|[()\[\]{}:]", re.S)
_SKIP = re.compile(r"(?:[ \t\r\n\f]|\\\r?\n|#[^\n]*)*")
_DOCSTRING = re.compile(r"([rRuU]?)(?:\"\"\"((?:\\.|[^\\])*?)\"\"\"|'''((?:\\.|[^\\])*?)'''|\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)')", re.S)
_AFTER = re.compile(r"[ \t]*(?:;|#|\r?\n|\Z)")
_COMMENT = re.compile(r"[ \t]*(?:(//[^\n]*)|(/\*.*?\*/))[ \t]*\r?\n?|[ \t]*\r?\n", re.S)
_CC_SIGN = re.compile(r'//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+|"(?:\\.|[^"\\\n])*+"|\'(?:\\.|[^\'\\\n])+\'|(?<![~\w:])[~\w:]++(?=\s*+\()|[(){};]', re.S)
_CC_TOKEN = re.compile(r'//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+|R"(\w{0,16})\(.*?(?:\)\1"|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|[{}]', re.S)


@dataclass
class Function:
    """One function: its name, parameter names, documentation (None: none) and code without it."""

    name: str
    parameters: list[str]
    doc: str | None
    code: str


def _names(parameters: str, python: bool) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(parameters):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append(parameters[last:i])
            last = i + 1
    parts.append(parameters[last:])
    if python:
        return [m[0] for p in parts if (m := re.search(r"\w+", p))]
    return [m[1] for p in parts if (m := re.search(r"(\w+)\s*(?:=.*|\[.*)?$", p.strip(), re.S))]


def python_function(text: str) -> Function | None:
    """The function at the head of ``text``."""
    sig = _PY_DEF.match(text)
    if not sig:
        return None
    depth, close, start = 1, None, None
    for m in _PY_TOKEN.finditer(text, sig.end()):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0 and close is None:
                close = m.start()
        elif c == ":" and depth == 0:
            start = m.end()
            break
    if start is None:
        return Function(sig[1], [], None, text)
    parameters = _names(text[sig.end() : close], True)
    end = _python_end(text, start)
    at = _SKIP.match(text, start).end()
    doc, after = [], at
    while at < end and (m := _DOCSTRING.match(text, at)):
        doc.append(next(g for g in m.groups()[1:] if g is not None))
        after = m.end()
        gap = re.compile(r"[ \t]*").match(text, after).end()
        if text[gap : gap + 1] not in ("'", '"'):
            break
        at = gap
    if not doc or not _AFTER.match(text, after):
        return Function(sig[1], parameters, None, text[:end])
    return Function(sig[1], parameters, "".join(doc), text[: _SKIP.match(text, start).end()] + text[after:end])


def _python_end(text: str, start: int) -> int:
    """End of the body that begins at ``start``: a stack holds the indentation of its open blocks, and the first logical line
    that leaves them all is outside.  A body on the definition's own line ends with that line."""
    stack: list[int] = []
    depth, at, first = 0, start, True
    tokens = _PY_TOKEN.finditer(text, start)
    m = next(tokens, None)
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        lead = _BLANKS.match(text, at, stop)
        empty = lead.end() == stop or text[lead.end()] in "\r#"
        if not first and not depth and not empty:  # a logical line begins
            indent = len(lead[0].expandtabs(8))
            if not stack and indent == 0:
                return at
            while stack and indent < stack[-1]:
                stack.pop()
            if not stack and at != body:
                return at
            if not stack or indent > stack[-1]:
                stack.append(indent)
        while m and m.start() < stop:
            if m.end() > stop:
                stop = text.find("\n", m.end())
                stop = len(text) if stop < 0 else stop
            depth += (m[0] in "([{") - (m[0] in ")]}")
            m = next(tokens, None)
        inline = first and not empty
        at = stop + 1
        if inline and not depth:
            return min(at, len(text))
        if first or not stack:
            body = _next_line(text, at)
        first = False
    return len(text)


_BLANKS = re.compile(r"[ \t\f]*")
_NEXT = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*+")


def _next_line(text: str, at: int) -> int:
    """Begin of the first line from ``at`` that is neither blank nor a comment."""
    return _NEXT.match(text, at).end()


def cc_function(text: str) -> Function | None:
    """The C++ function at the head of ``text`` with the comments directly above it."""
    at, doc, distance = 0, [], 0
    while m := _COMMENT.match(text, at):
        comment = m[1] or m[2]
        if m.end() == at:
            break
        if comment is None:
            distance += 1
        else:
            if distance > 1:
                doc = []
            distance = 0
            if m[1] and (comment.startswith("//!") or (comment.startswith("///") and comment[3:4] != "/")) and comment[3:4] != "<":
                doc.append(comment[3:])
            elif m[2] and len(comment) > 4 and comment[2] in "*!" and comment[3] not in "*<":
                doc.append(re.sub(r"(?m)^[ \t]*\*+(?!/)", "", comment[3:-2]))
        at = m.end()
    sig = _cc_signature(text, at)
    if not sig:
        return Function("", [], "\n".join(doc) if doc else None, text[at:])
    name, parameters, body = sig
    depth, end = 1, len(text)
    for m in _CC_TOKEN.finditer(text, body):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0:
            end = m.end()
            break
    return Function(name.rpartition("::")[2], _names(parameters, False), "\n".join(doc) if doc and distance <= 1 else None, text[at:end])


def _cc_signature(text: str, at: int) -> tuple[str, str, int] | None:
    """(name, parameter list, begin of the body) of the first declarator with a parameter list that a body follows."""
    name, depth, group, opened = "", 0, None, 0
    for m in _CC_SIGN.finditer(text, at):
        c = m[0]
        if c == "(":
            if not depth:
                opened = m.end()
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
            if not depth and name and group is None and opened:
                group = (opened, m.start())
        elif depth:
            continue
        elif c == ";" or c == "}":
            name, group, opened = "", None, 0
        elif c == "{":
            if group:
                return name, text[group[0] : group[1]], m.end()
            name, opened = "", 0
        elif c[0] not in "/\"'" and group is None:
            name = c
    return None


def function_at_head(text: str) -> Function | None:
    return python_function(text) or cc_function(text)


#: Words that say nothing by themselves.
_EMPTY = frozenset(
    "a an the this that it of for to in and or is are be function method routine procedure member operator constructor "
    "named called name does do implements implementation helper int str float bool list dict none optional void auto".split()
)
_PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|wip|n\s?/?\s?a|none|nil|null|noqa|doc|docs|docstring|documentation|description|placeholder|undocumented|not documented( yet)?|"
    r"(the )?(function|method|class|module) (doc|docs|docstring|documentation|description)|(the )?(description|documentation|docstring|text) (goes|comes) here|"
    r"to be (documented|written|done|added|defined|described|completed)|(add|write|insert|missing|needs?|no) (a |the |some )?(description|documentation|docs?|docstring|comment|this|me)( here)?|lorem ipsum.*)",
    re.S,
)
_MARKED = re.compile(r"(?:todo|fixme|xxx|tbd|noqa)\b", re.S)
_TAG = re.compile(r"^\s*(?:[:@\\](param|parameter|arg|argument|tparam|key|type|var)\b(?:\[[^\]]*\])?\s*(?:[\w.\[\], ]*?\s)??(\w+)\s*:?|[:@\\](returns?|rtype|retval|raises?|throws?|exception|yields?)\b\s*:?)(.*)$")
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|attributes|keyword args)\s*:?\s*$|^\s*[-=~*]{2,}\s*$", re.I)
_BRIEF = re.compile(r"[@\\](?:brief|short|fn|details|note)\b")
_WORD = re.compile(r"[^\W_]+")


def _parts(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name))]


def _same(word: str, part: str) -> bool:
    """The word is the part, or one with another ending (probe, probes, probing; flush, flushs)."""
    if word == part:
        return True
    endings = ("s", "es", "ed", "ing", "d", "er", "e", "y", "ies", "ied", "ping", "ped", "ting", "ted")
    if word.startswith(part):
        return word[len(part) :] in endings
    stem = part[:-1] if part[-1:] in "ey" and len(part) > 3 else part
    return len(stem) >= 2 and word.startswith(stem) and word[len(stem) :] in endings


def _new_words(text: str, parts: list[str]) -> bool:
    """The text has a word beyond ``parts`` and words that say nothing."""
    return any(w not in _EMPTY and not any(_same(w, p) for p in parts) for w in _parts(text))


def is_trivial(doc: str, name: str, parameters: list[str]) -> bool:
    """True for documentation that is empty, a placeholder, or only names again."""
    text = _BRIEF.sub(" ", doc)
    bare = " ".join(re.sub(r"[^\w/ ]+", " ", text).split()).lower()
    if not _WORD.search(bare) or _PLACEHOLDER.fullmatch(bare) or _PLACEHOLDER.fullmatch(bare.replace("_", " ")):
        return True
    if _MARKED.match(bare) and len(bare.split()) <= 8:
        return True
    own = _parts(name)
    known = set(parameters)
    for line in text.splitlines():
        if _SECTION.match(line):
            continue
        if tag := _TAG.match(line):
            if _new_words(tag[4] or "", _parts(tag[2] or "")) and not _PLACEHOLDER.fullmatch(" ".join(_parts(tag[4]))):
                return False
            continue
        item = re.match(r"^\s*[-*]?\s*(\w+)\s*(?:\([^)]*\))?\s*[:\-]\s*(.*)$", line)
        if item and item[1] in known:
            if _new_words(item[2], _parts(item[1])):
                return False
            continue
        left = " ".join(w for w in re.findall(r"\w+", line) if w not in known)
        if _new_words(left, own):
            return False
    return True


def pairs(df: DataFrame, *, id_column: str = "chunk_no", text_column: str = "text", kind_column: str = "kind", name_column: str = "qualified_name", with_texts: bool = True) -> DataFrame:
    """Functions with documentation that says something: ``chunk_no`` and, if asked, ``name, description, code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                f = function_at_head(text)
                if f and f.doc is not None and not is_trivial(f.doc, re.split(r"\.|::", name or "")[-1] or f.name, f.parameters):
                    rows.append((key, name or f.name, f.doc.strip(), f.code) if with_texts else (key,))
            columns = list(zip(*rows)) or [()] * (4 if with_texts else 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.string()] * 3))], ["chunk_no", "name", "description", "code"][: len(columns)])

    rows = df.where(F.col(kind_column) == "function").select(F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"), F.col(name_column).cast("string").alias("n"))
    rows = spread(rows.where(F.col("k").isNotNull() & F.col("t").isNotNull()))
    schema = "chunk_no bigint" + (", name string, description string, code string" if with_texts else "")
    return rows.mapInArrow(run, schema).dropDuplicates(["chunk_no"]).withColumnRenamed("chunk_no", id_column)
