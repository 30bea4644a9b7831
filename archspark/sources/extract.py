"""Syntax nodes of source files: an extractor for each language, run over files in Arrow batches.

Python is parsed by its own parser; files it rejects are read line by line, so imports, classes and functions are still
found.  C++ is read by a tokenizer that follows scopes.  Nodes are laid out breadth-first, children of a node side by
side, parents before children.  Other languages register a function ``bytes -> Tree``.

Numbers of nodes differ from those of a full grammar (nodes of kind Other are fewer); files, imports, classes, functions,
calls and field accesses are what the metrics rest on.
"""

from __future__ import annotations

import ast
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from archspark import schemas as S

SCHEMA = "path string, node_id int, kind tinyint, name string, byte_start bigint, byte_end bigint, first_child_index bigint, child_count bigint, parent_index int, error string"


@dataclass
class Tree:
    """One node with its children."""

    kind: int
    name: str
    start: int
    end: int
    children: list[Tree] = field(default_factory=list)


def layout(root: Tree) -> list[tuple]:
    """(kind, name, start, end, first_child, child_count, parent) of each node, breadth-first."""
    out: list[list] = []
    queue = deque([(root, -1)])
    waiting = 1
    while queue:
        node, parent = queue.popleft()
        out.append([node.kind, node.name, node.start, node.end, waiting if node.children else 0, len(node.children), parent])
        queue.extend((c, len(out) - 1) for c in node.children)
        waiting += len(node.children)
    return [tuple(x) for x in out]


# --------------------------------------------------------------------------- Python


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ".".join(reversed(parts))


def _python_kind(node: ast.AST) -> tuple[int, str]:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return S.FUNCTION, node.name
    if isinstance(node, ast.ClassDef):
        bases = [b for b in (_dotted(b) for b in node.bases) if b]
        return S.CLASS, node.name + (" : " + ",".join(bases) if bases else "")
    if isinstance(node, ast.Import):
        return S.IMPORT, node.names[0].name
    if isinstance(node, ast.ImportFrom):
        return S.IMPORT, "." * node.level + (node.module or "")
    if isinstance(node, ast.Call):
        return S.CALL, _dotted(node.func)
    if isinstance(node, ast.Attribute):
        return S.FIELD_ACCESS, node.attr if isinstance(node.value, ast.Name) and node.value.id == "self" else ""
    if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.arguments)):
        return S.VARIABLE, ""
    return S.OTHER, ""


def extract_python(source: bytes) -> Tree:
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(source)
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = source.count(b"\n") + 1
    at = lambda line, column: starts[min(line - 1, len(starts) - 1)] + column if line <= lines else len(source)
    root = Tree(S.FILE, "", 0, len(source))
    stack: list[tuple[ast.AST, Tree]] = [(module, root)]
    while stack:
        node, tree = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                continue
            kind, name = _python_kind(child)
            start = at(child.lineno, child.col_offset) if hasattr(child, "lineno") else tree.start
            end = at(child.end_lineno, child.end_col_offset) if hasattr(child, "lineno") else tree.end
            made = Tree(kind, name, start, end)
            tree.children.append(made)
            stack.append((child, made))
    return root


_PY_LINE = re.compile(rb"([ \t]*)(?:(?:async[ \t]+)?def[ \t]+(\w+)|class[ \t]+(\w+)[ \t]*(?:\(([^)]*)\))?|import[ \t]+([\w.]+)|from[ \t]+(\.*[\w.]*)[ \t]+import)")


def _python_lines(source: bytes) -> Tree:
    """Imports, classes and functions by lines and indentation, for files that do not parse."""
    text = lambda b: (b or b"").decode("utf-8", "replace")
    root = Tree(S.FILE, "", 0, len(source))
    stack = [(-1, root)]
    at = 0
    for line in source.splitlines(keepends=True):
        if line.strip():
            indent = len(line) - len(line.lstrip(b" \t"))
            while len(stack) > 1 and stack[-1][0] >= indent:
                stack.pop()[1].end = at
            m = _PY_LINE.match(line)
            if m:
                start = at + indent
                if m[2] is not None:
                    node = Tree(S.FUNCTION, text(m[2]), start, len(source))
                elif m[3] is not None:
                    bases = ",".join(b.strip() for b in text(m[4]).split(",") if b.strip() and "=" not in b)
                    node = Tree(S.CLASS, text(m[3]) + (f" : {bases}" if bases else ""), start, len(source))
                else:
                    node = Tree(S.IMPORT, text(m[5] if m[5] is not None else m[6]), start, at + len(line.rstrip()))
                stack[-1][1].children.append(node)
                if node.kind != S.IMPORT:
                    stack.append((indent, node))
        at += len(line)
    return root


# --------------------------------------------------------------------------- C++

_CC = re.compile(
    rb'(?P<skip>//(?:[^\\\n]|\\.)*|/\*.*?\*/|R"([^()\\\s]{0,16})\(.*?\)\2"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\')|(?P<include>^[ \t]*#[ \t]*include[ \t]*(?P<target><[^>\n]*>|"[^"\n]*"))|(?P<directive>^[ \t]*#(?:[^\\\n]|\\\r?\n|\\.)*)|'
    rb"(?P<this>this[ \t]*->[ \t]*(?P<member>\w+))|(?P<word>~?[A-Za-z_]\w*)|(?P<sign>::|->|[{}();,:<>=\[\]&*.!])",
    re.S | re.M,
)
_CC_CONTROL = frozenset(b"if for while switch catch return sizeof alignof decltype static_assert new delete throw else do case defined noexcept alignas typeid co_await co_return co_yield".split())


def extract_cpp(source: bytes) -> Tree:
    root = Tree(S.FILE, "", 0, len(source))
    scopes: list[tuple[Tree, str]] = [(root, "namespace")]
    parens: list[int] = []
    head: list[re.Match] = []  # tokens since the last ; { or } outside brackets
    text = lambda b: b.decode("utf-8", "replace")

    def opened(at: int) -> tuple[Tree, str]:
        words = [m["word"] for m in head if m["word"]]
        start = head[0].start() if head else at
        top = scopes[-1][1]
        if b"namespace" in words[:2] or words[:1] == [b"extern"] and b"(" not in [m["sign"] for m in head]:
            return Tree(S.OTHER, "", start, len(source)), "namespace"
        signs = [m["sign"] for m in head]
        if any(w in (b"class", b"struct", b"union") for w in words) and b"enum" not in words and b"(" not in signs:
            k = max(i for i, m in enumerate(head) if m["word"] in (b"class", b"struct", b"union") and not (i and head[i - 1]["sign"] in (b"<", b",")))
            rest = head[k + 1 :]
            colon = next((i for i, m in enumerate(rest) if m["sign"] == b":"), len(rest))
            named = [m["word"] for m in rest[:colon] if m["word"] and m["word"] not in (b"final", b"alignas")]
            bases, depth, part = [], 0, b""
            for m in rest[colon + 1 :]:
                token = m["word"] or m["sign"] or b""
                depth += (token == b"<") - (token == b">")
                if token == b"," and depth == 0:
                    bases.append(part)
                    part = b""
                elif token not in (b"public", b"private", b"protected", b"virtual"):
                    part += token
            bases = [b for b in [*bases, part] if b]
            name = text(named[-1]) if named else ""
            return Tree(S.CLASS, name + (" : " + ",".join(map(text, bases)) if bases and name else ""), start, len(source)), "class"
        if top in ("namespace", "class") and b"(" in signs and b"=" not in signs[: signs.index(b"(")]:
            k = signs.index(b"(")
            name = head[k - 1]["word"] if k else None
            if name and name not in _CC_CONTROL:
                return Tree(S.FUNCTION, text(name), start, len(source)), "function"
        return Tree(S.OTHER, "", at, len(source)), "enum" if b"enum" in words else "block"

    for m in _CC.finditer(source):
        here, kind = scopes[-1]
        if m["skip"] is not None or m["directive"] is not None:
            continue
        if m["include"] is not None:
            here.children.append(Tree(S.IMPORT, text(m["target"][1:-1]), m.start(), m.end()))
            continue
        if m["this"] is not None:
            here.children.append(Tree(S.FIELD_ACCESS, text(m["member"]), m.start(), m.end()))
            head.append(m)
            continue
        sign = m["sign"]
        if sign == b"(":
            before = head[-1] if head else None
            inside = kind in ("function", "block")
            if before is not None and inside and (before["word"] and before["word"] not in _CC_CONTROL or before["this"]):
                name = before["word"] or before["member"]
                here.children.append(Tree(S.CALL, text(name), before.start(), m.end()))
            parens.append(1)
            head.append(m)
        elif sign == b")":
            if parens:
                parens.pop()
            head.append(m)
        elif sign == b"{":
            made = opened(m.start()) if not parens or parens[-1] == 0 else (Tree(S.OTHER, "", m.start(), len(source)), "block")
            here.children.append(made[0])
            scopes.append(made)
            parens.append(0)
            head = []
        elif sign == b"}":
            if parens and parens[-1] == 0:
                parens.pop()
            if len(scopes) > 1:
                scopes.pop()[0].end = m.end()
            head = []
        elif sign == b";" and (not parens or parens[-1] == 0):
            if head and head[0]["word"] == b"using" and b"=" not in [x["sign"] for x in head] and not any(x["word"] == b"namespace" for x in head):
                here.children.append(Tree(S.IMPORT, text(b"".join(x["word"] or x["sign"] or b"" for x in head[1:])), head[0].start(), m.end()))
            elif head and kind in ("class", "namespace", "block", "function") and b"(" not in [x["sign"] for x in head] and len(head) > 1:
                here.children.append(Tree(S.VARIABLE, "", head[0].start(), m.end()))
            head = []
        elif sign == b":" and len(head) == 1 and head[0]["word"] in (b"public", b"private", b"protected", b"default"):
            head = []
        else:
            head.append(m)
    return root


EXTRACTORS: dict[str, Callable[[bytes], Tree]] = {"python": extract_python, "cpp": extract_cpp}


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], Tree]] | None = None) -> DataFrame:
    """Nodes of ``files(path, language, content)``; a file that fails has one row with ``error`` and no node."""
    own = dict(extractors or EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, language, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    if not content.is_valid:
                        raise ValueError("no content")
                    rows += [(path, k, *node, None) for k, node in enumerate(layout(own[language](content.as_py())))]
                except Exception as e:  # one bad file must not end the scan
                    rows.append((path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) or [()] * 10
            kinds = (pa.string(), pa.int32(), pa.int8(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    from pyspark.sql import functions as F

    return files.where(F.col("language").isin(*own)).select("path", "language", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)
