"""Source files that do not parse (problem 5).

Each language has one parsing-expression grammar over the tokens of a whole file, run by a packrat machine
(:mod:`archspark.llm.peg`) that must consume the file up to its end.  A token is one character: names, numbers and
strings are alike, so statements of the same shape are the same text; the results of rules that end with a statement are
remembered across files and a shape is parsed once per worker.  Nothing recurses, so nesting is bounded by the languages'
own limits (200 brackets and 100 indentations in Python, 256 brackets in C++).

Tokens are checked as they are read: digits and underscores of numbers, prefixes and escapes of strings, the fields of
formatted strings (each parsed by the same grammar), indentation, directives and their balance.  What fails there
is a token no rule takes.

A failure reports the furthest token at which the grammar failed (line and column), and a cause: ``merge_conflict``,
``truncated`` (the input ends too early), ``wrong_language``, ``syntax``, or ``undecided`` if the machine gave up (more
steps than any input that is read in linear time; such a file is reported but is no case of ``p5_found``).

Defined cases: null content is no case; empty and blank files are valid; extensions other than those of the two
languages are not judged; rows repeated for one ``file_id`` count once; files of any length are read whole.  Unknown
names, missing includes and types are no faults.  C++ is parsed without running the preprocessor: directives must be
known and balanced, all branches count, names in capitals with underscores may stand for specifiers or whole declarations,
and other macros that stand for half a statement are not understood.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.peg import Grammar, Undecided
from archspark.llm.text import spread

#: Spellings of tokens one worker remembers at most, and the longest it keeps.
MEMO_TOKENS, MEMO_LENGTH = 300_000, 200
#: Tokens that no rule takes; begin and end of an indented block.
BAD, INDENT, DEDENT = "\x7f", "\x0e", "\x0f"

# --------------------------------------------------------------------------- Python

#: One character for each keyword.
PY_KEYWORDS = {
    "if": "I", "elif": "J", "else": "E", "for": "F", "in": "N", "not": "O", "and": "A", "or": "R", "is": "S", "lambda": "L",
    "def": "D", "class": "C", "return": "T", "yield": "Y", "raise": "Z", "try": "Q", "except": "X", "finally": "B", "with": "W",
    "as": "U", "pass": "P", "break": "K", "continue": "V", "del": "G", "global": "H", "nonlocal": "H", "import": "M", "from": "f",
    "assert": "a", "async": "y", "await": "w", "None": "c", "True": "c", "False": "c", "while": "h", "match": "m", "case": "k", "type": "t",
}
#: Operators of several characters.
PY_OPERATORS = "**= //= >>= <<= ... += -= *= /= %= @= &= |= ^= == != <= >= := ** // >> << ->".split()
_PY_OPS = {op: chr(0xE000 + k) for k, op in enumerate(PY_OPERATORS)}

PYTHON = Grammar(
    r"""
file <- stmt* '\0'
stmt <- if_head ~ block (elif_head block)* else? / for_head ~ block else? / while_head ~ block else? / with_head ~ block
 / try_head ~ block ((group_head block)+ else? final? / (except_head block)+ else? final? / final)
 / deco ~ deco* (def_head / class_head) block / def_head ~ block / class_head ~ block / match_head '\n' '\x0e' case+ '\x0f' / simple
block <- '\n' '\x0e' ~ stmt+ '\x0f' / simple
else <- else_head block
final <- final_head block
case <- case_head block
simple@line <- small (';' small)* ';'? '\n'
if_head@line <- 'I' named ':'
elif_head@line <- 'J' named ':'
else_head@line <- 'E' ':'
while_head@line <- 'h' named ':'
for_head@line <- 'y'? 'F' targets 'N' stars ':'
with_head@line <- 'y'? 'W' ('(' item (',' item)* ','? ')' ':' / item (',' item)* ':')
try_head@line <- 'Q' ':'
except_head@line <- 'X' (expr ('U' name)?)? ':'
group_head@line <- 'X' '*' expr ('U' name)? ':'
final_head@line <- 'B' ':'
deco@line <- '@' named '\n'
def_head@line <- 'y'? 'D' name type_params? '(' params? ')' ('->' expr)? ':'
class_head@line <- 'C' name type_params? ('(' args? ')')? ':'
match_head@line <- 'm' nstars ':' &'\n'
case_head@line <- 'k' pattern ('I' named)? ':'
item <- expr ('U' star_target &[,):])?
name <- [nmkt]
small <- import / flow / alias_type / assign / annotated / augmented / stars
stars <- span star (',' star)* ','? / span / star (',' star)* ','?
span <- [n0c] ',' ([n0c] ',')*
star <- '*' bits / expr
nstars <- span nstar (',' nstar)* ','? / span / nstar (',' nstar)* ','?
nstar <- '*' bits / named
named <- name ':=' expr / expr
yields <- 'Y' ('f' expr / stars?)
assign <- (targets '=')+ (yields / stars)
annotated <- single ':' expr ('=' (yields / stars))?
augmented <- single ('**=' / '//=' / '>>=' / '<<=' / '+=' / '-=' / '*=' / '/=' / '%=' / '@=' / '&=' / '|=' / '^=') (yields / stars)
alias_type <- 't' name type_params? '=' expr
targets <- star_target (',' star_target)* ','?
star_target <- '*'? target
target <- ended / group_target / name
group_target <- '(' targets? ')' !trailer / '[' targets? ']' !trailer
single <- ended / '(' single ')' / name
ended <- atom (trailer &trailer)* ('.' name / '[' slices ']') !trailer
flow <- 'T' stars? / 'Z' (expr ('f' expr)?)? / yields / 'P' / 'K' / 'V' / 'G' targets / 'H' name (',' name)* / 'a' expr (',' expr)?
import <- 'M' dotted alias? (',' dotted alias?)* / 'f' (dots+ dotted? / dotted) 'M' ('*' / '(' name alias? (',' name alias?)* ','? ')' / name alias? (',' name alias?)*)
dots <- '.' / '...'
dotted <- name ('.' name)*
alias <- 'U' name
expr <- lambda / either ('I' either 'E' expr)?
lambda <- 'L' lparams? ':' expr
either <- inversion (('A' / 'R') inversion)*
inversion <- 'O'* comparison
comparison <- bits (compared bits)*
compared <- '==' / '!=' / '<=' / '>=' / [<>] / 'N' / 'O' 'N' / 'S' 'O'?
bits <- unary (bitop unary)*
bitop <- '**' / '<<' / '>>' / '//' / [|^&+\-*/%@]
unary <- [\-+~]* primary
primary <- 'w'? atom trailer*
atom <- '(' (yields / named compfor / '*' bits ',' nstars? / span nstars? / named (',' nstars?)?)? ')' / '[' (named compfor / nstars)? ']' / '{' (expr ':' expr compfor / pairs / named compfor / nstars)? '}' / 's' 's'* / 'b' 'b'* / name / '0' / 'c' / '...'
compfor <- 'y'? 'F' targets 'N' either ('I' condition / 'y'? 'F' targets 'N' either)*
condition <- name ':=' either / either
pairs <- pair (',' pair)* ','?
pair <- '**' bits / expr ':' expr
trailer <- '(' (named compfor / args)? ')' / '[' slices ']' / '.' name
args <- posarg (',' posarg)* (',' kwarg)* (',' dblarg)* ','? / kwarg (',' kwarg)* (',' dblarg)* ','? / dblarg (',' dblarg)* ','?
posarg <- '*' expr / !(name '=') named
kwarg <- name '=' expr / '*' expr
dblarg <- '**' expr / name '=' expr
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / nstar
type_params <- '[' type_param (',' type_param)* ','? ']'
type_param <- ('*' / '**')? name (':' expr)? ('=' star)?
params <- required (',' required)* (',' '/' (',' required)* (',' optional)* / (',' optional)+ (',' '/' (',' optional)*)?)? (',' others)? ','? / optional (',' optional)* (',' '/' (',' optional)*)? (',' others)? ','? / others ','?
required <- name note? !'='
optional <- name note? '=' expr
others <- '**' name note? / '*' name (':' star)? (',' keyword)* (',' '**' name note?)? / '*' (',' keyword)+ (',' '**' name note?)?
keyword <- name note? ('=' expr)?
note <- ':' expr
lparams <- lrequired (',' lrequired)* (',' '/' (',' lrequired)* (',' loptional)* / (',' loptional)+ (',' '/' (',' loptional)*)?)? (',' lothers)? ','? / loptional (',' loptional)* (',' '/' (',' loptional)*)? (',' lothers)? ','? / lothers ','?
lrequired <- name !'='
loptional <- name '=' expr
lothers <- '**' name / '*' name (',' lkeyword)* (',' '**' name)? / '*' (',' lkeyword)+ (',' '**' name)?
lkeyword <- name ('=' expr)?
pattern <- closed (',' closed)* ','?
closed <- pat ('|' pat)* alias?
pat <- '*' name / '(' pattern? ')' / '[' pattern? ']' / '{' (key_pat (',' key_pat)* ','?)? '}' / '-'? '0' ([+\-] '0')? / 's' 's'* / 'b' 'b'* / 'c' / dotted ('(' (arg_pat (',' arg_pat)* ','?)? ')')?
key_pat <- '**' name / (dotted / '-'? '0' ([+\-] '0')? / 's' 's'* / 'b' 'b'* / 'c') ':' closed
arg_pat <- name '=' closed / closed
field <- (yields / stars) '\0'
""",
    _PY_OPS,
    {"line": lambda text, at: text.find("\n", at) + 1 or len(text)},
)

_PY_PLAIN = r"\"\"\"[^\\\"]*+(?:(?:\\.|\"(?!\"\"))[^\\\"]*+)*+\"\"\"|'''[^\\']*+(?:(?:\\.|'(?!''))[^\\']*+)*+'''|\"(?!\"\")[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'(?!'')[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_PY_EXACT = r"(?:0[xX](?:_?[\da-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:(?:\d(?:_?\d)*+)?\.\d(?:_?\d)*+|\d(?:_?\d)*+\.?+)(?:[eE][+-]?\d(?:_?\d)*+)?+[jJ]?+)"
_PY_NUMBER = rf"{_PY_EXACT}(?:(?!\w)|(?=(?:and|else|for|if|in|is|or|not)\b))|\.?\d[\w.]*+"
_PY = re.compile(rf"[ \t\f]*+(\n[ \t\f]*+|#[^\n]*+|(?:[rbuftRBUFT]{{1,2}})?(?:{_PY_PLAIN})|[^\W\d]\w*+|{_PY_NUMBER}|\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%@&|^=!<>:]=|\*\*|//|>>|<<|->|\\\n|.)", re.S)
_PY_FORMATTED = re.compile(rf"#[^\n]*+|(?<!\w)([rR]?[fF]|[fF][rR])(\"\"\"|'''|\"|')|{_PY_PLAIN}", re.S)
_FORMATTED = re.compile(r"(?<!\w)(?:[rR]?[fF]|[fF][rR])[\"']")
_HEAD_OF_STRING = re.compile(r"([A-Za-z]*)(\"\"\"|'''|\"|')")
_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*")
_PY_PREFIXES = frozenset(("", "r", "u", "b", "f", "br", "rb", "fr", "rf"))
_PY_SIGNS = frozenset("()[]{},:.;@=+-*/%&|^~<>")


@dataclass
class Fault:
    """Where (1-based line and column) and why a file does not parse."""

    line: int
    cause: str
    detail: str
    column: int = 1


class _Memo(dict):
    """Values by a function, remembered for short keys, a bounded number of them."""

    def __init__(self, build) -> None:
        super().__init__()
        self.build = build

    def __missing__(self, key):
        found = self.build(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO_TOKENS:
                self.clear()
            self[key] = found
        return found


def _py_code(token: str) -> str:
    """One character for a token, none for what is skipped, ``BAD`` for what no Python file may hold."""
    c = token[0]
    if c == "\n":
        return "\n"
    if c == "#" or token == "\\\n":
        return ""
    if token in _PY_OPS:
        return _PY_OPS[token]
    if c in "0123456789" or c == "." and len(token) > 1:
        return "0" if re.fullmatch(_PY_EXACT, token) and not _LEADING_ZERO.fullmatch(token) else BAD
    if token[-1] in "\"'" and len(token) > 1:
        return _py_string(token)
    if c in _PY_SIGNS:
        return c
    return PY_KEYWORDS.get(token) or ("n" if token.isidentifier() else BAD)


def _py_string(token: str) -> str:
    prefix, quote = _HEAD_OF_STRING.match(token).groups()
    prefix, body = prefix.lower(), token[len(prefix) + len(quote) : -len(quote)]
    if prefix not in _PY_PREFIXES:
        return BAD
    if "b" in prefix and not body.isascii():
        return BAD
    if "\\" in body and "r" not in prefix:
        for m in re.finditer(r"\\(?:(x)(?:[\da-fA-F]{2})?|(u)(?:[\da-fA-F]{4})?|(U)(?:[\da-fA-F]{8})?|(N)(?:\{([^{}]*)\})?|.)", body, re.S):
            if m[1] and len(m[0]) != 4 or "b" not in prefix and (m[2] and len(m[0]) != 6 or m[3] and (len(m[0]) != 10 or int(m[0][2:], 16) > 0x10FFFF) or m[4] and not _is_character(m[5])):
                return BAD
    return "b" if "b" in prefix else "s"


def _is_character(name: str | None) -> bool:
    try:
        unicodedata.lookup(name or "")
    except KeyError:
        return False
    return True


_PY_CODES = _Memo(_py_code)
_BRACKETS = re.compile(r"[^()\[\]{}]+")


def _depth(line: str) -> tuple[int, int]:
    """(change of the bracket depth over a line, most within it)."""
    depth = most = 0
    for c in _BRACKETS.sub("", line):
        depth += 1 if c in "([{" else -1
        most = max(most, depth)
    return depth, most


_DEPTHS = _Memo(_depth)
_COLUMNS = _Memo(lambda t: (len((lead := t.rpartition("\f")[2].lstrip("\n")).expandtabs(8)), len(lead)))
_IN_STRING = {q: re.compile(rf"{q}|\\.|\{{\{{|\}}\}}|[{{}}]" + ("|\n" if len(q) == 1 else ""), re.S) for q in ('"""', "'''", '"', "'")}


def _string_end(text: str, at: int, quote: str, raw: bool, depth: int = 0) -> int:
    """End of a formatted string whose body begins at ``at``; -1 if it has none or one of its fields does not parse."""
    if depth > 100:
        return -1
    while m := _IN_STRING[quote].search(text, at):
        c, at = m[0], m.end()
        if c == quote:
            return at
        if c == "\n" or c == "}":
            return -1
        if c[0] == "\\":
            if c[1] in "{}":
                at -= 1
            elif c[1] == "N" and not raw and text.startswith("{", at):
                at = text.find("}", at) + 1
                if not at:
                    return -1
        elif c == "{":
            at = _field_end(text, at, quote, raw, depth)
            if at < 0:
                return -1
    return -1


def _field_end(text: str, at: int, quote: str, raw: bool, depth: int, spec: int = 0) -> int:
    """End of a replacement field whose expression begins at ``at``, -1 if it does not parse."""
    codes, level = [], 0
    while True:
        if (m := _PY_FORMATTED.match(text, at)) and m[1]:
            at = _string_end(text, m.end(), m[2], "r" in m[1].lower(), depth + 1)
            if at < 0:
                return -1
            codes.append("s")
            continue
        m = _PY.match(text, at)
        if not m:
            return -1
        token = m[1]
        if not level and token in ("}", ":", ":=", "!", "="):
            break
        if token[0] == "#" and len(quote) == 1:
            return -1
        code = _PY_CODES[token]
        if code == BAD:
            return -1
        if code != "\n":
            codes.append(code)
        level += (token in "([{") - (token in ")]}")
        at = m.end()
    if PYTHON.parse("field", "".join(codes))[0] < 0:
        return -1
    at = m.end()
    if token == "=":
        m = re.compile(r"\s*([}:!])").match(text, at)
        if not m:
            return -1
        token, at = m[1], m.end()
    if token == "!":
        m = re.compile(r"[rsa]\s*([}:])").match(text, at)
        if not m:
            return -1
        token, at = m[1], m.end()
    if token == "}":
        return at
    if token == ":=":
        at -= 1
    while m := _IN_STRING[quote].search(text, at):  # the format, which may hold fields itself
        c = m[0]
        if c[0] == "}":
            return m.start() + 1
        if c == quote or c == "\n":
            return -1
        at = m.end()
        if c[0] == "{":
            at = _field_end(text, m.start() + 1, quote, raw, depth, spec + 1) if spec < 2 else -1
            if at < 0:
                return -1
    return -1


def _without_formatted(text: str) -> str:
    """The text with formatted strings replaced by plain ones of the same length and lines, or by a bad token."""
    out, at, begin = [], 0, 0
    while m := _PY_FORMATTED.search(text, begin):
        begin = m.end()
        if not m[1]:
            continue
        end = _string_end(text, m.end(), m[2], "r" in m[1].lower())
        out.append(text[at : m.start()])
        if end < 0:  # the grammar never passes this token
            return "".join([*out, BAD * len(m[1]), text[m.start() + len(m[1]) :]])
        inner = text[m.start() : end]
        mark = '"""' if "\n" in inner else '"'
        middle = inner[len(mark) : -len(mark)]
        out.append(mark + (re.sub(r"[^\n]", "x", middle) if "\n" in inner else "x" * len(middle)) + mark)
        at = begin = end
    return "".join([*out, text[at:]])


def _py_tokens(text: str, places: list[int] | None = None) -> str:
    """One character a token, with ends of lines and blocks; ``places`` gets the offset of each in ``text``."""
    text = "\n" + text
    tokens = _PY.findall(text)
    lines = "".join(map(_PY_CODES.__getitem__, tokens)).split("\n")
    indents = [t for t in tokens if t[0] == "\n"]
    offsets = iter([m.start(1) - 1 for m in _PY.finditer(text) if _PY_CODES[m[1]]]) if places is not None else None
    out: list[str] = []
    depth, levels, last = 0, [(0, 0)], 0
    for line, indent in zip(lines[1:], indents):
        if offsets:
            last = next(offsets)
        if not line:
            continue
        marks = [next(offsets) for _ in line] if offsets else None
        change, most = _DEPTHS[line]
        if not depth:
            here = _COLUMNS[indent]
            if here[0] > levels[-1][0]:
                out.append(INDENT if here[1] > levels[-1][1] and len(levels) < 100 else BAD)
                levels.append(here)
                if marks:
                    places.append(marks[0])
            else:
                while here[0] < levels[-1][0]:
                    levels.pop()
                    out.append(DEDENT)
                    if marks:
                        places.append(marks[0])
                if here != levels[-1]:
                    out.append(BAD)
                    if marks:
                        places.append(marks[0])
        if depth + most > 200:
            line = BAD * len(line)
        out.append(line)
        depth = max(0, depth + change)
        if marks:
            places += marks
        if not depth:
            out.append("\n")
            if marks:
                places.append(marks[-1] + 1)
    out.append(("\n" if depth else "") + DEDENT * (len(levels) - 1))
    return "".join(out)


def _lines(text: str) -> str:
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def parse_python(text: str) -> Fault | None:
    """None if ``text`` parses as Python 3."""
    text = _lines(text)
    if _FORMATTED.search(text):
        text = _without_formatted(text)
    return _parse(PYTHON, "file", text, _py_tokens)


def _parse(grammar: Grammar, rule: str, text: str, tokens) -> Fault | None:
    shape = tokens(text)
    end, far = grammar.parse(rule, shape)
    if end >= 0:
        return None
    places: list[int] = []
    tokens(text, places)
    ended = far >= len(places)
    at = len(text.rstrip()) if ended else places[far]
    line = text.count("\n", 0, at) + 1
    column = at - text.rfind("\n", 0, at)
    if not ended and shape[far] == BAD:
        opened = text.startswith(('"""', "'''", "/*"), at) or text[at : at + 3].lstrip("rRbBuUfF").startswith(('"""', "'''"))
        return Fault(line, "truncated" if opened else "syntax", "bad token" if not opened else "string or comment not closed", column)
    return Fault(line, "truncated" if ended else "syntax", "input ends too early" if ended else "token not expected", column)


# --------------------------------------------------------------------------- C++

#: One character for each class of keywords.
CC_KEYWORDS = (
    dict.fromkeys("const constexpr static inline virtual explicit mutable volatile register extern thread_local friend consteval constinit typedef final override noexcept".split(), "q")
    | dict.fromkeys("int void bool char short long float double signed unsigned auto wchar_t char8_t char16_t char32_t".split(), "t")
    | dict.fromkeys("true false nullptr this".split(), "c")
    | dict.fromkeys("class struct union".split(), "C")
    | dict.fromkeys("public private protected".split(), "A")
    | dict.fromkeys("static_cast dynamic_cast reinterpret_cast const_cast".split(), "k")
    | dict.fromkeys("sizeof alignof typeid".split(), "z")
    | {
        "namespace": "N", "enum": "e", "template": "T", "typename": "y", "using": "U", "operator": "o", "if": "I", "else": "E", "for": "F",
        "while": "h", "do": "D", "switch": "S", "case": "K", "default": "d", "return": "R", "co_return": "R", "break": "B", "continue": "B", "goto": "G",
        "try": "Q", "catch": "X", "throw": "Z", "new": "w", "delete": "x", "decltype": "l", "static_assert": "a", "requires": "r", "concept": "u",
        "co_await": "w", "co_yield": "w", "alignas": "g", "and": "P", "or": "P", "not": "!", "asm": "n",
    }
)
#: Operators of several characters; those that begin with ``>`` stay apart, since ``>>`` may close two templates.
CC_OPERATORS = "<=> ->* <<= ... -> :: && || ++ -- == != <= += -= *= /= %= ^= &= |= << .*".split()
_CC_OPS = {op: chr(0xE100 + k) for k, op in enumerate(CC_OPERATORS)}
_CC_BRACKETS = re.compile(r"[(){}\[\];]")


def _stop(whole: bool, built: bool = False):
    """Stop function: the first ``;`` (``whole``: brackets of all kinds are passed over) or ``{`` outside brackets.

    ``built``: a ``{`` after a name or ``>`` is the initialiser of a member and passed over.
    """

    def run(text: str, at: int) -> int:
        depth = 0
        for m in _CC_BRACKETS.finditer(text, at):
            c = m[0]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{":
                if not depth and not whole and not (built and text[m.start() - 1] in "n>"):
                    return m.start()
                depth += 1
            elif c == "}":
                depth -= 1
            elif not depth:
                return m.end()
            if depth < 0:
                return m.start()
        return len(text)

    return run


CPP = Grammar(
    r"""
unit <- nitem* '\0'
nitem <- ';' / linkage '{' ~ nitem* '}' / scope '{' ~ nitem* '}' / enum '{' ~ enumerators '}' tail / klass '{' ~ citem* '}' tail / function '{' ~ fbody / built '{' ~ fbody / macro '{' ~ fbody / nline / caps
citem <- ';' / access / enum '{' ~ enumerators '}' tail / klass '{' ~ citem* '}' tail / function '{' ~ fbody / built '{' ~ fbody / macro '{' ~ fbody / nline / caps
sitem <- ';' / '{' ~ sitem* '}' / if_head ~ sitem ('E' sitem)? / loop_head ~ sitem / 'D' ~ sitem do_end / 'Q' ~ '{' sitem* '}' handler handler* / label ~ (&'}' / sitem)
 / klass '{' ~ citem* '}' tail / enum '{' ~ enumerators '}' tail / macro '{' ~ sitem* '}' / sline
fbody <- sitem* '}' handler*
handler <- catch '{' sitem* '}'
catch@head <- 'X' '(' (param / '...') ')'
access <- 'A' [nM]? ':' / [nM] ':' !'0'
linkage@head <- 'q' 's'
scope@head <- 'q'* 'N' attr* ('q'* [nM] ('::' 'q'* [nM])*)?
enum@head <- 'q'* 'e' 'C'? attr* prefix? qname? (':' type)?
caps@head <- 'M' caps_args / 'M' &[AqtnMCe};~]
caps_args <- '(' (macro_arg (',' macro_arg)*)? ')'
prefix <- attr* 'M' caps_args? &([nMtqCey] / '::' / '[' '[')
klass@head <- thead* prefix? 'q'* 'C' attr* prefix? (qname 'q'*)? (':' bases)?
function@head <- thead* fcore / thead* prefix fcore
fcore <- (attr* type ptr* fname / attr* qual* fname) '(' params? ')' fnq* 'Q'? inits?
built@built <- thead* attr* qual* fname '(' params? ')' fnq* 'Q'? inits
macro@head <- [nM] '(' (macro_arg (',' macro_arg)*)? ')'
macro_arg <- expr &[,)] / type declarator? &[,)] / [Ce] [nM] / binop / 's'
if_head@head <- 'I' 'q'? '(' cond ')' / 'I' 'q'
loop_head@head <- 'F' '(' forhead ')' / [hS] '(' cond ')'
do_end@whole <- 'h' '(' expr ')' ';'
label@head <- 'K' ternary ('...' ternary)? ':' / 'd' ':' / [nM] ':'
tail@whole <- (var (',' var)*)? attr* ';'
nline@whole <- plain / prefix plain
plain <- using ';' / alias ';' / friend ';' / asserted ';' / tdecl ';' / vars ';' / decl ';' / bare ';' / macro ';'
sline@whole <- ret ';' / using ';' / alias ';' / friend ';' / asserted ';' / vars ';' / decl ';' / bare ';' / expr (',' expr)* ';' / prefix vars ';' / macro ';'
qname <- '::'? part ('::' 'T'? (part / '~' [nM] / oper))*
part <- [nM] tmpl?
oper <- 'o' ('(' ')' / '[' ']' / 'w' / 'x' / '<=>' / '->*' / '->' / '==' / '!=' / '<=' / '>' '>' '=' / '>' '>' / '>' '=' / '<<=' / '<<' / '&&' / '||' / '++' / '--' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|=' / [+\-*/%^&|~!=<>,] / 's' [nM] / 's' / type)
tmpl <- '<' (targ (',' targ)*)? '>'
targ <- type '...'? &[,>] / type '(' params? ')' '...'? &[,>] / type abstract '...'? &[,>] / shift '...'?
attr <- '[' '[' attr_in* ']' ']' / 'g' '(' (type / expr) ')'
attr_in <- [nM:,0scyqt] / '::' / '(' attr_in* ')'
type <- attr* qual* base qual* ptr*
qual <- 'q' ('(' expr ')' / 's')?
base <- 'l' '(' 't' ')' / 't' ('t' / 'q')* / 'y' qname / [Ce] qname / 'l' '(' expr ')' ('::' part)* / qname
ptr <- '*' / '&&' / '&' / 'q' / 'M' &([nM] / 'o') / qname '::' '*'
params <- param (',' param)* (',' '...')? / '...' / 't' &')'
param <- attr* type '...'? (declarator / abstract)? ('=' (braces / expr))?
abstract <- '(' ptr+ ')' '(' params? ')' / ('[' expr? ']')+
declarator <- ptr* '...'? core suffix*
core <- [nM] !'::' / '(' ptr+ [nM]? ')' / '(' [nM] ')' / qname_d
qname_e <- '::'? part_e ('::' 'T'? (part_e / '~' [nM] / oper))*
part_e <- [nM] (tmpl ![nM0sctz])?
qname_d <- '::'? (part '::')* ('~' [nM] / oper / part)
suffix <- '[' expr? ']' / '(' params? ')' fnq*
fnq <- 'q' ('(' expr ')')? / '&&' / '&' / '->' type / 'Z' '(' (type (',' type)*)? ')' / 'r' either / attr
vars <- attr* type var (',' var)*
var <- declarator (':' either)? init? / ptr* '[' [nM] (',' [nM])* ']' init
init <- '=' ('d' / 'x' / braces / expr) / braces / '(' args? ')'
braces <- '{' (brace_span brace (',' brace)* ','? / brace_span / brace (',' brace)* ','?)? '}'
brace_span <- [0cs] ',' ([0cs] ',')*
brace <- '.' [nM] ('=' expr / braces) / '[' expr ']' '=' expr / braces / expr '...'?
args <- (braces / expr '...'?) (',' (braces / expr '...'?))*
expr <- 'Z' expr? / assign
assign <- ternary (assignop (braces / assign))?
assignop <- '<<=' / '>' '>' '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '='
ternary <- either ('?' expr ':' expr)?
either <- unary (binop unary)*
binop <- '<=>' / '<<' / '>' '>' !'=' / '<=' / '>' '=' / '==' / '!=' / '&&' / '||' / '->*' / '.*' / [+\-*/%&|^<P] / '>' !'>'
shift <- unary (sbin unary)* ('?' shift ':' shift)?
sbin <- '==' / '!=' / '&&' / '||' / '<=' / '<<' / [+\-*/%&|^P]
unary <- ('++' / '--' / [!~*&+\-]) unary / 'z' '...'? ('(' type ')' / unary) / '(' type abstract ')' unary / '(' type ')' unary_cast / 'w' ('(' args ')')? newtype / 'w' unary / 'x' ('[' ']')? unary / postfix
unary_cast <- !('++' / '--' / [+\-*&(\[]) unary / braces
newtype <- type ('[' expr ']')* ('(' args? ')' / braces)?
postfix <- primary post*
post <- '[' (braces / args)? ']' / '(' args? ')' / '->' 'T'? ('~'? qname / oper) / '.' 'T'? ('~'? qname / oper) / '++' / '--' / braces
primary <- lambda / 'k' '<' type abstract? '>' '(' expr ')' / 's' ('s' / [nM] &'s')* / '0' / 'c' / '(' (fold / expr (',' expr)*) ')' / '(' body ')' / 't' ('t' / 'q')* ('(' args? ')' / braces) / 'y' qname ('(' args? ')' / braces) / 'l' '(' (expr / 't') ')' ('::' part)* / qname_e / oper / 'r' ('(' params? ')')? body / 'z' '...' '(' [nM] ')'
fold <- expr ',' '...' / '...' binop unary / unary binop '...' (binop unary)?
lambda <- '[' capture* ']' tmpl_head? ('(' params? ')')? fnq* body
capture <- [&=*,c] / '...' / [nM] ('=' expr / braces)?
tmpl_head <- '<' params? '>'
body <- '{' sitem* '}'
cond <- (vars / expr)? ';' (vars / expr) / vars &')' / expr (',' expr)*
forhead <- (vars ';')? vars_in ':' (braces / expr) / (vars / expr (',' expr)*)? ';' (vars &';' / expr (',' expr)*)? ';' (expr (',' expr)*)?
vars_in <- attr* type ptr* ([nM] / '[' [nM] (',' [nM])* ']')
ret <- 'R' (braces / expr (',' expr)*)? / 'B' / 'G' [nM]
using <- 'U' ('N' qname / 'e'? 'y'? qname (',' 'y'? qname)* '...'?)
alias <- 'U' [nM] attr* '=' type ('(' params? ')' / abstract)? / 'N' [nM] '=' qname
friend <- qual+ 'C'? type
asserted <- 'a' '(' expr (',' 's' 's'*)? ')'
tdecl <- ('T' tmpl_params requires?)+ prefix? (alias / vars / decl / bare / 'C' qname / 'u' [nM] '=' expr) / 'q'? 'T' prefix? ('C' prefix? qname / vars / decl)
tmpl_params <- '<' (tparam (',' tparam)*)? '>'
tparam <- ('T' tmpl_params)? [Cy] '...'? [nM]? ('=' type)? &[,>] / type '...'? [nM]? ('=' shift)?
requires <- 'r' postfix (('&&' / '||') postfix)*
decl <- attr* qual* ('~'? qname_d / type oper / oper) '(' params? ')' fnq* ('=' ('0' / 'd' / 'x'))?
bare <- attr* qual* ('C' / 'e' 'C'?) attr* prefix? qname (':' type)? / 'e' 'C'? [nM] ':' type
thead <- 'T' tmpl_params requires?
bases <- base_spec (',' base_spec)*
base_spec <- ('A' / 'q')* 'y'? qname '...'?
fname <- qname_d
inits <- ':' mem (',' mem)*
mem <- qname ('(' args? ')' / braces) '...'?
enumerators <- (enumerator (',' enumerator)* ','?)?
enumerator <- [nM] attr* ('=' ternary)?
""",
    _CC_OPS,
    {"head": _stop(False), "built": _stop(False, True), "whole": _stop(True)},
)

_CC = re.compile(
    r"\s*+(//(?:[^\\\n]|\\.)*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+|#(?:\"(?:[^\"\\\n]|\\.)*+\"|/\*(?:[^*]|\*(?!/))*+(?:\*/)?+|//[^\n]*+|[^\\\n]|\\.)*+|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*+\"(?:[A-Za-z_]\w*+)?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)++'|[^\W\d]\w*+|"
    r"\.?\d(?:[eEpP][+-]|'?[\w.])*+|<=>|->\*|<<=|\.\.\.|->|::|&&|\|\||\+\+|--|[-=!<+*/%^&|]=|<<|\.\*|.)",
    re.S,
)
_CC_NUMBER = re.compile(r"(?:0[xX][\da-fA-F']*\.?[\da-fA-F']*(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d[\d']*)?)(?:[A-Za-z_]\w*)?")
_CC_RAW = re.compile(r'(?<!\w)(?:u8|[uUL])?R"([^()\\\s]{0,16})\(.*?(?:(\)\1")|\Z)', re.S)
_CC_DIRECTIVE = re.compile(r"#[ \t]*([^\W\d]*)(.*)", re.S)
#: Directives of the preprocessor.
_DIRECTIVES = frozenset("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line import region endregion".split())
_IF, _ELSE, _ENDIF = "\x11", "\x12", "\x13"
_CC_CAPITALS = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_CC_SIGNS = frozenset("()[]{},:.;?=+-*/%&|^~!<>")


def _cc_code(token: str) -> str:
    """One character for a token, none for what is skipped, ``BAD`` for what no C++ file may hold."""
    c = token[0]
    if token.startswith("//"):
        return ""
    if token.startswith("/*"):
        return "" if len(token) > 3 and token.endswith("*/") else BAD
    if token in _CC_OPS:
        return _CC_OPS[token]
    if c == "#":
        word, rest = _CC_DIRECTIVE.fullmatch(token).groups()
        if word and word not in _DIRECTIVES or not word and rest.strip():
            return BAD
        return _IF if word in ("if", "ifdef", "ifndef") else _ENDIF if word == "endif" else _ELSE if word.startswith("el") else ""
    if c in "0123456789" or c == "." and len(token) > 1:
        return "0" if _CC_NUMBER.fullmatch(token) and not re.fullmatch(r"0[0-7']*[89][\d']*[uUlL]*", token) else BAD
    if len(token) > 1 and ('"' in token or "'" in token):
        return "s"
    if c in _CC_SIGNS:
        return c
    return CC_KEYWORDS.get(token) or ("M" if _CC_CAPITALS.fullmatch(token) else "n" if token.replace("$", "").isidentifier() else BAD)


_CC_CODES = _Memo(_cc_code)


def _cc_tokens(text: str, places: list[int] | None = None) -> str:
    """One character a token; directives that do not balance are bad tokens."""
    shape = "".join(map(_CC_CODES.__getitem__, _CC.findall(text)))
    offsets = [m.start(1) for m in _CC.finditer(text) if _CC_CODES[m[1]]] if places is not None else None
    if _IF in shape or _ELSE in shape or _ENDIF in shape:
        bad, opened = set(), []
        for m in re.finditer(f"[{_IF}{_ELSE}{_ENDIF}]", shape):
            if m[0] == _IF:
                opened.append(m.start())
            elif not opened:
                bad.add(m.start())
            elif m[0] == _ENDIF:
                opened.pop()
        keep = [k for k, c in enumerate(shape) if c not in (_IF, _ELSE, _ENDIF) or k in bad]
        unclosed = bool(opened)
        shape = "".join(BAD if k in bad else shape[k] for k in keep) + ("(" if unclosed else "")  # an open condition goes on to the end
        offsets = [offsets[k] for k in keep] if offsets is not None else None
    depth = 0
    for m in _CC_BRACKETS.finditer(shape) if shape.count("(") + shape.count("[") + shape.count("{") > 256 else ():
        depth += 1 if m[0] in "([{" else -1 if m[0] in ")]}" else 0
        if depth > 256:
            shape = shape[: m.start()] + BAD + shape[m.end() :]
            break
    if places is not None:
        places += offsets
    return shape


def parse_cpp(text: str) -> Fault | None:
    """None if ``text`` parses as C++."""
    text = _lines(text)
    if 'R"' in text:
        text = _CC_RAW.sub(lambda m: f'"{_masked(m[0])}"' if m[2] else BAD + m[0][1:], text)
    return _parse(CPP, "unit", text, _cc_tokens)


def _masked(raw: str) -> str:
    """As many characters as the inside of a raw string; line ends are kept, each behind a backslash."""
    return re.sub(r"(?s).\n|[^\n]", lambda m: "\\\n" if len(m[0]) == 2 else "x", raw[1:-1])


# --------------------------------------------------------------------------- operator

_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}\r?$")
_OTHER = {
    "python": re.compile(r"\s*(?:#include|#pragma once|//|/\*|<!DOCTYPE|<html|<\?xml|namespace \w+ *\{|#!/bin/(?:ba)?sh|template *<)", re.I),
    "cpp": re.compile(r"\s*(?:\"\"\"|'''|def \w|import \w|from [\w.]+ import|class \w+(?:\(.*\))?:|<!DOCTYPE|<html|<\?xml|#!/|# \w+ \w+|\{\s*\")", re.I),
}
_PARSERS = {"python": parse_python, "cpp": parse_cpp}


def check(text: str, language: str) -> Fault | None:
    """The fault of one file, None if it parses."""
    try:
        fault = _PARSERS[language](text)
    except (Undecided, RecursionError, MemoryError):  # one file must not end the job
        return Fault(1, "undecided", "parser gave up")
    if fault is None:
        return None
    if _CONFLICT.search(text):
        fault.cause = "merge_conflict"
    elif _OTHER[language].match(text) and fault.line <= 25:
        fault.cause = "wrong_language"
    return fault


def language_of(path) -> F.Column:
    """Language by extension, null for others."""
    end = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(end.isin(".py", ".pyi"), "python").when(end.isin(".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"), "cpp")


def faults(df: DataFrame, *, id_column: str = "file_id", path_column: str = "path", text_column: str = "content") -> DataFrame:
    """``file_id, language, line, col, cause, detail`` of each file that does not parse (or, cause ``undecided``, is not known to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fault = check(text.as_py(), language)
                if fault:
                    rows.append((key, language, fault.line, fault.column, fault.cause, fault.detail))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file_id", "language", "line", "col", "cause", "detail"])

    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), language_of(F.col(path_column)).alias("language"), F.col(text_column).cast("string").alias("content"))
    rows = spread(rows.where(F.col("file_id").isNotNull() & F.col("language").isNotNull() & (F.octet_length("content") > 0)))
    out = rows.mapInArrow(run, "file_id bigint, language string, line int, col int, cause string, detail string")
    return out.dropDuplicates(["file_id"]).withColumnRenamed("file_id", id_column)


def rates(files: DataFrame, statistics: DataFrame) -> DataFrame:
    """Per repository and language: files, files that do not parse by cause, rate, and the most ``files_failed`` recorded."""
    once = files.select("file_id", "repo", language_of(F.col("path")).alias("language"), F.col("content").isNotNull().alias("readable")).where("language is not null").groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("language").alias("language"), F.max("readable").alias("readable"))
    bad = faults(files).select("file_id", "cause")
    counted = once.join(bad, "file_id", "left").groupBy("repo", "language").agg(
        F.count_if("readable").alias("files"),
        F.count_if(F.col("cause") != "undecided").alias("failed"),
        *[F.count_if(F.col("cause") == c).alias(c) for c in ("merge_conflict", "truncated", "wrong_language", "syntax", "undecided")],
    )
    recorded = statistics.groupBy("repo").agg(F.max("files_failed").alias("recorded_failed"))
    rate = F.when(F.col("files") > 0, F.col("failed") / F.col("files")).otherwise(0.0)
    return counted.join(recorded, "repo", "left").withColumn("rate", rate)
