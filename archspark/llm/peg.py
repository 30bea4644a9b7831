"""Packrat parsers from parsing-expression grammars, run by a machine with its own stack.

A grammar is text, one rule a line: ``name <- expression`` with ordered choice ``/``, sequence, ``* + ?``, predicates
``& !``, groups, the cut ``~`` (no other choice after it), quoted literals and ``[...]`` sets.  The input is a string of
tokens, one character each, that ends in ``END``; a literal of several characters is one token if ``tokens`` names it,
else a sequence.

Every (rule, position) is computed once per input.  A rule written ``name@stop`` never looks beyond the place the stop
function of that name gives, so its result depends on that stretch of tokens alone and is remembered beyond the input:
a stretch of the same tokens is parsed once per worker.  Calls need no stack of the host language, so the nesting of an
input is bounded by memory only.  ``furthest`` is the furthest token at which a match failed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

END = "\0"
_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*')|(\[(?:[^\]\\]|\\.)*\])|([/*+?&!()~]))")
CHAR, SET, CALL, SHARED, RETURN, CHOICE, COMMIT, LOOP, AGAIN, MAYBE, NOT, NOTSET, FAIL, AND, ANDSET, ACCEPT, CUT = range(17)
_CALLED, _BACK, _OPTIONS, _NO, _YES = range(5)

#: Results a grammar remembers beyond one input at most, the longest stretch kept, and results of one input.
SHARED_RESULTS, SHARED_LENGTH, INPUT_RESULTS = 300_000, 1_000, 1_500_000


class Undecided(Exception):
    """An input took more steps than any that is read in linear time."""


class Grammar:
    """A grammar compiled to instructions."""

    def __init__(self, source: str, tokens: dict[str, str] | None = None, stops: dict[str, Callable[[str, int], int]] | None = None) -> None:
        self.tokens, self.stops = tokens or {}, stops or {}
        self.trees: dict[str, tuple] = {}
        self.stop_of: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", source.strip()).splitlines():
            head, _, body = line.partition("<-")
            name, _, stop = head.strip().partition("@")
            self.trees[name] = self._read(body)
            if stop:
                self.stop_of[name] = stop
        self.numbers = {name: k for k, name in enumerate(self.trees)}
        self.firsts = self._firsts()
        self.ops: list[int] = []
        self.xs: list = []
        self.ys: list = []
        self.entries: dict[str, int] = {}
        calls: list[tuple[int, str]] = []
        for name, tree in self.trees.items():
            self.entries[name] = len(self.ops)
            self._emit(tree, calls)
            self._add(RETURN)
        for at, name in calls:
            self.xs[at] = self.entries[name]
        self.shared: dict = {}

    # ------------------------------------------------------------------ reading

    def _read(self, body: str) -> tuple:
        words = [m.group().strip() for m in _TOKEN.finditer(body)]
        assert "".join(words).replace(" ", "") == re.sub(r"\s", "", body), body
        words.append("")
        place = 0

        def choice() -> tuple:
            nonlocal place
            options = [sequence()]
            while words[place] == "/":
                place += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else ("choice", options)

        def sequence() -> tuple:
            parts = []
            while words[place] not in ("", "/", ")"):
                parts.append(item())
            return parts[0] if len(parts) == 1 else ("sequence", parts)

        def item() -> tuple:
            nonlocal place
            word = words[place]
            place += 1
            if word in ("&", "!"):
                return ("and" if word == "&" else "not", item())
            if word == "~":
                return ("cut",)
            if word == "(":
                found = choice()
                place += 1
            elif word[0] == "'":
                spelled = ast.literal_eval(word)
                spelled = self.tokens.get(spelled, spelled)
                found = ("set", frozenset(spelled)) if len(spelled) == 1 else ("sequence", [("set", frozenset(c)) for c in spelled])
            elif word[0] == "[":
                found = ("set", frozenset(re.sub(r"\\(.)", r"\1", word[1:-1])))
            else:
                found = ("rule", word)
            while words[place] in ("*", "+", "?"):
                found = {"*": lambda e: ("star", e), "?": lambda e: ("maybe", e), "+": lambda e: ("sequence", [e, ("star", e)])}[words[place]](found)
                place += 1
            return found

        found = choice()
        assert words[place] == "", body
        return found

    # ------------------------------------------------------------------ first sets

    def _firsts(self) -> dict[str, tuple[frozenset, bool]]:
        """(tokens a match may begin with, it may be empty) of each rule, to a fixed point."""
        known = {name: (frozenset(), False) for name in self.trees}
        while True:
            fresh = {name: self._first(tree, known) for name, tree in self.trees.items()}
            if fresh == known:
                return known
            known = fresh

    def _first(self, tree: tuple, known: dict) -> tuple[frozenset, bool]:
        kind = tree[0]
        if kind == "set":
            return tree[1], False
        if kind == "rule":
            return known[tree[1]]
        if kind in ("and", "not", "cut"):
            return frozenset(), True
        if kind in ("star", "maybe"):
            return self._first(tree[1], known)[0], True
        if kind == "choice":
            parts = [self._first(t, known) for t in tree[1]]
            return frozenset().union(*(p[0] for p in parts)), any(p[1] for p in parts)
        begin: frozenset = frozenset()
        for t in tree[1]:
            first, empty = self._first(t, known)
            begin |= first
            if not empty:
                return begin, False
        return begin, True

    def _begins(self, tree: tuple) -> frozenset | None:
        """Tokens a match must begin with, None if it may be empty."""
        first, empty = self._first(tree, self.firsts)
        return None if empty else first

    # ------------------------------------------------------------------ instructions

    def _add(self, op: int, x=None, y=None) -> int:
        self.ops.append(op)
        self.xs.append(x)
        self.ys.append(y)
        return len(self.ops) - 1

    def _emit(self, tree: tuple, calls: list[tuple[int, str]]) -> None:
        kind = tree[0]
        if kind == "set":
            if len(tree[1]) == 1:
                self._add(CHAR, next(iter(tree[1])))
            else:
                self._add(SET, tree[1])
        elif kind == "rule":
            name = tree[1]
            shared = name in self.stop_of
            at = self._add(SHARED if shared else CALL, None, (name, self.numbers[name], self._begins(tree), self.stops[self.stop_of[name]] if shared else None))
            calls.append((at, name))
        elif kind == "sequence":
            for t in tree[1]:
                self._emit(t, calls)
        elif kind == "cut":
            self._add(CUT)
        elif kind == "choice":
            head = self._add(CHOICE)
            begins, commits, entries = [self._begins(t) for t in tree[1]], [], []
            for t in tree[1]:
                entries.append(len(self.ops))
                self._emit(t, calls)
                commits.append(self._add(COMMIT))
            after = len(self.ops)
            for at in commits:
                self.xs[at] = after
            tokens = frozenset().union(*(b for b in begins if b))
            table = {c: tuple(e for e, b in zip(entries, begins) if b is None or c in b) for c in tokens}
            self.xs[head], self.ys[head] = table, tuple(e for e, b in zip(entries, begins) if b is None)
        elif kind in ("star", "maybe"):
            begins = self._begins(tree[1])
            head = self._add(LOOP if kind == "star" else MAYBE, None, begins)
            self._emit(tree[1], calls)
            self._add(AGAIN if kind == "star" else COMMIT, head + 1 if kind == "star" else len(self.ops) + 1, begins)
            self.xs[head] = len(self.ops)
        else:
            inner = tree[1]
            if inner[0] == "set":
                self._add(NOTSET if kind == "not" else ANDSET, inner[1])
                return
            head = self._add(NOT if kind == "not" else AND)
            self._emit(inner, calls)
            self._add(FAIL if kind == "not" else ACCEPT)
            self.xs[head] = len(self.ops)

    # ------------------------------------------------------------------ the machine

    def parse(self, rule: str, text: str) -> tuple[int, int]:
        """End of what the rule matches (-1: nothing) and the furthest failure; ``text`` is ended here."""
        return self._run(rule, text + END, True)

    def matches(self, rule: str, text: str) -> bool:
        """The rule consumes the whole text."""
        return self.parse(rule, text)[0] == len(text)

    def _remembered(self, name: str, number: int, stretch: str) -> tuple[int, int]:
        key = (number, stretch)
        found = self.shared.get(key)
        if found is None:
            found = self._run(name, stretch + END, False)
            if len(stretch) <= SHARED_LENGTH:
                if len(self.shared) >= SHARED_RESULTS:
                    self.shared.clear()
                self.shared[key] = found
        return found

    def _run(self, rule: str, text: str, outer: bool) -> tuple[int, int]:
        ops, xs, ys, shared = self.ops, self.xs, self.ys, self.shared
        rules = len(self.numbers)
        memo: dict[int, int] = {}
        stack: list[tuple] = []
        push, pop = stack.append, stack.pop
        at = furthest = quiet = steps = 0
        most = 3_000 * len(text) + 1_000_000
        pc = self.entries[rule]
        while True:
            op = ops[pc]
            if op == CHAR:
                if text[at] == xs[pc]:
                    at += 1
                    pc += 1
                    continue
            elif op == CALL or op == SHARED:
                name, number, begins, stop = ys[pc]
                if begins is None or text[at] in begins:
                    if op == SHARED and outer:
                        stretch = text[at : stop(text, at)]
                        end, far = shared.get((number, stretch)) or self._remembered(name, number, stretch)
                        if at + far > furthest and not quiet:
                            furthest = at + far
                        if end >= 0:
                            at += end
                            pc += 1
                            continue
                    else:
                        key = at * rules + number
                        end = memo.get(key)
                        if end is None:
                            steps += 1
                            push((_CALLED, pc + 1, key))
                            pc = xs[pc]
                            continue
                        if end >= 0:
                            at = end
                            pc += 1
                            continue
            elif op == COMMIT:
                pop()
                pc = xs[pc]
                continue
            elif op == CHOICE:
                options = xs[pc].get(text[at], ys[pc])
                if options:
                    push((_OPTIONS, options, at, 1))
                    pc = options[0]
                    continue
            elif op == RETURN:
                if not stack:
                    return at, furthest
                _, pc, key = pop()
                memo[key] = at
                continue
            elif op == LOOP or op == MAYBE:
                begins = ys[pc]
                if begins is not None and text[at] not in begins:
                    pc = xs[pc]
                else:
                    push((_BACK, xs[pc], at))
                    pc += 1
                continue
            elif op == AGAIN:
                begins = ys[pc]
                if at == stack[-1][2] or begins is not None and text[at] not in begins:
                    pop()
                    pc += 1
                else:
                    stack[-1] = (_BACK, pc + 1, at)
                    pc = xs[pc]
                continue
            elif op == SET:
                if text[at] in xs[pc]:
                    at += 1
                    pc += 1
                    continue
            elif op == NOTSET:
                if text[at] not in xs[pc]:
                    pc += 1
                    continue
            elif op == ANDSET:
                if text[at] in xs[pc]:
                    pc += 1
                    continue
            elif op == NOT or op == AND:
                push((_NO if op == NOT else _YES, xs[pc], at))
                quiet += 1
                pc += 1
                continue
            elif op == ACCEPT:
                _, pc, at = pop()
                quiet -= 1
                continue
            elif op == CUT:
                _, _, begun, _ = stack[-1]
                stack[-1] = (_OPTIONS, (), begun, 0)
                pc += 1
                continue
            else:  # FAIL: what must not match has matched
                _, _, at = pop()
                quiet -= 1
            # a failure: back to the last place with something else to try
            if at > furthest and not quiet:
                furthest = at
            if steps > most:
                raise Undecided
            if len(memo) > INPUT_RESULTS:
                memo.clear()
            while stack:
                frame = pop()
                kind = frame[0]
                if kind == _CALLED:
                    memo[frame[2]] = -1
                elif kind == _BACK:
                    pc, at = frame[1], frame[2]
                    break
                elif kind == _OPTIONS:
                    _, options, at, k = frame
                    if k < len(options):
                        push((_OPTIONS, options, at, k + 1))
                        pc = options[k]
                        break
                else:
                    quiet -= 1
                    if kind == _NO:
                        pc, at = frame[1], frame[2]
                        break
            else:
                return -1, furthest
