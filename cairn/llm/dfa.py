"""One deterministic automaton for many patterns, run over all texts of a batch at once.

Patterns are parsed into one nondeterministic automaton; its deterministic states are made when a text first reaches
them, so only those that texts need exist. What a pattern looks back or ahead at beyond the character before it is
left out: a hit says that the pattern may match up to there, and an exact check follows.

Texts lie behind each other, cut into chunks that are stepped through side by side. Each chunk begins with the end of
the one before it, to find the state it starts in; where that was too short, the chunk is gone through again from the
state in which the one before it really ended. So hits don't depend on where a text is cut.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

import numpy as np

#: Characters of the chunk before that tell a chunk's first state, nearly always.
OVERLAP = 96
#: Characters that are coded together.
PIECE = 1 << 20
#: Where more states than this were made, they are forgotten before the next text, so memory is bounded.
MOST_STATES = 1 << 16
#: Texts of fewer characters are gone through one character at a time.
SHORT = 4096
_SPACE = frozenset(" \t\n\r\f\v")


class Automaton:
    """rules: name -> patterns. hits() gives, for each text, where each rule may have matched."""

    def __init__(self, rules: dict[str, list[str]], flags: int = 0):
        self.rules = list(rules)
        trees = [(k, parser.parse(p, flags)) for k, ps in enumerate(rules.values()) for p in ps]
        extra = sorted({c for _, t in trees for c in _literals(t) if ord(c) > 127 for c in (c.lower(), c.upper()) if len(c) == 1})
        self.symbols = [chr(k) for k in range(128)] + extra + [""]  # the last stands for all others
        self.index = {c: k for k, c in enumerate(self.symbols[:-1])}
        self.word = self._set(lambda c: c.isalnum() or c == "_" or c == "")
        self.space = self._set(lambda c: c in _SPACE)
        self.digit = self._set(lambda c: c.isascii() and c.isdigit())
        self.every = (1 << len(self.symbols)) - 1
        self.edges: list[list[tuple[int, int]]] = []  # per position: characters (bits), next position
        self.empty: list[list[int]] = []
        self.final: dict[int, int] = {}
        self.starts: list[tuple[int, int]] = []  # characters allowed before, position
        for k, tree in trees:
            first = self._new()
            before, items = self._before(list(tree))
            last = self._seq(items, first, tree.state.flags)
            self.final[last] = k
            self.starts.append((before, first))
        self._classes()
        self._forget()

    def _forget(self) -> None:
        """Begins anew with the one state in which texts begin."""
        self.ids: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.table = np.full((256, self.kinds), -1, dtype=np.int32)
        self.accepts = np.zeros(256, dtype=bool)
        self.found: list[tuple[int, ...]] = []
        self.begin = self._state(self._closure({p for before, p in self.starts if before >> self.index["\n"] & 1}))

    def _set(self, holds) -> int:
        return sum(1 << k for k, c in enumerate(self.symbols) if holds(c))

    def _new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _before(self, items: list) -> tuple[int, list]:
        """The characters that may stand before a match, and the pattern without what says so."""
        before = self.every
        while items:
            code, arg = items[0]
            if code is op.AT and arg in (op.AT_BEGINNING, op.AT_BEGINNING_LINE):
                before &= 1 << self.index["\n"]
            elif code in (op.ASSERT, op.ASSERT_NOT) and arg[0] < 0 and len(arg[1]) == 1:
                chars = self._chars(arg[1][0], 0)
                if chars is not None:
                    before &= chars if code is op.ASSERT else self.every & ~chars
            elif code not in (op.AT, op.ASSERT, op.ASSERT_NOT):
                break
            items = items[1:]
        return before, items

    def _one(self, code: int, flags: int) -> int:
        c = chr(code)
        both = {c, c.lower(), c.upper()} if flags & 2 else {c}
        return sum({1 << self.index.get(x, len(self.symbols) - 1) for x in both if len(x) == 1})

    def _chars(self, item, flags: int) -> int | None:
        """The characters that an item of one character matches, as bits; None if it isn't one."""
        code, arg = item
        if code is op.LITERAL:
            return self._one(arg, flags)
        if code is op.NOT_LITERAL:
            return self.every & ~self._one(arg, flags)
        if code is op.ANY:
            return self.every & ~(1 << self.index["\n"])
        if code is op.IN:
            out, negate = 0, False
            for kind, x in arg:
                if kind is op.NEGATE:
                    negate = True
                elif kind is op.LITERAL:
                    out |= self._one(x, flags)
                elif kind is op.RANGE:
                    lo, hi = x
                    out |= self._set(lambda c: c != "" and (lo <= ord(c) <= hi or flags & 2 and any(len(y) == 1 and lo <= ord(y) <= hi for y in (c.lower(), c.upper()))))
                    if hi > 127:
                        out |= 1 << len(self.symbols) - 1
                elif kind is op.CATEGORY:
                    out |= {op.CATEGORY_DIGIT: self.digit, op.CATEGORY_NOT_DIGIT: self.every & ~self.digit, op.CATEGORY_SPACE: self.space, op.CATEGORY_NOT_SPACE: self.every & ~self.space, op.CATEGORY_WORD: self.word, op.CATEGORY_NOT_WORD: self.every & ~self.word}[x]
            return self.every & ~out if negate else out
        return None

    def _seq(self, items, at: int, flags: int) -> int:
        for item in items:
            at = self._item(item, at, flags)
        return at

    def _item(self, item, at: int, flags: int) -> int:
        code, arg = item
        chars = self._chars(item, flags)
        if chars is not None:
            to = self._new()
            self.edges[at].append((chars, to))
            return to
        if code is op.SUBPATTERN:
            return self._seq(arg[3], at, (flags | arg[1]) & ~arg[2])
        if code is op.BRANCH:
            to = self._new()
            for branch in arg[1]:
                self.empty[self._seq(branch, at, flags)].append(to)
            return to
        if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            for _ in range(least):
                at = self._seq(inner, at, flags)
            if most is op.MAXREPEAT:
                loop = self._new()
                self.empty[at].append(loop)
                self.empty[self._seq(inner, loop, flags)].append(loop)
                return loop
            to = self._new()
            self.empty[at].append(to)
            for _ in range(most - least):
                at = self._seq(inner, at, flags)
                self.empty[at].append(to)
            return to
        if code is op.AT and arg in (op.AT_END, op.AT_END_LINE):
            to = self._new()
            self.edges[at].append((1 << self.index["\n"], to))
            return to
        if code in (op.AT, op.ASSERT, op.ASSERT_NOT, op.GROUPREF):
            return at  # what is looked at besides is left to the exact check
        raise ValueError(f"{code} isn't known here")

    def _classes(self) -> None:
        """Characters that no edge and no start tells apart are one kind."""
        masks = sorted({m for out in self.edges for m, _ in out} | {b for b, _ in self.starts})
        signature: dict[tuple, int] = {}
        self.kind = np.zeros(len(self.symbols), dtype=np.uint8)
        for k in range(len(self.symbols)):
            self.kind[k] = signature.setdefault(tuple(m >> k & 1 for m in masks), len(signature))
        self.kinds = len(signature)
        of = [next(k for k in range(len(self.symbols)) if self.kind[k] == j) for j in range(self.kinds)]
        self.by_kind = [[[to for m, to in out if m >> k & 1] for out in self.edges] for k in of]
        self.start_by_kind = [frozenset(p for b, p in self.starts if b >> k & 1) for k in of]
        other = self.kind[-1]
        self.lookup = np.full(1 << 16, other, dtype=np.uint8)
        for c, k in self.index.items():
            self.lookup[ord(c)] = self.kind[k]
        self.newline = int(self.kind[self.index["\n"]])

    def _closure(self, positions: set[int]) -> frozenset[int]:
        out, todo = set(positions), list(positions)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    def _state(self, positions: frozenset[int]) -> int:
        k = self.ids.get(positions)
        if k is None:
            k = self.ids[positions] = len(self.sets)
            self.sets.append(positions)
            if k == len(self.accepts):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.accepts = np.r_[self.accepts, np.zeros_like(self.accepts)]
            self.found.append(tuple(sorted({self.final[p] for p in positions if p in self.final})))
            self.accepts[k] = bool(self.found[k])
        return k

    def _step(self, state: int, kind: int) -> int:
        to = int(self.table[state, kind])
        if to < 0:
            edges = self.by_kind[kind]
            to = self._state(self._closure({p for q in self.sets[state] for p in edges[q]} | self.start_by_kind[kind]))
            self.table[state, kind] = to
        return to

    def _walk(self, kinds: bytes, state: int, offset: int, out: list[tuple[int, int]]) -> int:
        """One character after the other; out gets (place, state) where a rule may have matched."""
        table, accepts = self.table, self.accepts
        for k, kind in enumerate(kinds):
            to = table[state, kind]
            if to < 0:
                to = self._step(int(state), kind)
                table, accepts = self.table, self.accepts
            state = to
            if accepts[state]:
                out.append((offset + k, int(state)))
        return int(state)

    def _kinds(self, text: str) -> np.ndarray:
        """The kind of each character, and of the line end that closes the text; long texts are coded piece by piece."""
        out = np.full(len(text) + 1, self.newline, dtype=np.uint8)
        for at in range(0, len(text), PIECE):
            code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            out[at : at + len(code)] = self.lookup[np.minimum(code, 0xFFFF)]
        return out

    def places(self, text: str) -> list[tuple[int, int]]:
        """(place, state) wherever a rule may have matched, in order; text ends as if a line ended there.

        States hold until the next text.
        """
        if len(self.sets) > MOST_STATES:
            self._forget()
        kinds = self._kinds(text)
        out: list[tuple[int, int]] = []
        if len(kinds) <= SHORT:
            self._walk(kinds.tobytes(), self.begin, 0, out)
            return out
        width = int(min(4096, max(256, len(kinds) ** 0.5 / 2)))
        lanes = -(-len(kinds) // width)
        grid = np.full(lanes * width, self.newline, dtype=np.uint8)
        grid[: len(kinds)] = kinds
        columns = np.ascontiguousarray(grid.reshape(lanes, width).T)
        state = np.full(lanes, self.begin, dtype=np.int64)
        for j in range(max(0, width - OVERLAP), width):
            state[1:] = self._next(state[1:], columns[j, :-1])
        state[0] = self.begin
        first = state.copy()
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(width):
            state = self._next(state, columns[j])
            at = np.flatnonzero(self.accepts[state])
            if len(at):
                hits.append((at * width + j, state[at]))
        where = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
        what = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
        wrong: set[int] = set()
        last = state
        for k in np.flatnonzero(first[1:] != last[:-1]) + 1:
            k = int(k)
            while k < lanes and k not in wrong and first[k] != last[k - 1]:
                wrong.add(k)
                last[k] = self._walk(grid[k * width : (k + 1) * width].tobytes(), int(last[k - 1]), k * width, out)
                k += 1
        keep = ~np.isin(where // width, list(wrong)) if wrong else slice(None)
        out += zip(where[keep].tolist(), what[keep].tolist())
        return sorted(x for x in out if x[0] < len(kinds))

    def _next(self, state: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        to = self.table[state, kinds]
        if len(to) and to.min() < 0:
            for s, k in {(int(state[i]), int(kinds[i])) for i in np.flatnonzero(to < 0)}:
                self._step(s, k)
            to = self.table[state, kinds]
        return to.astype(np.int64)

    def lines(self, texts: list[str]) -> list[dict[int, set[str]]]:
        """Per text: where each line begins on which rules may have matched, and which rules."""
        whole = "\n".join(texts)
        out: list[dict[int, set[str]]] = [{} for _ in texts]
        text, start, end = 0, 0, len(texts[0]) if texts else 0
        places = self.places(whole)
        names = [{self.rules[k] for k in f} for f in self.found]
        line, stop = -1, -1
        for at, state in places:
            while at > end:
                text += 1
                start, end = end + 1, end + 1 + len(texts[text])
            if not line <= at <= stop:
                line = whole.rfind("\n", start, at) + 1 if at > start else start
                line = max(line, start)
                stop = whole.find("\n", at)
                stop = end if stop < 0 or stop > end else stop
            out[text].setdefault(line - start, set()).update(names[state])
        return out


def _literals(tree) -> set[str]:
    out: set[str] = set()
    for code, arg in tree:
        if code in (op.LITERAL, op.NOT_LITERAL):
            out.add(chr(arg))
        elif code is op.IN:
            out |= {chr(x) for kind, x in arg if kind is op.LITERAL}
        elif code is op.SUBPATTERN:
            out |= _literals(arg[3])
        elif code is op.BRANCH:
            out = out.union(*(_literals(b) for b in arg[1]))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            out |= _literals(arg[2])
    return out
