"""Many patterns behind one automaton: each is tried only where a text holds a literal that it can't do without.

The literals are taken from the patterns themselves, so none is typed beside them and none can be forgotten.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

try:
    import ahocorasick
except ImportError:  # the literals are then looked for one by one
    ahocorasick = None


def alternatives(pattern: str) -> list[str]:
    """The branches of pattern at its top level; flags at its head go with each."""
    flags = re.match(r"\(\?[aimsx]+\)", pattern)
    head, body = (flags[0], pattern[flags.end() :]) if flags else ("", pattern)
    out, depth, start, k, inside = [], 0, 0, 0, False
    while k < len(body):
        c = body[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += (body[k + 1 : k + 2] == "^") + (body[k + 1 : k + 3].lstrip("^")[:1] == "]")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(head + body[start:k])
            start = k + 1
        k += 1
    return [*out, head + body[start:]]


def _best(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Of two sets of literals the one with the longer shortest literal, then the fewer."""
    if not a or not b:
        return a or b
    score = lambda s: (min(map(len, s)), -len(s))
    return a if score(a) >= score(b) else b


def _required(tree) -> set[str] | None:
    best: set[str] | None = None
    run = ""

    def end() -> None:
        nonlocal run, best
        if run:
            best, run = _best(best, {run}), ""

    for code, arg in tree:
        if code is op.LITERAL:
            run += chr(arg).lower()
        elif code is op.AT or code in (op.ASSERT, op.ASSERT_NOT):
            continue
        elif code is op.SUBPATTERN:
            end()
            best = _best(best, _required(arg[3]))
        elif code is op.BRANCH:
            end()
            parts = [_required(branch) for branch in arg[1]]
            if all(parts):
                best = _best(best, set().union(*parts))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            if least and len(inner) == 1 and inner[0][0] is op.LITERAL:
                run += chr(inner[0][1]).lower() * min(least, 16)
                if most != least:
                    end()
            else:
                end()
                if least:
                    best = _best(best, _required(inner))
        elif code is op.IN and len(arg) == 1 and arg[0][0] is op.LITERAL:
            run += chr(arg[0][1]).lower()
        else:
            end()
    end()
    return best


def required(pattern: str) -> set[str]:
    """Literals, in lower case, of which every match of pattern holds one; empty if there is no such set."""
    return _required(parser.parse(pattern)) or set()


class Patterns:
    """Groups of patterns, searched together.

    groups: name -> pattern, whose branches are tried one by one (required_only: as a whole). hits() runs the automaton once over a text in lower
    case; names() tells which groups they allow, and search() tries the branches that its literals allow, in the order in which they are written.
    """

    def __init__(self, groups: dict[str, str], flags: int = 0, required_only: bool = False):
        self.branches = {name: [re.compile(b, flags) for b in (alternatives(p) if not required_only else [p])] for name, p in groups.items()}
        self.free = {name: [k for k, rx in enumerate(b) if not required(rx.pattern)] for name, b in self.branches.items()}
        words: dict[str, list[tuple[str, int]]] = {}
        for name, branches in self.branches.items():
            for k, rx in enumerate(branches):
                for literal in required(rx.pattern):
                    words.setdefault(literal, []).append((name, k))
        self._scan = _literals(words)

    def hits(self, low: str) -> set[tuple[str, int]]:
        found: set[tuple[str, int]] = set()
        for branches in self._scan(low):
            found.update(branches)
        return found

    def names(self, low: str) -> set[str]:
        """The groups that may match a text, given in lower case."""
        return {name for name, _ in self.hits(low)} | {name for name, free in self.free.items() if free}

    def search(self, name: str, text: str, hits: set[tuple[str, int]]) -> re.Match | None:
        for k in sorted({*self.free[name], *(k for n, k in hits if n == name)}):
            if m := self.branches[name][k].search(text):
                return m
        return None


def _literals(words: dict[str, list]):
    """A function from a text to what belongs to each literal found in it, at every place."""
    if ahocorasick is None:
        return lambda low: (value for word, value in words.items() if word in low)
    a = ahocorasick.Automaton()
    for word, value in words.items():
        a.add_word(word, value)
    a.make_automaton()
    return lambda low: (value for _, value in a.iter(low))
