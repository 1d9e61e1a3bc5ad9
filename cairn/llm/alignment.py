"""Texts of one template aligned with each other: what varies between them is a slot, what a slot holds is judged.

A text has up to three signatures, each the digest of what stays when a template is filled: how its lines begin,
how they end, and its labels and headings alone. Texts with a signature in common are siblings; their places (lines,
or what follows a heading) are compared with the least and the greatest value any sibling has there.
"""

from __future__ import annotations

import hashlib
import re
from difflib import SequenceMatcher

from cairn.llm.anchored import Patterns
from cairn.llm.residue import _CODE, _LABELLED, STRAY, _kind, is_source, units

#: So many texts with a signature in common are siblings, and so many slots that were never filled make a template.
SIBLINGS, OPEN_SLOTS = 3, 2

_LABEL = re.compile(r"\W*(\w[\w .\-/()]{0,40}?)\s*[:=](?:\s|$)")
_HEADING = re.compile(r"#+\s+\S|[^.!?;{}]{2,60}:$|={2,}\s*\w")
# What closes a mark that opens a name, and marks that quote or stress instead.
_MIRROR = str.maketrans("[{<(«‹", "]}>)»›")
_MARKED = re.compile(r"([^\w\s\"'`“”„.,;:!()*/|=\-]{1,3})\s?([^\W\d]\w{1,40}(?:[ .\-]\w{1,40}){0,3})\s?([^\w\s\"'`“”„.,;:!()*/|=\-]{1,3})")
_DEFAULT = re.compile(r"(?i)(?:tbd|tba|todo|fixme|unnamed|untitled|change[ _\-]?me|(?:your|insert|enter|add|fill in)[ _\-]\w+(?:[ _\-]\w+){0,2})")
_BLANK = re.compile(r"[_\-.…?\s]*")
# Elements of markup, which are marked names too.
_ELEMENTS = {"html", "head", "body", "div", "p", "span", "title", "a", "b", "i", "em", "br", "hr", "ul", "ol", "li", "tr", "td", "th", "table", "pre", "code", "nav", "main", "strong", "small", "center", "section", "header", "footer", "article", "script", "style", "string", "int", "void", "bool", "str"}
#: Characters of ASCII that can mark a name.
_MARKS = frozenset("#$%&+<>?@[\\]^{}~_")
#: Defaults in the midst of a line, and at the beginning of what follows a label.
_DEFAULT_WORD = re.compile(r"(?i)\b(?:tbd|tba|todo|fixme|unnamed|untitled|change[ _\-]?me|(?:your|insert|enter) (?:\w+ )?(?:name|title|text|address|company|here))\b")
_DEFAULT_VALUE = re.compile(r"(?i)\W{0,3}(?:tbd|tba|todo|fixme|unnamed|untitled|change[ _\-]?me|your|insert|enter|add|fill in)\b")
_DEFAULTS = Patterns({"default": _DEFAULT_WORD.pattern})


def lines_of(text: str) -> list[str]:
    return [s for s in (line.strip() for line in text.split("\n")) if s]


def _label(line: str) -> str:
    m = _LABEL.match(line) if ":" in line or "=" in line else None
    return m[1] if m else ""


def _sections(lines: list[str], labels: list[str]) -> list[tuple[str, str]]:
    """Labels and headings, each with what follows it up to the next."""
    out: list[tuple[str, list[str]]] = []
    for line, label in zip(lines, labels):
        if label:
            out.append((label, [line[_LABEL.match(line).end() :].strip()]))
        elif _HEADING.match(line):
            out.append((line, []))
        elif out:
            out[-1][1].append(line)
    return [(head, "\n".join(rest).strip()) for head, rest in out]


def _digest(kind: str, parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join([kind, *parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Frame:
    """What stays of a text when its template is filled: the signatures of its lines, and the places between them."""

    def __init__(self, text: str):
        self.lines = lines_of(text)
        self.labels = [_label(line) for line in self.lines]
        self.sections = _sections(self.lines, self.labels)

    def signatures(self) -> dict[int, str]:
        """Signature -> the kind of its places."""
        if not self.lines:
            return {}
        n = 1 if len(self.lines) > 1 else 2
        begin = [label or " ".join(line.split(None, n)[:n]) for label, line in zip(self.labels, self.lines)]
        end = [label or " ".join(line.rsplit(None, n)[-n:]) for label, line in zip(self.labels, self.lines)]
        out = {_digest("begin", begin): "lines", _digest("end", end): "lines"}
        if len(self.sections) >= 3:
            out[_digest("heads", [head for head, _ in self.sections])] = "sections"
        return out

    def places(self, kind: str) -> list[tuple[str, str]]:
        """Places in order, each a label (or '') and a value."""
        return self.sections if kind == "sections" else list(zip(self.labels, self.lines))

    def may_be_open(self) -> bool:
        """Whether enough stands here of what open slots hold; else no alignment can make it a template."""
        found, defaults = 0, bool(_DEFAULTS.hits("\n".join(self.lines).lower()))
        for label, line in zip(self.labels, self.lines):
            signs = _signs(line, defaults)
            if label:
                signs += _left_open(label, line[_LABEL.match(line).end() :])
            if signs and (_LABELLED.match(line) or not _CODE.search(_MARKED.sub("S", line))):
                found += signs
                if found >= OPEN_SLOTS:
                    return True
        found += sum(_left_open(label, value) for label, value in self.sections)
        return found >= OPEN_SLOTS


def _left_open(label: str, value: str) -> bool:
    """Whether what follows a label is a blank, a default, or the label again."""
    if not value or _BLANK.fullmatch(value):
        return True
    same = value[0].lower() == label[0].lower() or not value[0].isalnum()
    return same and _first(value) == _first(label) and _bare(value) == _bare(label) or _DEFAULT_VALUE.match(value) is not None


def _signs(line: str, defaults: bool) -> int:
    """Marked names, but for markup, and words of defaults on a line."""
    marked = 0
    if not (line.isascii() and _MARKS.isdisjoint(line)):
        marked = sum(m[3] == m[1][::-1].translate(_MIRROR) and m[2].lower() not in _ELEMENTS for m in _MARKED.finditer(line))
    return marked + (1 if defaults and _DEFAULT_WORD.search(line) else 0)


def places(text: str) -> dict[int, list[tuple[str, str]]]:
    """Per signature of text: its places in order, each a label (or '') and a value."""
    frame = Frame(text)
    return {signature: frame.places(kind) for signature, kind in frame.signatures().items()}


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def _first(text: str) -> str:
    m = re.search(r"[^\W_]", text)
    return m[0].lower() if m else ""


def unfilled(value: str, label: str = "") -> bool:
    """Whether a slot's value is the name of a variable or of the slot, a default or a blank."""
    v = value.strip().strip(".,;:!")
    if _BLANK.fullmatch(v):
        return bool(label)
    m = _MARKED.fullmatch(v)
    if m and m[3] == m[1][::-1].translate(_MIRROR):
        return True
    return bool(_DEFAULT.fullmatch(v)) or bool(label) and _bare(v) == _bare(label)


def values(own: str, sibling: str, label: str) -> list[str]:
    """What stands in own where sibling has something else, word by word; all that follows a label is one value."""
    if own == sibling:
        return []
    m = _LABEL.match(own)
    if m and m[1] == label and sibling.startswith(own[: m.end()].rstrip()):
        return [own[m.end() :].strip()]
    if label and not m:
        return [own]
    a, b = own.split(), sibling.split()
    return [" ".join(a[i:j]) for op, i, j, _, _ in SequenceMatcher(None, a, b, False).get_opcodes() if op != "equal" and j > i]


def open_template(text: str, signature: int, varying: dict[int, tuple[str, str]], lang: str | None = None, path: str | None = None) -> int:
    """How many slots of text were never filled, or 0 if it isn't an open template: most slots are filled, or what fills them is content.

    varying: place -> least and greatest value of all siblings, where these differ.
    """
    if is_source(text, lang, path):
        return 0
    opened = filled = content = 0
    for k, (label, value) in enumerate(places(text).get(signature, [])):
        if k not in varying:
            continue
        low, high = varying[k]
        for v in values(value, high if value == low else low, label):
            if unfilled(v, label):
                opened += 1
            else:
                filled += 1
                content += sum(_kind(u) == "content" for u in units(v))
    return opened if opened >= OPEN_SLOTS and opened > filled and content <= STRAY else 0
