"""Exact redaction of one line: spans of all value-bearing rules, replaced from left to right."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import detect

MASK, LINE_MASK, KEY_MASK = "<REDACTED_SECRET>", "<REDACTED_SECRET_LINE>", "<REDACTED>"


def _python(pattern: str) -> re.Pattern:
    plain = pattern.replace(r"(?<![\p{L}\p{N}_])", r"(?<!\w)").replace(r"(?![\p{L}\p{N}_])", r"(?!\w)").replace(r"[\p{L}\p{N}_.]", r"[\w.]")
    return re.compile(plain)


_VALUE_ALL = detect.VALUE.replace(detect.SCAN_ROOTS, detect.MENTION_ROOTS)
_SPANS = [(_python(p), 0) for p in (_VALUE_ALL, detect.BEARER)] + [(re.compile(r"://[^\s/?#:@]*:([^\s/?#@]+)@"), 1), (_python(detect.HTTP_AUTH), 0)] + [(_python(p), 0) for _, p, _ in detect.PROVIDERS] + [(re.compile(detect.TELEGRAM), 0)]
_MENTION, _TOKEN, _LONG = _python(detect.MENTION), re.compile(r"[A-Za-z0-9+/=_\-]{20,}"), re.compile(r"[A-Za-z0-9+/]{12,}")


def spans(line: str) -> list[tuple[int, int]]:
    """Secret spans, not overlapping: of those that overlap, the one that begins first, then the longest, counts."""
    found = sorted({m.span(g) for rx, g in _SPANS for m in rx.finditer(line)}, key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _key(prefix: str) -> str:
    return _LONG.sub(lambda m: m[0] if m[0].isalpha() else KEY_MASK, prefix)


def replacement(secret: str, label: str = KEY_MASK) -> str:
    """The secret's key with the value masked; without a key, a mask alone."""
    key, eq, _ = secret.partition("=")
    if eq:
        return f"{_key(key)}={label}"
    key, colon, _ = secret.partition(":")
    return f"{_key(key)}: {label}" if colon else (MASK if label == KEY_MASK else label)


def redact_line(line: str | None, labels: dict[str, str] | None = None) -> str | None:
    if line is None:
        return None
    out, at = [], 0
    for s, e in spans(line):
        label = labels.get(normal(line[s:e]), KEY_MASK) if labels else KEY_MASK
        out += [line[at:s], replacement(line[s:e], label)]
        at = e
    return "".join([*out, line[at:]])


def normal(secret: str) -> str:
    """What two spellings of one secret share: the value without blanks, quotes and closing marks."""
    value = re.split(r"[=:]", secret, maxsplit=1)[-1] if re.match(r"^[^=:]*[=:]", secret) else secret
    return value.strip().rstrip(",;").strip("\"'`").strip()


def _bits(token: str) -> float:
    n = len(token)
    return -sum(token.count(c) / n * math.log2(token.count(c) / n) for c in set(token))


_MASKED = [(_python(p), 0) for _, p, _ in detect.PROVIDERS] + [(re.compile(detect.TELEGRAM), 0)]


def _masked(line: str) -> str:
    """line without what is secret by its form or looks drawn; of spans that overlap, all they reach is masked once."""
    found = [m.span() for rx, _ in _MASKED for m in rx.finditer(line)]
    found += [m.span() for m in _TOKEN.finditer(line) if _bits(m[0]) >= 4.0 or len(m[0]) >= 32 and _bits(m[0]) >= 3.0]
    out, at = [], 0
    for s, e in sorted(found):
        if s >= at:
            out += [line[at:s], KEY_MASK]
        at = max(at, e)
    return "".join([*out, line[at:]])


def message(line: str | None) -> str | None:
    """A finding's message: the redacted line; if it still mentions a secret, only its key; tokens and what looks drawn are masked."""
    if line is None:
        return None
    text = redact_line(line).strip()
    if "<REDACTED" not in text and _MENTION.search(text):
        key, eq, _ = text.partition("=")
        text = f"{_key(key.rstrip())}={KEY_MASK}" if eq else LINE_MASK
    return _masked(text)


def redact_message(line: str) -> Column:
    return F.pandas_udf(lambda s: s.map(message), "string")(line)


def redact_column(line: str) -> Column:
    return F.pandas_udf(lambda s: s.map(redact_line), "string")(line)


def secret_column(line: str) -> Column:
    """The normalised secrets of each line, in order."""
    return F.pandas_udf(lambda s: pd.Series([[normal(x[a:b]) for a, b in spans(x)] if x else [] for x in s]), "array<string>")(line)


def label_column(line: str, labels: str) -> Column:
    """The redacted lines, each secret under its own label (a map of normalised secrets)."""
    return F.pandas_udf(lambda s, m: pd.Series([redact_line(x, dict(y) if y is not None else None) for x, y in zip(s, m)], dtype="object"), "string")(line, labels)
