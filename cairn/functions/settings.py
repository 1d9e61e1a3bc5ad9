"""Fields of a JSON settings file, and what their names have in common."""

from __future__ import annotations

import hashlib
import json
import re

_STYLE = re.compile(r"[^0-9a-z]+")
_AFFIX = re.compile(r"^(?:cfg|config|setting|settings|opt|option|old|new|legacy)(?=[a-z]{3})|(?:v\d+|new|old)$")


def kind(value: object) -> str:
    """The JSON type: string, number, boolean, array, object, or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array"}.get(type(value), "object")


def _plain(value: object) -> object:
    """value with 1.0 as 1, so equal numbers have one text."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _refuse(text: str) -> None:
    raise ValueError(text)


def parse(content: str | None) -> object:
    """The JSON value, or ValueError if content isn't JSON as a whole (NaN and Infinity aren't JSON)."""
    if content is None:
        raise ValueError("null")
    try:
        return json.loads(content, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("too deep") from e


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def fields(value: object, prefix: str = "") -> list[tuple[str, str, str, str]]:
    """(path, type, digest of the value, value as text) of every key, also inside objects; arrays are values."""
    out, stack = [], [(prefix, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            for key, item in v.items():
                path = f"{at}.{key}" if at else key
                text = json.dumps(_plain(item), sort_keys=True, ensure_ascii=False)
                out.append((path, kind(item), digest(text), text))
                stack.append((path, item))
    return out


def canonical(path: str) -> str:
    """The path without what only style adds: case, separators, a cfg prefix or version suffix of a segment."""
    out = []
    for segment in path.split("."):
        plain = _STYLE.sub("", segment.lower())
        out.append(_AFFIX.sub("", plain) or plain or segment)
    return ".".join(out)


def words(path: str) -> list[str]:
    """The words of a name: snake, kebab and camel case are taken apart."""
    return [w for w in re.split(r"[^0-9a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", path).lower()) if w and not re.fullmatch(r"cfg|v\d+", w)]


def trigrams(name: str) -> set[str]:
    plain = f"^{_STYLE.sub('', name.lower())}$"
    return {plain[i : i + 3] for i in range(max(1, len(plain) - 2))}


def similarity(a: str, b: str) -> float:
    """0 to 1: 1 for names that differ only in style, else how many trigrams and words they share."""
    if canonical(a) == canonical(b):
        return 1.0
    ta, tb, wa, wb = trigrams(a), trigrams(b), set(words(a)), set(words(b))
    return max(len(ta & tb) / len(ta | tb), len(wa & wb) / len(wa | wb) if wa and wb else 0.0)


def assign(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """A matching of left and right names with the greatest total weight (successive best augmenting paths).

    Components of a revision's bipartite graph are tiny; each augmentation is a Bellman-Ford pass over its edges.
    Ties are settled by name.
    """
    edges = sorted(set(edges))
    pair: dict[str, str] = {}
    back: dict[str, str] = {}
    weight = {(a, b): w for a, b, w in edges}
    for _ in range(min(len({a for a, _, _ in edges}), len({b for _, b, _ in edges}))):
        gain = {a: (0.0, None) for a, _, _ in edges if a not in pair}
        via: dict[str, tuple[float, str]] = {}
        changed = True
        while changed:
            changed = False
            for a, b, w in edges:
                if a in gain and pair.get(a) != b and (b not in via or gain[a][0] + w > via[b][0] + 1e-12):
                    via[b], changed = (gain[a][0] + w, a), True
                    if b in back and (back[b] not in gain or via[b][0] - weight[back[b], b] > gain[back[b]][0] + 1e-12):
                        gain[back[b]] = (via[b][0] - weight[back[b], b], b)
        free = [(-g, b) for b, (g, _) in via.items() if b not in back and g > 0]
        if not free:
            break
        b: str | None = min(free)[1]
        while b is not None:
            a = via[b][1]
            before = pair.get(a)
            pair[a], back[b] = b, a
            b = before
    return sorted(pair.items())
