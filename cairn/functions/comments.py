"""Python source without its comments, by its own tokens."""

from __future__ import annotations

import ast
import io
import tokenize


def without_comments(source: str) -> str | None:
    """source without comments; lines that held nothing else are gone. None if it can't be read as Python.

    The first line's `#!` and an encoding in the first two lines stay. What is left has the same syntax tree.
    """
    try:
        before = ast.dump(ast.parse(source))
        drop: dict[int, int] = {}
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            keep = token.start[0] == 1 and token.string.startswith("#!") or token.start[0] <= 2 and "coding" in token.string
            if token.type == tokenize.COMMENT and not keep:
                drop[token.start[0]] = token.start[1]
        out = []
        for number, line in enumerate(io.StringIO(source), 1):
            if number in drop:
                code = line[: drop[number]].rstrip()
                if not code:
                    continue
                line = code + line[len(line.rstrip("\r\n")) :]
            out.append(line)
        text = "".join(out)
        return text if ast.dump(ast.parse(text)) == before else None
    except (SyntaxError, tokenize.TokenError, ValueError, RecursionError, MemoryError):
        return None
