"""JSON of any depth, number length and string length, read without recursion; for bodies beyond the JVM parser's limits."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"[ \t\n\r]*+(?:([\[\]{},:])"
    r'|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null))"
)
_CLOSES = {"{": "}", "[": "]"}


class Value(NamedTuple):
    """A value by its place in the text; inside: the members of an object (by name) or array (in order), None for a scalar."""

    start: int
    inside: dict[str, Value] | list[Value] | None
    end: list[int]


def _plain(token: str) -> str:
    return json.loads(token).encode("utf-8", "replace").decode("utf-8")


def parse(text: str) -> Value | None:
    """The value that is the whole text; None if it isn't one JSON value. Of a repeated name the last value counts."""
    root: Value | None = None
    open_: list[Value] = []
    name: str | None = None
    at, size = 0, len(text)
    before = "value"  # what the next token may be: value, first (a value or the end), name, first name, colon, next
    while at < size:
        token = _TOKEN.match(text, at)
        if token is None:
            break
        at, start = token.end(), token.start(token.lastindex)
        sign = token[1]
        if before in ("name", "first name") and token[2]:
            name, before = _plain(token[2]), "colon"
        elif before == "colon" and sign == ":":
            before = "value"
        elif before == "next" and sign == "," and open_:
            before = "name" if isinstance(open_[-1].inside, dict) else "value"
        elif sign in ("}", "]") and open_ and before in ("next", "first", "first name") and sign == _CLOSES[text[open_[-1].start]]:
            open_.pop().end.append(at)
            before = "next"
        elif before in ("value", "first") and sign not in ("}", "]", ",", ":"):
            value = Value(start, {} if sign == "{" else [] if sign == "[" else None, [] if sign else [at])
            if not open_:
                root = value
            elif isinstance(open_[-1].inside, dict):
                open_[-1].inside[name] = value
            else:
                open_[-1].inside.append(value)
            if sign:
                open_.append(value)
            before = "first name" if sign == "{" else "first" if sign == "[" else "next"
        else:
            return None
    return root if root is not None and not open_ and before == "next" and not text[at:].strip(" \t\n\r") else None


def text_of(value: Value, text: str) -> str | None:
    """A string's characters, None for null, otherwise the value's JSON."""
    raw = text[value.start : value.end[0]]
    return _plain(raw) if raw[0] == '"' else None if raw == "null" else raw


def object_elements(root: Value) -> Iterator[tuple[str, str, Value]]:
    """(node, parent, value) of each object that is an element of an array."""
    open_ = [("", "", root)]
    while open_:
        path, parent, value = open_.pop()
        if isinstance(value.inside, dict):
            prefix = path + "." if path else ""
            open_ += [(prefix + k, parent, x) for k, x in value.inside.items() if x.inside is not None]
        else:
            for i, x in enumerate(value.inside or []):
                if x.inside is None:
                    continue
                here = f"{path}[{i}]"
                if isinstance(x.inside, dict):
                    yield here, parent, x
                    open_.append((here, here, x))
                else:
                    open_.append((here, parent, x))
