"""Literal configuration in scripts: what calls of contract viewers are given, without running anything.

A script becomes tokens (gaps and comments, strings, names, signs), and a pushdown over
them keeps a frame for each open bracket.  A call's object is read while every frame
closes; what a member is given counts as text if it is one quoted string and nothing
else, and is kept as written otherwise.  Templates with places to fill in, unknown
escapes and brackets that don't match make the whole call not literal.  The cost is
linear: a token is looked at once, and a call is read for at most MOST_CHARS.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of a script is read, and how many calls of a viewer.
MOST_SCRIPT_CHARS, MOST_CHARS, MOST_CALLS = 200_000, 50_000, 20
#: The calls of viewers.
SWAGGER_CALL = r"\bSwaggerUI(?:Bundle)?\s*\("
REDOC_CALL = r"\bRedoc\.init\s*\("

_TOKEN = re.compile(
    r"""(?s)(?P<gap>\s++|//[^\n]*+|/\*.*?\*/)
    |(?P<text>"(?:[^"\\\n]++|\\[\\'"`/])*+"|'(?:[^'\\\n]++|\\[\\'"`/])*+')
    |(?P<template>`(?:[^`\\$]++|\$(?!\{)|\\[\\'"`/])*+`)
    |(?P<name>[A-Za-z_$][\w$]*+)
    |(?P<open>[\[{(])|(?P<close>[\]})])|(?P<sign>[:,])
    |(?P<bad>["'`]|/\*)|(?P<other>.)""",
    re.X,
)
_CLOSES = {"{": "}", "[": "]", "(": ")"}
_ESCAPE = re.compile(r"\\(.)", re.S)


class NotLiteral(Exception):
    """The call isn't given a literal that can be read."""


def unquoted(text: str) -> str:
    return _ESCAPE.sub(r"\1", text[1:-1])


class Frame:
    """An open bracket: its closing sign, where it reports to, and the member that is being read."""

    __slots__ = ("closing", "members", "listed", "key", "colon", "start", "only", "tokens")

    def __init__(self, closing: str, members: dict | None = None, listed: list | None = None):
        self.closing, self.members, self.listed = closing, members, listed
        self.reset()

    def reset(self) -> None:
        self.key, self.colon, self.start, self.only, self.tokens = None, False, -1, None, 0


def object_at(code: str, at: int) -> dict[str, tuple[str, object]]:
    """Members of the object literal at a place: name -> (text, its string), (texts, strings of ``urls``) or (raw, as written)."""
    whole: dict[str, tuple[str, object]] = {}
    stack: list[Frame] = []
    for m in _TOKEN.finditer(code, at, min(len(code), at + MOST_CHARS)):
        kind, said = m.lastgroup, m.group()
        if kind == "gap":
            continue
        if kind == "bad":
            raise NotLiteral
        if not stack:
            if said != "{":
                raise NotLiteral
            stack.append(Frame("}", whole))
            continue
        top = stack[-1]
        if kind == "close":
            if said != top.closing:
                raise NotLiteral
            finished(code, top, m.start())
            stack.pop()
            if not stack:
                return whole
            continue
        if said == "," and (top.members is not None or top.listed is not None):
            finished(code, top, m.start())
            top.reset()
            continue
        if top.members is not None and top.key is None:
            if kind not in ("text", "name"):
                raise NotLiteral
            top.key = unquoted(said) if kind == "text" else said
            continue
        if top.members is not None and not top.colon and top.start < 0 and said == ":":
            top.colon = True
            continue
        if top.start < 0:
            top.start = m.start()
        top.tokens += 1
        top.only = said if kind == "text" and top.tokens == 1 and top.colon else None
        if kind == "open":
            inner = Frame(_CLOSES[said])
            if top.listed is not None:
                if said != "{" or top.tokens > 1:
                    raise NotLiteral
                inner.members = {}
                top.only = inner.members
            elif top.members is whole and top.key == "urls" and said == "[" and top.tokens == 1:
                inner.listed = []
                top.only = inner.listed
            stack.append(inner)
        elif top.listed is not None:
            raise NotLiteral
    raise NotLiteral


def finished(code: str, frame: Frame, end: int) -> None:
    """Reports the member or entry of a frame that ends here."""
    if frame.listed is not None and frame.start >= 0:
        kind, value = frame.only.get("url", (None, None))
        if kind != "text":
            raise NotLiteral
        frame.listed.append(value)
    elif frame.members is not None and frame.key is not None:
        if isinstance(frame.only, str):
            frame.members[frame.key] = ("text", unquoted(frame.only))
        elif isinstance(frame.only, list) and frame.tokens == 1:
            frame.members[frame.key] = ("texts", frame.only)
        else:
            frame.members[frame.key] = ("raw", code[frame.start : end].strip() if frame.start >= 0 else "")


def is_json_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def configured(code: str | None) -> list[dict]:
    """Rows (viewer, call, member, kind, value) of a script's calls, in order.

    kind: text, json (a member given a JSON object) or raw; a call without a readable
    object has one row of kind unreadable, one beyond MOST_CALLS of kind unread, and one
    that is read gets a row of kind call first.
    """
    code = (code or "")[:MOST_SCRIPT_CHARS]
    rows = []

    def row(viewer: str, call: int, member: str | None, kind: str, value: str | None = None) -> None:
        rows.append({"viewer": viewer, "call": call, "member": member, "kind": kind, "value": value})

    for call, m in enumerate(re.finditer(SWAGGER_CALL, code)):
        if call >= MOST_CALLS:
            row("swagger", call, None, "unread")
            break
        try:
            found = object_at(code, m.end())
        except NotLiteral:
            row("swagger", call, None, "unreadable")
            continue
        row("swagger", call, None, "call")
        for member, (kind, value) in found.items():
            for one in value if kind == "texts" else [value]:
                row("swagger", call, member, "text" if kind == "texts" else "json" if kind == "raw" and is_json_object(value) else kind, one)
    for call, m in enumerate(re.finditer(REDOC_CALL, code)):
        if call >= MOST_CALLS:
            break
        first = next((t for t in _TOKEN.finditer(code, m.end(), min(len(code), m.end() + MOST_CHARS)) if t.lastgroup != "gap"), None)
        literal = first is not None and first.lastgroup == "text"
        row("redoc", call, "url", "text" if literal else "raw", unquoted(first.group()) if literal else None)
    return rows


MEMBERS = "array<struct<viewer:string,call:int,member:string,kind:string,value:string>>"
_ARROW = pa.list_(pa.struct([("viewer", pa.string()), ("call", pa.int32()), ("member", pa.string()), ("kind", pa.string()), ("value", pa.string())]))


def configured_members(code: Column) -> Column:
    """Array of the members that calls of viewers in a script are given."""

    @F.arrow_udf(MEMBERS)
    def scan(scripts: pa.Array) -> pa.Array:
        return pa.array([configured(s.as_py()) for s in scripts], _ARROW)

    return scan(code)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
