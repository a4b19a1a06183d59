"""JSON and YAML documents as rows: one row for each value, with the place where it stands.

A document is parsed and flattened by a small Arrow function that hands rows on in
pieces (of a large document several, of small ones many together), so memory follows
one document, not a batch of results.  Everything that
follows references, pairs, counts or compares works on these rows.

A row: ``at`` (document URL, ``#`` and JSON pointer), ``owner`` (the object it
belongs to), ``via`` (the container between them, see FOLDED, else empty), ``key``,
``n`` (its number in the document), ``kind`` (a JSON type), ``names`` (its keys are
names, not keywords), ``ref`` (a reference that stands there) and ``text`` (canonical
JSON of a scalar or of data; null for a container).  A document that can't be read is
one row of kind ``rejected`` whose key is the code.

YAML needs PyYAML; where it is missing, YAML documents are rejected as
``not_json_or_yaml``.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from keelson.operators.staging import spread

try:
    import yaml
except ImportError:  # an optional reader
    yaml = None

#: Bounds of a document, beyond which it is rejected.
MOST_BYTES, MOST_VALUES, DEEPEST = 32 << 20, 2_000_000, 64
#: Keywords whose values are data; those whose keys are names; containers folded into their owner.
DATA = frozenset("const default enum example examples externalDocs required security servers tags type".split())
NAMED = frozenset(
    "$defs callbacks content definitions dependentSchemas encoding headers links parameters pathItems paths "
    "patternProperties properties requestBodies responses schemas securitySchemes variables webhooks".split()
)
FOLDED = frozenset("content parameters paths properties responses".split())
#: Lists that are sets: their order says nothing.
SETS = frozenset(("enum", "required"))
#: YAML 1.2 core scalars, as (tag, pattern, first characters).
CORE_SCALARS = (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?(?:0|[1-9][0-9]*)|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+\.[0-9]*|[0-9]+(?=[eE]))(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+.0123456789")),
)
#: Rows, and bytes of their documents, beyond which rows are handed on.
PIECE, PIECE_BYTES = 20_000, 4 << 20
COLUMNS = (
    ("at", pa.string(), "string"), ("owner", pa.string(), "string"), ("via", pa.string(), "string"), ("key", pa.string(), "string"),
    ("n", pa.int64(), "long"), ("kind", pa.string(), "string"), ("names", pa.bool_(), "boolean"), ("ref", pa.string(), "string"),
    ("text", pa.string(), "string"),
)


class Rejected(Exception):
    """A document can't be read; the message is its code."""


#: Made once, as ``json.dumps`` makes one for each value that it is told how to write.
_CANONICAL = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical(value: object) -> str:
    return _CANONICAL.encode(value)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Rejected("duplicate_key")
    return found


def _no_constant(_: str) -> None:
    raise Rejected("not_json_or_yaml")


def _scalar(node: object) -> object:
    """The value of a YAML scalar by the core schema; quoted ones are text."""
    text = node.value
    kind = node.tag.rpartition(":")[2]
    if kind == "null":
        return None
    if kind == "bool":
        return text.lower() == "true"
    if kind == "int":
        return int(text, 0) if text[:2] in ("0o", "0x") else int(text)
    if kind == "float":
        if "n" in text.lower().lstrip("+-."):
            raise Rejected("not_json_or_yaml")  # infinities and NaN are no JSON
        return float(text)
    return text


def _yaml_value(node: object, above: tuple[int, ...], left: list[int]) -> object:
    """A composed YAML node as JSON-like value; aliases are visited each time they are reached."""
    left[0] -= 1
    if left[0] < 0:
        raise Rejected("node_limit_exceeded")
    if isinstance(node, yaml.ScalarNode):
        return _scalar(node)
    if id(node) in above:
        raise Rejected("circular_reference")
    if len(above) >= DEEPEST:
        raise Rejected("nesting_limit_exceeded")
    above = (*above, id(node))
    if isinstance(node, yaml.SequenceNode):
        return [_yaml_value(child, above, left) for child in node.value]
    own, merged = [], {}
    for key, child in node.value:
        if not isinstance(key, yaml.ScalarNode):
            raise Rejected("invalid_structure")
        value = _yaml_value(child, above, left)
        if key.value == "<<" and key.style is None:
            for other in value if isinstance(value, list) else [value]:
                merged = {**other, **merged} if isinstance(other, dict) else merged
        else:
            name = _scalar(key)
            own.append((name if isinstance(name, str) else canonical(name), value))
    return merged | _unique(own)


def _composed(text: str) -> object:
    if yaml is None:
        raise Rejected("not_json_or_yaml")
    loader = type("Core", (yaml.SafeLoader,), {"yaml_implicit_resolvers": {}})
    for tag, pattern, first in CORE_SCALARS:
        loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"(?:{pattern})\\Z"), first)
    depth = 0
    for event in yaml.parse(text, Loader=loader):  # bounded before anything recursive runs
        depth += isinstance(event, (yaml.SequenceStartEvent, yaml.MappingStartEvent))
        depth -= isinstance(event, (yaml.SequenceEndEvent, yaml.MappingEndEvent))
        if depth > DEEPEST:
            raise Rejected("nesting_limit_exceeded")
    return yaml.compose(text, Loader=loader)


def parsed(content: str | bytes | None) -> object:
    """The value of a JSON or YAML document, or Rejected."""
    raw = content.encode() if isinstance(content, str) else content or b""
    if len(raw) > MOST_BYTES:
        raise Rejected("size_limit_exceeded")
    try:
        text = raw.decode("utf-8-sig").strip(" \t\r\n")
    except UnicodeDecodeError:
        raise Rejected("unsupported_encoding") from None
    if not text:
        raise Rejected("empty_document")
    if text[0] == "<" or "\0" in text:
        html = re.match(r"(?is)<.{0,1000}?(?:!doctype html|html[\s>])|<!doctype html|<html", text)
        raise Rejected("html_document" if html else "not_json_or_yaml")
    try:
        if text[0] in "{[":
            return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
        node = _composed(text)
        return _yaml_value(node, (), [MOST_VALUES]) if node is not None else None
    except RecursionError:
        raise Rejected("nesting_limit_exceeded") from None
    except ValueError:
        raise Rejected("not_json_or_yaml") from None
    except Exception as error:
        if yaml is not None and isinstance(error, yaml.YAMLError):
            raise Rejected("not_json_or_yaml") from None
        raise


def kind_of(value: object) -> str:
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    return {str: "string", list: "array", dict: "object"}.get(type(value), "number")


def nodes_of(document: object, url: str = "") -> Iterator[tuple]:
    """Rows of a document, see COLUMNS; a container comes before what is in it."""
    todo = [(f"{url}#", None, "", "", document, False, 1)]  # at, owner, via, key, value, is the key a name, depth
    n = 0
    while todo:
        at, owner, via, key, value, named, depth = todo.pop()
        if n >= MOST_VALUES:
            raise Rejected("node_limit_exceeded")
        if depth > DEEPEST + 1:
            raise Rejected("nesting_limit_exceeded")
        kind = kind_of(value)
        if kind not in ("object", "array") or key in DATA and not named:
            if key in SETS and kind == "array":
                value = [json.loads(x) for x in sorted({canonical(v) for v in value})]
            yield at, owner, via, key, n, kind, False, None, canonical(value)
        else:
            names = kind == "object" and key in NAMED and not named
            ref = value.get("$ref") if kind == "object" and not names else None
            yield at, owner, via, key, n, kind, names, None if ref is None else ref if isinstance(ref, str) else canonical(ref), None
            folded = key in FOLDED and not named
            children = list(value.items() if kind == "object" else enumerate(value))
            for name, child in reversed(children):
                place = f"{at}/{str(name).replace('~', '~0').replace('/', '~1')}"
                todo.append((place, owner if folded else at, key if folded else "", str(name), child, names, depth + 1))
        n += 1


def rows_of(content: str | bytes | None, url: str = "") -> Iterator[list[tuple]]:
    """Rows of one document in pieces; a rejection takes the place of all that isn't handed on yet."""
    try:
        found = nodes_of(parsed(content), url)
        while piece := list(islice(found, PIECE)):
            yield piece
    except Rejected as code:
        yield [(f"{url}#", None, "", str(code), -1, "rejected", False, None, None)]


def read_nodes(documents: DataFrame, content: str = "content", url: str | None = None) -> DataFrame:
    """Every value of every document: the other columns of ``documents`` and COLUMNS."""
    kept = [f for f in documents.schema.fields if f.name != content]
    clash = {f.name.lower() for f in kept} & {c[0] for c in COLUMNS}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = [f.name for f in kept]

    def made(others: list[pa.Array], of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), COLUMNS)]
        return pa.RecordBatch.from_arrays([*(o.take(pa.array(of)) for o in others), *arrays], [*names, *(c[0] for c in COLUMNS)])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(content))
            others = [batch.column(batch.schema.get_field_index(n)) for n in names]
            of, rows, size = [], [], 0
            for i, text in enumerate(texts):
                address, value = others[names.index(url)][i].as_py() if url else "", text.as_py()
                size += len(value or "")
                for piece in rows_of(value, address or ""):
                    of += [i] * len(piece)
                    rows += piece
                    if len(rows) >= PIECE or size >= PIECE_BYTES:
                        yield made(others, of, rows)
                        of, rows, size = [], [], 0
            if rows:
                yield made(others, of, rows)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {t}" for c, _, t in COLUMNS)])
    return spread(documents.select(*names, content)).mapInArrow(flatten, schema)


def nested(leaves: list[tuple[list[str], str]]) -> str:
    """Canonical JSON of (path, text) pairs; the text of a container is ``{}`` or ``[]`` and its path comes first."""
    root: list[object] = [None]
    made: dict[tuple[str, ...], object] = {}
    for path, text in sorted(leaves, key=lambda x: len(x[0])):
        value = json.loads(text)
        made[tuple(path)] = value
        above = made.get(tuple(path[:-1])) if path else None
        if not path:
            root[0] = value
        elif isinstance(above, list):
            above.append((int(path[-1]), value))
        elif isinstance(above, dict):
            above[path[-1]] = value
    for value in made.values():
        if isinstance(value, list) and value and isinstance(value[0], tuple):
            value[:] = [v for _, v in sorted(value, key=lambda x: x[0])]
    return canonical(root[0])


@F.arrow_udf(StringType())
def nested_json(rows: pa.Array) -> pa.Array:
    return pa.array([nested([(x["sub"], x["text"]) for x in r.as_py()]) for r in rows], pa.string())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
