"""Pages as events in their order: titles, headings, links, tags, attributes and scripts.

One pass of tokens; what is open (an anchor, a heading) collects the text until it ends.
Used where the order of items of different kinds matters; what only needs the links or
the scripts of a page has patterns of its own in ``operators.links`` and ``pages``.
"""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes that name a contract.
SPEC_ATTRIBUTES = ("spec-url", "data-url", "api-description-url", "apidescriptionurl")
_TOKEN = re.compile(
    r"""(?is)(?P<comment><!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z))
    |<(?P<raw>script|style|title)(?=[\s/>])(?P<raw_in>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>(?P<content>.*?)(?:</(?P=raw)\b[^>]*+>|\Z)
    |<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<inside>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |(?P<text>[^<]++|<)""",
    re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']\S*+)))?""")
HEADINGS = ("h1", "h2", "h3")


def attributes_of(inside: str) -> dict[str, str]:
    """Names in lower case; of equal ones the last counts, as in a map."""
    return {name.lower(): unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(inside)}


def events_of(html: str | None) -> list[dict]:
    """Rows kind, text, href, rel, type and name in page order.

    base, title, heading and script have a text; link has href and text (its title or
    label, then what it holds); tag_link has href, rel and type; tag_meta a text;
    attribute has href, and the element and attribute as name.
    """
    found: list[dict] = []
    anchor: dict | None = None
    heading: list[str] | None = None
    base = False

    def event(kind: str, **more: str) -> None:
        found.append({"kind": kind, "text": None, "href": None, "rel": None, "type": None, "name": None} | more)

    def end_anchor() -> None:
        nonlocal anchor
        if anchor is not None:
            event("link", href=anchor["href"], text=" ".join(anchor["parts"]))
            anchor = None

    for m in _TOKEN.finditer(html or ""):
        if m["comment"] is not None:
            continue
        if m["text"] is not None:
            text = unescape(m["text"])
            if heading is not None:
                heading.append(text)
            if anchor is not None:
                anchor["parts"].append(text)
            continue
        tag = (m["raw"] or m["tag"]).lower()
        if m["close"]:
            if tag == "a":
                end_anchor()
            elif tag in HEADINGS and heading is not None:
                event("heading", text="".join(heading))
                heading = None
            continue
        held = attributes_of(m["raw_in"] if m["raw"] else m["inside"])
        if tag == "base" and not base and held.get("href"):
            base = True
            event("base", href=held["href"])
        elif tag == "a":
            end_anchor()
            if held.get("href"):
                anchor = {"href": held["href"], "parts": [held.get("title") or held.get("aria-label") or ""]}
        elif tag in HEADINGS:
            heading = []
        elif tag == "link" and held.get("href"):
            event("tag_link", href=held["href"], rel=held.get("rel", ""), type=held.get("type", ""))
        elif tag == "meta":
            event("tag_meta", text=f"{held.get('name') or held.get('property') or ''} {held.get('content', '')}")
        for name in SPEC_ATTRIBUTES:
            if held.get(name):
                event("attribute", href=held[name], name=f"{tag} {name}")
        if tag == "title":
            event("title", text=unescape(m["content"]))
        elif tag == "script" and not held.get("src"):
            event("script", text=m["content"])
    end_anchor()
    return found


EVENTS = "array<struct<kind:string,text:string,href:string,rel:string,type:string,name:string>>"
_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "text", "href", "rel", "type", "name")]))


def page_events(html: Column) -> Column:
    """Array of the events of a page."""

    @F.arrow_udf(EVENTS)
    def scan(pages: pa.Array) -> pa.Array:
        return pa.array([events_of(p.as_py()) for p in pages], _ARROW)

    return scan(html)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
