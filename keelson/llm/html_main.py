"""Operator 4: main text of HTML pages by tree scoring.

A page becomes a tree of its block elements.  Each block of text passes points for
its length and its commas to the elements above it (whole to the nearest container,
a half and a third further up); an element's points are discounted by the share of
link text below it.  The best container is kept with all that stands beside it or
further up and doesn't consist of links (or scores well next to it), or the whole
article where the best container lies in one, with articles beside it that do about as
well or hold no links.  Where there is a main element with text, the best container is
one of it.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out by element, by role, or by a class or id name that as a
whole says so; a single word of a longer name only lowers the score.

A name is no proof, so it is held against the text: an element stays in spite of its
name if it holds nearly all of the text outside links that no other name leaves out, or
half of it and an article, a main element or a first heading, and if nothing else claims
to be the article; of several such names the one that holds most is doubted first.
Headings, rows, cells and paragraphs are left out only for names that leave no doubt.

Cases: a null or empty html has the text ''; markup that is cut off or badly nested
is closed where HTML closes it (a script, style, title, textarea or iframe without
an end tag reaches to the end of the page, a button, select, drawing or template to
the end of its parent, a button that is never closed to the next block); formulas and fallback texts are text; character references are decoded once; white space
(any Unicode white space, and <br>) within a block becomes one space; nothing else
is dropped or cut; of equal scores the first container in page order wins; equal
pages get equal texts; extra columns pass through and clashing output names are
refused; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from keelson.llm.common import by_value, small_batches

#: Elements without content, which never open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is neither markup nor text of the page, up to their end tag.
RAW = frozenset("script style textarea title iframe".split())
#: Elements whose content is markup but no text of the page; they end with their parent at the latest.
HIDDEN = frozenset("template svg select button annotation annotation-xml".split())
#: Those of them that any block inside ends, as it can't be part of them.
FOREIGN = frozenset("svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements left out wherever they stand; a header is left out only outside articles.
LEFT_OUT = frozenset("nav footer aside form head dialog menu".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu".split())
#: Words that, as the last of a class or id name, say that it is left out ("post-comments", "sidebar").
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus "
    "replies cookie cookies consent gdpr newsletter subscribe popup modal overlay breadcrumb breadcrumbs pagination pager "
    "nav navbar navigation menu footer masthead toolbar paywall sidebar".split()
)
#: Words that say so only if every word of the name is one of these or of those above ("social-share", "cookie-notice-bar").
DOUBTFUL = frozenset(
    "respond subscription share sharing social related recommended recommendations widget widgets login signup skip banner "
    "header notice notices alert disclaimer rail teaser teasers aside".split()
)
#: Words that only say how or where a box stands.
PLAIN = frozenset(
    "area bar block blocks box button buttons container content global grid group inner item items left link links list main "
    "mobile outer page panel posts right row section site slot top bottom unit wrap wrapper".split()
)
GOOD = frozenset("article body content main post entry story text".split())
#: Words of names that tell a state or a topic, not what the element is ("has-sidebar", "tag-ads").
STATE = frozenset("no not has with without is hide show open tag category type format lang theme".split())
READER = frozenset("comment comments reply replies".split())
#: Elements of running text, which doubtful names don't leave out.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p tr td th tbody thead caption blockquote pre dt dd".split())
#: What marks an article from within, and how much of the page's text outside links an element must hold to stay in spite of its name.
MARKS = frozenset("article main h1".split())
MARKED_SHARE, UNMARKED_SHARE = 0.5, 0.9
#: Names within names that are doubted, at most.
NAMES_DEEP = 32
#: Start tags that close an open element of their own kind, up to the nearest of the barriers.
CLOSES = {
    "p": ({"p"}, frozenset()), "li": ({"li"}, frozenset({"ul", "ol", "menu"})), "dt": ({"dt", "dd"}, frozenset({"dl"})),
    "dd": ({"dt", "dd"}, frozenset({"dl"})), "tr": ({"tr"}, frozenset({"table"})), "td": ({"td", "th"}, frozenset({"table", "tr"})),
    "th": ({"td", "th"}, frozenset({"table", "tr"})),
}
NO_P_INSIDE = frozenset(BLOCK - {"dd", "dt", "li", "td", "th", "html", "body", "head", "tbody", "thead", "tfoot", "tr"})

#: Points that an article or main has by itself.
OF_ARTICLE = 30.0
#: The greatest share of link text in what is kept beside the best container.
LIGHT = 0.25
#: Elements nested deeper become siblings, as in browsers; no text is lost by it.
DEEPEST = 512

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|(\S++)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def standing(names: str, running: bool = False) -> tuple[bool, float]:
    """Whether class and id names leave an element (of running text or not) out, and the points that they give or take.

    A name is judged whole: one of its words alone (as in "market-share" or
    "related-work") only takes points.
    """
    out, points = False, 0.0
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or STATE.intersection(words):
            continue
        core = [w for w in words if w not in PLAIN]
        last = core[-1] if core else ""
        noisy = last in NOISE or not running and bool(core) and all(w in NOISE or w in DOUBTFUL for w in core)
        out |= noisy
        if not noisy:
            points += 15.0 * bool(GOOD.intersection(words)) - 10.0 * any(w in NOISE or w in DOUBTFUL for w in words)
    return out, max(-20.0, min(points, 15.0))


class Node:
    __slots__ = ("tag", "parent", "out", "named", "reader", "marked", "score", "chars", "linked", "depth", "kept")

    def __init__(self, tag: str, parent: Node | None, out: bool, named: bool, reader: bool, score: float) -> None:
        self.tag, self.parent, self.out, self.named, self.reader, self.score = tag, parent, out, named, reader, score
        self.marked = False
        self.chars = self.linked = 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.kept = False


def opened(tag: str, attributes: str, parent: Node) -> Node:
    """A node with its standing (left out or not) and the bonus of its names."""
    points, named, reader = 0.0, False, False
    out = parent.out or tag in LEFT_OUT
    if tag == "header" and not out:
        above = parent
        while above is not None and above.tag not in ("article", "main"):
            above = above.parent
        out = above is None
    if attributes:
        seen: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            seen.setdefault(name.lower(), a or b or c)  # of equal names the first counts
        out = out or "hidden" in seen or seen.get("aria-hidden", "").lower() == "true" or seen.get("role", "").lower() in LEFT_OUT_ROLES
        out = out or "display:none" in seen.get("style", "").lower().replace(" ", "")
        names = f"{seen.get('class', '')} {seen.get('id', '')}"
        named, points = standing(names, tag in RUNNING)
        reader = bool(READER.intersection(w.lower() for w in _WORD.findall(names)))
        if tag == "article":  # its names often tell topics, so only those of reader comments count
            named = bool(READER.intersection(seen.get("class", "").lower().split()))
        named = named and tag not in ("html", "body", "main")
    return Node(tag, parent, out, named, reader, OF_ARTICLE * (tag in ("article", "main")) + points)


def judged_names(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that no name leaves out, after holding names against the text; nodes below a name that holds are out."""
    for node, block, linked in found:
        node.chars += len(block)
        node.linked += linked
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.marked |= node.marked or node.tag in MARKS and node.chars > node.linked
    own = [0] * len(nodes)  # text outside links that stands in the node itself
    places = {id(n): i for i, n in enumerate(nodes)}
    above = [0] + [places[id(n.parent)] for n in nodes[1:]]
    for node, block, linked in found:
        own[places[id(node)]] += len(block) - linked
    for _ in range(NAMES_DEEP):
        # Outermost names, and what stands below none of them.
        free, tops = [True] * len(nodes), []
        for i, node in enumerate(nodes):
            free[i] = free[above[i]] and not node.named
            if node.named and free[above[i]]:
                tops.append(node)
        if not tops:
            break
        # An element that no name touches and that claims to be the article settles it; else the largest name is doubted.
        claimed = any(free[i] and n.tag in ("article", "main") and n.chars > n.linked for i, n in enumerate(nodes))
        most = max(tops, key=lambda n: (not n.reader, n.chars - n.linked))
        holds, rest = most.chars - most.linked, sum(n for i, n in enumerate(own) if free[i])
        if claimed or not holds or holds < (MARKED_SHARE if most.marked and not most.reader else UNMARKED_SHARE) * (holds + rest):
            break
        most.named = False
    for node in nodes[1:]:
        node.out |= node.named or node.parent.out
    for node in nodes:
        node.chars = node.linked = 0
    kept = [x for x in found if not x[0].out]
    for node, block, linked in kept:
        node.chars += len(block)
        node.linked += linked
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    return kept


def blocks_of(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The nodes of the block tree, parents first, and its blocks of text (with characters in links) in page order, without what is left out."""
    root = here = Node("", None, False, False, False, 0.0)
    nodes = [root]
    found: list[tuple[Node, str, int]] = []
    hidden: list[tuple[str, Node]] = []  # open elements of HIDDEN, each with the block that it stands in
    text: list[str] = []
    linked = 0
    in_link = False
    quotes_hold = True
    last_button_end = max(html.rfind("</button"), html.rfind("</BUTTON"))

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            if block and not here.out:
                found.append((here, block, min(linked, len(block))))
            text.clear()
        linked = 0

    def ended(tags: frozenset[str] | set[str]) -> None:
        """Closes the innermost open hidden element of these tags and what is open in it."""
        for i in range(len(hidden) - 1, -1, -1):
            if hidden[i][0] in tags:
                del hidden[i:]
                return

    at, end = 0, len(html)
    while at < end:
        cut = html.find("<", at)
        if cut < 0:
            cut = end
        if cut > at and not hidden:
            piece = unescape(html[at:cut])
            text.append(piece)
            if in_link:
                linked += len(piece)
        if cut == end:
            break
        if html.startswith(("<!", "<?"), cut):
            at = _COMMENT.match(html, cut).end()
            continue
        m = _TAG.match(html, cut)
        if m is None:  # the sign opens no tag, so it is text
            if not hidden:
                text.append("<")
            at = cut + 1
            continue
        close = _QUOTED.match(html, m.end()) if quotes_hold else None
        if close is None:  # a quote stays open up to the end: from here on, tags end at the next >
            quotes_hold = False
            at = html.find(">", m.end()) + 1
            if not at:
                break  # a tag that is cut off is dropped
        else:
            at = close.end()
        tag, closing, attributes = m[2].lower(), bool(m[1]), html[m.end() : at - 1]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag in HIDDEN or hidden and tag == "foreignobject":
            if closing or tag == "button":  # no button stands in another
                ended({tag})
            if not closing and not attributes.endswith("/") and len(hidden) < DEEPEST:
                hidden.append((tag, here))
            continue
        if hidden and closing and tag in ("math", "semantics"):
            ended({"annotation", "annotation-xml"})
        if tag == "br":
            if not hidden:
                text.append(" ")
        elif tag == "a":
            in_link = not closing
        if tag not in BLOCK:
            continue
        if closing:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is root and hidden:
                continue
            flush()
            in_link = False
            if node is not root:
                here = node.parent
                while hidden and hidden[-1][1].depth > here.depth:
                    hidden.pop()
            continue
        while hidden and (hidden[-1][0] in FOREIGN or hidden[-1][0] == "button" and cut > last_button_end):
            hidden.pop()
        flush()
        node = here
        floor = hidden[-1][1].depth if hidden else -1  # what is open outside a hidden element isn't closed by a start tag in it
        if here.tag == "head" and here.depth > floor:
            here = here.parent
        elif tag in NO_P_INSIDE and here.tag == "p" and here.depth > floor:
            here = here.parent
        elif tag in CLOSES:
            kinds, barriers = CLOSES[tag]
            while node.depth > floor and node is not root and node.tag not in kinds and node.tag not in barriers:
                node = node.parent
            if node.depth > floor and node.tag in kinds:
                here = node.parent
        if tag not in VOID:
            here = opened(tag, attributes, here if here.depth < DEEPEST else here.parent)
            here.out = here.out or bool(hidden)
            nodes.append(here)
    flush()
    return nodes, judged_names(nodes, found)


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks, one a line."""
    nodes, found = blocks_of(html or "")
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for node, block, _ in found:
        points = (len(block) >= 25) + block.count(",") + min(len(block) / 100, 3.0) + 0.1
        up = node.parent if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") and node.parent is not None else node
        for share in (1.0, 0.5, 1 / 3):
            if up is None:
                break
            scored[id(up)] = up
            up.score += points * share
            up = up.parent
    worth = {k: n.score * (1 - n.linked / max(n.chars, 1)) for k, n in scored.items()}
    mains = {id(n) for n in nodes if n.tag == "main" and not n.out and n.chars > n.linked}

    def in_main(node: Node | None) -> bool:
        while node is not None and id(node) not in mains:
            node = node.parent
        return node is not None

    able = [k for k, n in scored.items() if in_main(n)] if mains else list(scored)
    best = max(able, key=worth.__getitem__)  # in page order, so the first of equals wins
    top = above = scored[best]
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    if above is not None:
        above.kept = True
        for node in nodes[1:]:
            # Another article beside it is kept if it holds no links, or does about as well and isn't a list of links.
            beside = node.parent is above.parent and node.tag == above.tag and node.linked <= LIGHT * node.chars
            node.kept |= node.parent.kept or beside and (not node.linked or node.score - OF_ARTICLE >= 0.5 * (above.score - OF_ARTICLE))
        return "\n".join(block for node, block, _ in found if node.kept)
    top.kept = True
    up, around = top.parent, set()
    while up is not None:
        around.add(id(up))
        up = up.parent
    # Whole elements are kept that consist of little link text; in others each part is judged by itself.
    for node in nodes[1:]:
        good = node.parent is top.parent and worth.get(id(node), 0.0) >= max(10.0, 0.2 * worth[best])
        node.kept |= node.parent.kept or good or id(node) not in around and node.linked <= LIGHT * node.chars


    def stands(node: Node, block: str, linked: int) -> bool:
        """Beside the best container: little link text, or a paragraph of it among as much other text."""
        around = node.parent
        among = node.tag in RUNNING and around is not None and around.parent is not None and around.chars - around.linked >= len(block)
        return linked <= LIGHT * len(block) or among

    return "\n".join(x[1] for x in found if x[0].kept or stands(*x))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every page added as ``out``."""
    if out.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"column {out} is there already")

    @F.arrow_udf(StringType())
    def texts(rows: pa.Array) -> pa.Array:
        return pa.array([main_text(r.as_py()) for r in rows], pa.string())

    return small_batches(pages).withColumn(out, texts(F.col(f"`{html}`")))


by_value(__name__)
