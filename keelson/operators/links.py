"""Links of pages: extraction by pattern, scoring by keywords, and choosing the best of each page.

Everything is native: a page's links are an array from one regular expression, and
scoring is a sum of CASE expressions in whole-stage code.

An anchor may have its attributes in any order, case and quoting; it ends at its end
tag, the next anchor or the end of the page.  Its label is its title (or aria-label)
and its text without markup, white space made single.  Scored are the path of the URL
that the href leads to from the page (or its <base>) and the label.  Anchors in
comments, scripts, styles, titles and textareas are none; one without href is no
link; character references stay as they are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keyword patterns and their weights, the cap, and what scores nothing.
KEYWORDS = (
    (r"openapi|swagger|redoc|rapidoc", 10),
    (r"\bspec(?:s|ification)?\b|api[-_ ]?spec", 8),
    (r"api[-_ ]?(?:reference|docs?|documentation)|reference", 6),
    (r"\bapis?\b", 5),
    (r"developers?|dev[-_ ]portal", 5),
    (r"docs?\b|documentation", 4),
    (r"download|definition|schema", 2),
    (r"guide|integrat|getting[- ]started|resources?|sdks?|portal|machine[- ]readable", 1),
)
HIGHEST = 12
ASSET = r"\.(?:css|js|mjs|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|map|zip|gz|tgz|mp4|pdf)$"
NEGATIVE = (
    r"pricing|login|log-?in|sign-?(?:in|up)|careers?|jobs|blog|press|privacy|terms|cookie|status\.|support/|contact"
)
#: Sites that never document the API that is looked for.
OFF_SITE = (
    r"(?:^|\.)(?:linkedin\.com|twitter\.com|x\.com|facebook\.com|fb\.com|instagram\.com|youtube\.com|youtu\.be|tiktok\.com|"
    r"reddit\.com|discord\.com|discord\.gg|t\.me|pinterest\.com|medium\.com|threads\.net|snapchat\.com|apps\.apple\.com|"
    r"play\.google\.com|bsky\.app|mastodon\.social|wa\.me)$"
)
# Repeats of groups are possessive, and no start tag holds another start of its kind, so that no page costs stack or more than linear time.
_INSIDE = r"""((?:[^<>"']++|"[^"]*+"|'[^']*+'|<(?!%s))*+)>"""
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title|textarea)(?=[\s/>]).*?(?:</\1\s*+>|\z)"
ANCHOR = rf"(?is)<a(?=[\s/]){_INSIDE % r'a[\s/]'}(.*?)(?:</a\s*+>|(?=<a[\s/>])|\z)"
BASE = rf"(?is)<base(?=[\s/]){_INSIDE % 'base'}"
TAG = rf"(?is)</?[a-z]{_INSIDE % '/?[a-z]'}"
ATTRIBUTE = r"""([^\s/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|\S++))?"""
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_BEFORE_PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attributes(inside: Column) -> Column:
    """struct(names, values) of a start tag, names in lower case and values as they are written; found once for all that is asked of it."""
    found = lambda group: F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(group))
    return F.struct(F.transform(found(1), lambda n: F.lower(n)).alias("names"), found(2).alias("values"))


def value_of(held: Column, name: str) -> Column:
    """The value of the first attribute of that name among ``attributes``, without quotes, or null if there is none."""
    at = F.array_position(held["names"], name)
    return F.when(at > 0, F.regexp_replace(F.get(held["values"], (at - 1).cast("int")), r"""(?s)^(["'])(.*)\1$""", "$2"))


def attribute(inside: Column, name: str) -> Column:
    """The value of the first attribute of that name in a start tag, or null if there is none."""
    return bound(attributes(inside), lambda held: value_of(held, name))


def absolute(base: Column, href: Column) -> Column:
    """Where an href leads from a URL; dot segments stay until the path is taken."""
    path = F.regexp_extract(base, f"{_BEFORE_PATH}([^?#]*)", 1)
    origin, folder = F.regexp_extract(base, _BEFORE_PATH, 0), F.regexp_extract(base, f"{_BEFORE_PATH}([^?#]*/)", 1)
    return bound(
        F.trim(F.regexp_replace(href, r"[\t\n\r\f]", " ")),
        lambda h: F.when(h.rlike(_SCHEME), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, _SCHEME, 0), h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(h.rlike("^(?:[?#]|$)"), F.concat(origin, path, h))
        .otherwise(F.concat(origin, F.when((folder == "") & (origin != ""), "/").otherwise(folder), h)),
    )


def path_of(url: Column) -> Column:
    """The path of a URL without dot segments."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, s))
    parts = lambda p: F.split(F.regexp_replace(p, r"/\.(?=/|$)", ""), "/")
    plain = lambda p: F.array_join(F.aggregate(parts(p), F.array().cast("array<string>"), step), "/")
    return bound(F.regexp_extract(url, f"{_BEFORE_PATH}([^?#]*)", 1), lambda p: F.when(p.rlike(r"/\.\.?(?:/|$)"), plain(p)).otherwise(p))


def score(url: Column, label: Column) -> Column:
    """How promising a link looks: the weights of the keywords in its URL's path and label, at most HIGHEST."""
    host = lambda u: F.lower(F.regexp_extract(u, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    elsewhere = lambda u: u.rlike(_SCHEME) & ~u.rlike("^(?i:https?):") | host(u).rlike(OFF_SITE)
    points = lambda said: F.least(sum((F.when(said.rlike(p), w).otherwise(0) for p, w in KEYWORDS), F.lit(0)), F.lit(HIGHEST))
    of_path = lambda path: F.when(F.lower(path).rlike(ASSET), 0).otherwise(
        bound(F.lower(F.concat(path, F.lit(" "), label)), lambda said: F.when(said.rlike(NEGATIVE), 0).otherwise(points(said)))
    )
    return bound(url, lambda u: F.when(elsewhere(u), 0).otherwise(bound(path_of(u), of_path)))


def links_of(pages: DataFrame) -> DataFrame:
    """page_id, pos (from 0, in page order), href, label and url (where it leads) of every anchor with an href."""
    markup = pages.select(
        "page_id", F.regexp_replace("html", _NO_MARKUP, "").alias("html"), (F.col("url") if "url" in pages.columns else F.lit("")).alias("page_url")
    )

    def link(anchor: Column) -> Column:
        text = F.regexp_replace(F.regexp_extract(anchor, ANCHOR, 2), TAG, "")
        filled = lambda held, name: F.nullif(value_of(held, name), F.lit(""))
        label = lambda held: F.concat_ws(" ", F.coalesce(filled(held, "title"), filled(held, "aria-label")), text)
        whole = lambda held: F.struct(
            value_of(held, "href").alias("href"), F.trim(F.regexp_replace(label(held), r"\s+", " ")).alias("label")
        )
        return bound(attributes(F.regexp_extract(anchor, ANCHOR, 1)), whole)

    found = F.filter(F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0)), link), lambda x: x["href"].isNotNull())
    page_url = F.coalesce("page_url", F.lit(""))
    base = F.coalesce(absolute(page_url, F.nullif(attribute(F.regexp_extract("html", BASE, 1), "href"), F.lit(""))), page_url)
    return markup.select("page_id", base.alias("base"), F.posexplode(found).alias("pos", "l")).select(
        "page_id", "pos", F.col("l.href").alias("href"), F.col("l.label").alias("label"), absolute(F.col("base"), F.col("l.href")).alias("url")
    )


def best_of_page(scored: DataFrame, most: int = 6, least_score: int = 0) -> DataFrame:
    """The ``most`` best links of each page, by score and then page order."""
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "pos")
    return scored.where(F.col("score") >= least_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def within_budget(ranked: DataFrame, items: int, chars: int) -> DataFrame:
    """Links shown of each page: at most ``items``, and while the sum of (length + 1) stays within ``chars``."""
    order = Window.partitionBy("page_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("href") + F.length("label") + 1).over(order)
    return ranked.withColumn("used", used).where((F.col("rank") <= items) & (F.col("used") <= chars)).withColumn(
        "shown_id", F.concat(F.lit("L"), F.col("rank"))
    )
