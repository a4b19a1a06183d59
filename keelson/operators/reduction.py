"""Reduced pages: the few lines of a page that a model is shown, with numbers for what it may choose.

Events of a page become candidate lines in page order; equal lines count once; of too many
links those that name a specification stay first, then those of the highest score; lines
with an address are numbered; and the page ends with the first line that would go beyond
its budget.  Windows here run over one page, whose candidates are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.links import absolute, bound, score
from keelson.sources.page_events import page_events

#: The words of specifications in addresses and labels, and in scripts; relations of assets and of specifications.
KEYWORDS = r"openapi|swagger|redoc|rapidoc|api[-_ ]?docs?\b|\bspec(?:s|ification)?\b|spec-?url"
SCRIPT_KEYWORDS = r"openapi|swagger|redoc|rapidoc|spec-?url|api-?description"
SPEC_EXTENSION = r"\.(?:json|ya?ml)$"
ASSET_RELATIONS = (
    "stylesheet", "icon", "shortcut", "apple-touch-icon", "mask-icon", "preload", "prefetch", "preconnect", "dns-prefetch", "manifest", "modulepreload",
)
SPEC_RELATIONS = ("service-desc", "describedby")
#: Least score of a link, and how much of a page is shown.
LEAST_SCORE, MOST_SNIPPETS, SNIPPET_WINDOW = 1, 4, 200
MOST_CHARS, MOST_ITEMS, MOST_SNIPPET_CHARS, MOST_LABEL_CHARS, MOST_LINKS, MOST_HEADINGS = 12_000, 100, 500, 120, 30, 6


def shown(text: Column, most: int) -> Column:
    """One line: control characters and white space single spaces, quotes single, clipped with an ellipsis."""
    plain = F.replace(F.trim(F.regexp_replace(text, r"[\s\x00-\x1F\x7F]+", " ")), F.lit('"'), F.lit("'"))
    return bound(plain, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))))


def resolved(base: Column, href: Column) -> Column:
    """The HTTP address that an href leads to, without its fragment; null for others and for places on the same page."""
    trimmed = F.regexp_replace(href, r"^\s+|\s+$", "")
    url = F.regexp_replace(absolute(base, trimmed), "#.*$", "")
    return F.when((trimmed != "") & ~F.startswith(trimmed, F.lit("#")) & url.rlike("^(?i)https?://[^/?#]"), url)


def mentions(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def relevant(url: Column, label: Column) -> Column:
    """Whether a link names a specification: by a word in its address or label, or as a labelled file of its kind."""
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return mentions(url, KEYWORDS) | mentions(label, KEYWORDS) | mentions(path, SPEC_EXTENSION) & (label != "")


def snippets(script: Column) -> Column:
    """Stretches of a script around its keywords; those that overlap are one."""
    # A stretch is a keyword with what stands around it, and goes on while another begins within reach of the last.
    reach, word = f".{{0,{SNIPPET_WINDOW}}}", f"(?:{SCRIPT_KEYWORDS})"
    found = F.regexp_extract_all(script, F.lit(rf"(?is){reach}?{word}(?:.{{0,{2 * SNIPPET_WINDOW}}}?{word})*+{reach}"), F.lit(0))
    return F.transform(found, lambda s: shown(s, MOST_SNIPPET_CHARS))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind, line, url, label, specification and score of what pages (page_id, url, html) offer, in order."""
    read = pages.select("page_id", F.col("url").alias("page_url"), page_events(F.col("html")).alias("events"))
    href = F.get(F.transform(F.filter("events", lambda e: e["kind"] == "base"), lambda e: e["href"]), F.lit(0))
    page_url = F.coalesce("page_url", F.lit(""))
    rows = read.select("page_id", F.coalesce(absolute(page_url, href), page_url).alias("base"), F.posexplode("events").alias("pos", "e")).where("e.kind <> 'base'")
    kind, of_kind = F.col("kind"), lambda name: F.col("kind") == name
    rows = rows.select("page_id", "pos", "e.*", resolved(F.col("base"), F.col("e.href")).alias("to"))
    rows = rows.withColumn("label", shown(F.coalesce("text", F.lit("")), MOST_LABEL_CHARS))
    part = F.explode_outer(F.when(of_kind("script"), F.transform(snippets(F.col("text")), lambda s, i: F.struct(i.alias("at"), s.alias("said"))))).alias("part")
    rows = rows.select("*", part).where("kind <> 'script' OR part IS NOT NULL")
    relations = F.split(F.lower("rel"), r"\s+")
    spec = F.arrays_overlap(relations, F.array(*map(F.lit, SPEC_RELATIONS)))
    asset = F.arrays_overlap(relations, F.array(*map(F.lit, ASSET_RELATIONS))) & ~spec
    typed = F.array_contains(relations, "alternate") & F.lower("type").rlike("json|yaml")
    tag = ~asset & (spec | mentions(F.col("to"), KEYWORDS) | typed)
    meta = shown(F.col("text"), MOST_SNIPPET_CHARS)
    quoted = lambda head, text, tail="": F.concat(F.lit(f'{head} "'), text, F.lit(f'"{tail}'))
    line = (
        F.when(of_kind("title") & (F.col("label") != ""), quoted("TITLE", F.col("label"))).when(of_kind("heading") & (F.col("label") != ""), quoted("HEADING", F.col("label")))
        .when(of_kind("link") & F.col("to").isNotNull(), F.concat(F.lit("LINK "), F.col("to"), F.lit(' "'), F.col("label"), F.lit('"')))
        .when(of_kind("script"), F.concat(F.lit("SCRIPT "), "part.said"))
        .when(of_kind("tag_link") & F.col("to").isNotNull() & tag, F.concat(F.lit('TAG link rel="'), shown(F.col("rel"), MOST_LABEL_CHARS), F.lit('" '), "to"))
        .when(of_kind("tag_meta") & mentions(meta, KEYWORDS), F.concat(F.lit("TAG meta "), meta))
        .when(of_kind("attribute") & F.col("to").isNotNull(), F.concat(F.lit("ATTRIBUTE <"), "name", F.lit("> "), "to"))
    )
    is_link = of_kind("link")
    found = rows.select(
        "page_id", F.struct("pos", F.coalesce("part.at", F.lit(0)).alias("at")).alias("pos"), F.regexp_replace(kind, "^tag_.*", "tag").alias("kind"), line.alias("line"),
        F.when(~kind.isin("title", "heading", "script", "tag_meta"), F.col("to")).alias("url"), "label",
        F.when(is_link, relevant(F.col("to"), F.col("label"))).alias("specification"), F.when(is_link, score(F.col("to"), F.col("label"))).alias("score"),
    ).where("line IS NOT NULL")
    return found.where((F.col("kind") != "link") | F.col("specification") | (F.col("score") >= LEAST_SCORE))


def reduced(pages: DataFrame, most_chars: int = MOST_CHARS, most_items: int = MOST_ITEMS, most_links: int = MOST_LINKS) -> DataFrame:
    """page_id, ordinal, kind, line, url and shown_id of the lines shown of each page, and whether the page was cut (truncated)."""
    own = Window.partitionBy("page_id", "kind")
    rows = candidates(pages).withColumns({
        "of_kind": F.row_number().over(own.orderBy("pos")), "best": F.row_number().over(own.orderBy(F.col("specification").desc(), F.col("score").desc(), "pos")),
        "links": F.count_if(F.col("kind") == "link").over(Window.partitionBy("page_id")),
    })
    rows = rows.where((F.col("kind") != "heading") | (F.col("of_kind") <= MOST_HEADINGS)).where((F.col("kind") != "script") | (F.col("of_kind") <= MOST_SNIPPETS))
    rows = rows.where((F.col("kind") != "link") | (F.col("best") <= most_links))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("page_id", "line").orderBy("pos"))).where("again = 1")
    page = Window.partitionBy("page_id").orderBy("pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"ordinal": F.row_number().over(page), "number": F.count("url").over(so_far)})
    rows = rows.withColumn("shown_id", F.when(F.col("url").isNotNull(), F.concat(F.lit("L"), "number")))
    rows = rows.withColumn("line", F.concat_ws(" ", "shown_id", "line"))
    rows = rows.withColumn("fits", (F.col("ordinal") <= most_items) & (F.sum(F.length("line") + 1).over(so_far) <= most_chars))
    cut = F.max(~F.col("fits")).over(Window.partitionBy("page_id")) | (F.col("links") > most_links)
    return rows.withColumn("truncated", cut).where("fits").select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "kind", "line", "url", "shown_id", "truncated")
