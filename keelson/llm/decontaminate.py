"""Operator 7: benchmark decontamination by a positional inverted index, in DataFrame operations only.

1. Cut each item into windows (13 consecutive words; a shorter item is one window);
   equal windows of any items are one phrase.
2. Count, over the whole corpus, the words that benchmark items use.  A phrase is
   led by its two rarest words; one with a word that the corpus lacks can't occur.
   Phrases with the same two words at the same distance share a pair, so neither
   overlapping windows nor items of one template multiply what is searched.
3. Store the postings (text, word, position) of those rare words; the rarest one's
   posting keeps the words around it, 12 on either side, but for phrases of one word.
   Where the rare words are too many to be broadcast, bare postings are joined with
   them, and only the texts of those that lead are read again for what stands around.
4. Offset-adjusted lists of a pair's two words are intersected: their positions less
   their places in the pair must give the same start.
5. What is left is compared word for word.  Each occurrence of a window is found,
   as each contains its two rarest words.

``proximity_matches`` gives the windows whose two words stand only about as far apart.

Postings are keyed by (doc_id, hash of the text) and position, so neither a hot
source nor a group of copies gathers in one task; a frequent word is only posted
where it is one of the two rarest of some phrase, and a join on it is a plain one
whose hot partitions AQE splits, as both sides are settled.

Cases: a null or empty text has no words and is not contaminated; items without
words are ignored; items of equal id count once, items of equal words each; rows
with the same doc_id and different texts are judged apart, fully equal rows get
equal results and stay repeated; extra columns are not read; an empty table of
documents gives an empty result, one of items leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import alnum_words, fresh, settle

WIDTH = 13
#: Tables made from the benchmark are broadcast up to so many bytes; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes counted for a row besides its texts.
BYTES_A_ROW = 64
KEY = ["doc_id", "text_hash"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _fits(df: DataFrame) -> bool:
    """Whether a settled table may be broadcast: its size in bytes is checked."""
    sizes = [F.octet_length(F.array_join(F.col(c), " ")) + 8 * F.size(c) if t.startswith("array") else F.octet_length(F.col(c).cast("string")) for c, t in df.dtypes]
    of_row = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(BYTES_A_ROW))
    return df.agg(F.coalesce(F.sum(of_row), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _fits(df) else df


def _words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.col(f"`{text}`")
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), text_hash(whole).alias("text_hash"), alnum_words(whole).alias("words")
    )


def item_windows(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of all items, settled: phrase (a hash of its words), item_id and phrase_words."""
    size = F.size("item_words")
    found = (
        items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), alnum_words(F.col(f"`{text}`")).alias("item_words"))
        .where("size(item_words) > 0")
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(size - width, F.lit(0)) + 1)))
        .withColumn("phrase_words", F.slice("item_words", F.col("start"), F.least(size, F.lit(width))))
    )
    # 128 bits of a digest: no two phrases of any benchmark share them.
    return settle(found.select(F.left(F.sha2(F.array_join("phrase_words", " "), 256), F.lit(32)).alias("phrase"), "item_id", "phrase_words").distinct())


def corpus_counts(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How often the whole corpus has each word of the windows: term, n."""
    terms = settle(windows.select(F.explode("phrase_words").alias("term")).distinct())
    tokens = _words(docs, doc_id, text).select(F.explode("words").alias("term"))
    return settle(tokens.join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def phrases(windows: DataFrame, counts: DataFrame, absent: bool = False) -> DataFrame:
    """Phrases that may occur, settled: phrase, phrase_words, rarest (its place), pair, first_term, second_term, apart.

    ``pair`` names two terms and how far the second stands after the first (before it
    where negative); a phrase of one word has none.  With ``absent`` words that the
    corpus lacks are passed over, and the rarest of the others lead: for proximity.
    """
    once = windows.select("phrase", "phrase_words").dropDuplicates(["phrase"])
    spread = once.select("phrase", "phrase_words", F.posexplode("phrase_words").alias("at", "term")).join(counts, "term", "left")
    there = F.when(F.col("n").isNotNull(), F.struct("n", "term", "at"))
    ranked = spread.groupBy("phrase").agg(
        F.first("phrase_words").alias("phrase_words"), F.array_sort(F.collect_list(there)).alias("ranked")
    )
    ranked = ranked.where("size(ranked) > 0" if absent else "size(ranked) = size(phrase_words)")
    one, two = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return settle(
        ranked.select(
            "phrase", "phrase_words", one["at"].alias("rarest"), one["term"].alias("first_term"), two["term"].alias("second_term"),
            (two["at"] - one["at"]).alias("apart"),
        ).withColumn("pair", F.concat_ws(" ", "first_term", "second_term", "apart"))
    )


def pair_ends(found: DataFrame) -> DataFrame:
    """The words that lead phrases, settled: term, pair, offset (of the word from the pair's first), leads, single."""
    first = found.select(F.col("first_term").alias("term"), "pair", F.lit(0).alias("offset"), F.lit(True).alias("leads"), F.col("second_term").isNull().alias("single"))
    second = found.where("second_term IS NOT NULL").select(
        F.col("second_term").alias("term"), "pair", F.col("apart").alias("offset"), F.lit(False).alias("leads"), F.lit(False).alias("single")
    )
    return settle(first.unionAll(second).distinct())


def postings(
    docs: DataFrame, ends: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The stored index: KEY, term, position and, for a leading term, the words around (from ``around_from`` on).

    One row with a null term for each text has its number of words as position.
    """
    led = F.max(F.col("leads") & ~F.col("single"))  # of a phrase of one word the word itself is enough
    terms = settle(ends.groupBy("term").agg(F.max("leads").alias("leads"), led.alias("wide")))
    texts = _words(docs, doc_id, text)
    marked = F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("position", "term")
    first = F.when(F.col("wide"), F.greatest(F.col("position") - (width - 1), F.lit(0))).otherwise(F.col("position"))
    span = F.when(F.col("wide"), F.lit(2 * width - 1)).otherwise(1)
    around = F.when(F.col("leads"), F.array_join(F.slice("words", first + 1, span), " ")).alias("around")
    if _fits(terms):
        found = texts.select(*KEY, "words", marked).join(F.broadcast(terms), "term", "left").where("term IS NULL OR leads IS NOT NULL")
        return settle(found.select(*KEY, "term", "position", first.alias("around_from"), around))
    bare = settle(texts.select(*KEY, marked).where("term IS NOT NULL").join(terms, "term"))
    # The leading places of a text meet it once, by its key; repeated rows are one text here and below.
    places = F.collect_set(F.struct("term", "position", "leads", "wide")).alias("places")
    leading = bare.where("leads").groupBy(F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash")).agg(places)
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash"))
    wide = texts.join(settle(leading), same).select(*KEY, "words", F.inline("places")).select(*KEY, "term", "position", first.alias("around_from"), around)
    others = bare.where("NOT leads").select(*KEY, "term", "position", F.lit(None).cast("int").alias("around_from"), F.lit(None).cast("string").alias("around"))
    counts = texts.select(*KEY, F.lit(None).cast("string").alias("term"), F.size("words").alias("position"), F.lit(None).cast("int").alias("around_from"), F.lit(None).cast("string").alias("around"))
    return settle(wide.unionByName(others).unionByName(counts))


def exact_matches(posted: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """Occurrences of phrases: KEY, phrase, first (the position of the first word) and span (its number of words)."""
    lists = posted.where("term IS NOT NULL").join(_small(ends), "term").withColumn("begin", F.col("position") - F.col("offset"))
    meeting = lists.groupBy(*KEY, "pair", "begin").agg(
        F.max(F.when(F.col("leads"), F.struct("around_from", "around"))).alias("lead"),
        F.max(~F.col("leads") | F.col("single")).alias("second"),
    )
    candidates = meeting.where("lead IS NOT NULL AND second").join(_small(found.select("pair", "phrase", "phrase_words", "rarest")), "pair")
    first = F.col("begin") - F.col("rarest")
    skip = first - F.col("lead.around_from")
    there = F.slice(F.split("lead.around", " "), F.greatest(skip, F.lit(0)) + 1, F.size("phrase_words"))
    return candidates.where(skip >= 0).where(there == F.col("phrase_words")).select(
        *KEY, "phrase", first.alias("first"), F.size("phrase_words").alias("span")
    )


def proximity_matches(posted: DataFrame, found: DataFrame, ends: DataFrame, slop: int = 3) -> DataFrame:
    """Phrases whose two leading words stand within ``slop`` words of their distance in the phrase, in either direction.

    KEY, phrase, first (where the phrase would begin by its rarest word) and off_by.
    Starts are put into buckets of ``slop + 1`` words, and each list's bucket and its
    neighbours are joined, so that no list meets another as a whole.
    """
    lists = posted.where("term IS NOT NULL").join(_small(ends), "term").withColumn("begin", F.col("position") - F.col("offset"))
    bucket = F.floor(F.col("begin") / (slop + 1))
    left = lists.where("leads").select(*KEY, "pair", F.col("begin").alias("first_begin"), bucket.alias("bucket"))
    right = lists.where("NOT leads").select(
        *KEY, "pair", F.col("begin").alias("second_begin"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")
    )
    off_by = F.col("second_begin") - F.col("first_begin")
    met = left.join(right, [*KEY, "pair", "bucket"]).where(F.abs(off_by) <= slop)
    return met.join(_small(found.select("pair", "phrase", "rarest")), "pair").select(
        *KEY, "phrase", (F.col("first_begin") - F.col("rarest")).alias("first"), off_by.alias("off_by")
    )


def near_items(
    docs: DataFrame, items: DataFrame, slop: int = 3, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """KEY, item_id and n (phrases met) of the items that a document has by proximity: also copies with changed words."""
    windows = item_windows(items, width, item_id, item_text)
    found = phrases(windows, corpus_counts(docs, windows, doc_id, text), absent=True)
    ends = pair_ends(found)
    near = proximity_matches(postings(docs, ends, width, doc_id, text), found, ends, slop)
    once = near.select(*KEY, "phrase").distinct()
    return once.join(_small(windows.select("phrase", "item_id")), "phrase").groupBy(*KEY, "item_id").agg(F.count(F.lit(1)).alias("n"))


def judge(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """For each row: KEY, n_words, n_hit, n_items, items (sorted ids, comma-joined) and contaminated."""
    windows = item_windows(items, width, item_id, item_text)
    found = phrases(windows, corpus_counts(docs, windows, doc_id, text))
    ends = pair_ends(found)
    posted = postings(docs, ends, width, doc_id, text)
    hits = settle(exact_matches(posted, found, ends).distinct())
    by_text = [F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")]
    places = hits.groupBy(*KEY, "first").agg(F.max("span").alias("span")).select(
        *KEY, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)).alias("position")
    )
    n_hit = places.distinct().groupBy(*by_text).agg(F.count(F.lit(1)).alias("n_hit"))
    of_phrase = _small(windows.select("phrase", "item_id"))
    named = hits.select(*KEY, "phrase").distinct().join(of_phrase, "phrase").groupBy(*by_text).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    whole = posted.where("term IS NULL").select(*KEY, F.col("position").cast("long").alias("n_words"))
    same = lambda side: whole["doc_id"].eqNullSafe(side["hit_id"]) & (whole["text_hash"] == side["hit_hash"])
    judged = whole.join(n_hit, same(n_hit), "left").drop("hit_id", "hit_hash").join(named, same(named), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        *KEY, "n_words", n.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"),
        ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad_id, bad_hash = fresh("bad_id", docs), fresh("bad_hash", docs)
    judged = judge(docs, items, **names).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash))
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    return docs.join(
        _small(settle(judged.distinct())),
        F.col(f"`{doc_id}`").eqNullSafe(F.col(bad_id)) & (text_hash(F.col(f"`{text}`")) == F.col(bad_hash)),
        "left_anti",
    )
