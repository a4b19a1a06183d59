"""Scalar column expressions for text, keys, versions, paths and times.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN = 1000


def text_key(value: Column) -> Column:
    """Text up to white space: two values with the same key read the same."""
    return F.concat(F.lit("t:"), F.trim(F.regexp_replace(value, r"[ \t\n\x0B\f\r]+", " ")))


def shown(value: Column, most: int = SHOWN) -> Column:
    """At most ``most`` characters, then an ellipsis."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.left(value, F.lit(most)), F.lit("…")))


def pointer_token(token: Column) -> Column:
    """One token of a JSON pointer, escaped."""
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer(path: Column) -> Column:
    """A path of tokens as a JSON pointer."""
    return F.array_join(F.transform(path, lambda t: F.concat(F.lit("/"), pointer_token(t))), "")


def shown_path(path: Column) -> Column:
    """A structural path for reading: dots between keys, array elements as []."""
    return F.replace(F.array_join(path, "."), F.lit(".[]"), F.lit("[]"))


def clean_text(value: Column, most: int) -> Column:
    """Control characters become spaces; then clipped."""
    return F.left(F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), F.lit(most))


def first_sentence(value: Column) -> Column:
    """Up to and with the first full stop that a space follows; the whole where there is none."""
    at = F.instr(value, ". ")
    return F.when(at > 0, F.left(value, at)).otherwise(value)


def version_key(version: Column) -> Column:
    """A version for comparing: trimmed, lower case, without a leading v before a digit."""
    return F.regexp_replace(F.lower(F.trim(version)), r"^v([0-9])", "$1")


def versions_agree(asked: Column, found: Column) -> Column:
    """Equal, or one a prefix of the other that ends at a dot."""
    a, b = version_key(asked), version_key(found)
    return (a == b) | F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(b, F.concat(a, F.lit(".")))


def product_tokens(name: Column) -> Column:
    """Lower-case words and numbers of a product name; a plural s at the end of longer words goes."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w))


def contains_run(tokens: Column, wanted: Column) -> Column:
    """Whether ``wanted`` stands in ``tokens`` as consecutive elements (an empty one doesn't)."""
    inner = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (F.size(wanted) > 0) & F.contains(inner, F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" ")))


def decoded_segments(path: Column) -> Column:
    """Path segments with percent escapes decoded one by one; a plus stays a plus, a bad escape stays as it is."""
    return F.transform(
        F.split(path, "/"),
        lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s),
    )


def normal_path(path: Column) -> Column:
    """A path template with unnamed parameters."""
    return F.regexp_replace(path, r"\{[^{}]*\}", "{}")


def plain_text(json_text: Column) -> Column:
    """The text that a JSON string stands for; other JSON values as they are written, null for none."""
    return F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")


def media_key(media: Column) -> Column:
    return F.replace(F.lower(media), F.lit(" "), F.lit(""))


def utc_text(at: Column) -> Column:
    """A time as text of exactly microseconds, so that the order of texts is that of times."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def strict_time(text: Column) -> Column:
    """The time of such a text; null for any other form."""
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}\+00:00$"
    return F.when(text.rlike(form), F.try_to_timestamp(text))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """A share, rounded half to even; null where the whole is zero."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def fingerprint_of(parts: list[Column]) -> Column:
    """SHA-256 over the digests of the parts, in order."""
    return F.sha2(F.concat(*(F.unhex(F.sha2(p, 256)) for p in parts)), 256)
