"""Text columns: trimming, lines, UTF-8 decoding, header maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that str.strip() removes, and line ends of str.splitlines().
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Fixed value: white space as JavaScript sees it.
JS_SPACE_CLASS = r"[\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def strip(c: Column, space: str = SPACE_CLASS) -> Column:
    """Remove white space, Unicode included, from both ends."""
    return F.regexp_replace(c, rf"\A{space}+|{space}+\z", "")


def lines(c: Column) -> Column:
    """Array of the lines of a text; a final line end opens no further line."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def decode_utf8(body: Column, drop_invalid: bool = True) -> Column:
    """Bytes to text. Invalid sequences are dropped, or kept as U+FFFD."""
    text = body.cast("string")
    repaired = F.make_valid_utf8(text)
    if drop_invalid:
        repaired = F.replace(repaired, F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def lower_keys(headers: Column) -> Column:
    """Header map with lower-cased names; of names equal but for case, the last wins."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]),
    )


def header(headers: Column, name: str) -> Column:
    """Value of one header, its name in any case; '' if absent."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(F.transform(hits, lambda e: e["value"]), F.size(hits) - 1), F.lit(""))


def looks_like_xml(text: Column) -> Column:
    """Does the text, trimmed, start with ``<``?"""
    return F.regexp_like(text, F.lit(rf"\A{SPACE_CLASS}*<"))


def let(value: Column, body) -> Column:
    """Bind a computed value to a name once, for use many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_first(c: Column, find: Column, by: Column) -> Column:
    """Replace the first occurrence of a plain string."""
    head = F.substring_index(c, find, 1) if isinstance(find, str) else F.split_part(c, find, F.lit(1))
    tail = F.substr(c, F.length(head) + F.length(find) + 1)
    return F.when((find != "") & F.contains(c, find), F.concat(head, by, tail)).otherwise(c)
