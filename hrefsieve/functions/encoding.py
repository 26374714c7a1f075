"""Percent-encoding and decoding with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters each rule leaves as they are (regex class bodies).
QUOTE_URL_SAFE = r"A-Za-z0-9_.~:/?#\[\]@!$&'()*+,;=%-"
QUOTE_PATH_SAFE = r"A-Za-z0-9_.~/-"
ENCODE_URI_SAFE = r"A-Za-z0-9;,/?:@&=+$_.!~*'()#-"


def percent_encode(c: Column, safe: str) -> Column:
    """Replace each character outside the class ``safe`` by the %XX of its UTF-8 bytes."""
    escaped = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(ch.rlike(rf"\A[{safe}]*\z"), ch).otherwise(
                F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )
    return F.when(F.regexp_like(c, F.lit(rf"\A[{safe}]*\z")), c).otherwise(escaped)


def quote_url(c: Column) -> Column:
    return percent_encode(c, QUOTE_URL_SAFE)


def quote_path(c: Column) -> Column:
    return percent_encode(c, QUOTE_PATH_SAFE)


def encode_uri(c: Column) -> Column:
    return percent_encode(c, ENCODE_URI_SAFE)


def unquote(c: Column, plus_is_space: bool = False) -> Column:
    """Undo percent-encoding; a ``%`` without two hex digits stays."""
    prepared = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        prepared = F.replace(prepared, F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(c, F.lit("%")) | F.contains(c, F.lit("+")), F.try_url_decode(prepared)).otherwise(c)
