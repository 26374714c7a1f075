"""The Python side: small Arrow UDFs around standard library parsers.

Only what no built-in expresses: gunzip, entity unescaping, HTML anchors and
sitemap XML. Rows that cannot need the helper are passed as NULL and cost nothing.
"""

from __future__ import annotations

import gzip
import html
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
LOCS = T.StructType().add("is_index", T.BooleanType()).add("locs", STRINGS)
#: bodies are given back to Spark at about so many bytes
PIECE_BYTES = 4 << 20


def in_pieces(columns: Iterator[pa.Array], one: Callable[[bytes], bytes | None]) -> Iterator[pa.Array]:
    """A function of each value, given back a few megabytes at a time.

    A batch holds up to 10,000 bodies, whatever their size. They are taken one by one, so
    that what is made of them never lies in a Python worker as a whole.
    """
    for column in columns:
        made, size = [], 0
        for value in column:
            made.append(one(value.as_py()) if value.is_valid else None)
            size += len(made[-1] or b"")
            if size >= PIECE_BYTES:
                yield pa.array(made, pa.binary())
                made, size = [], 0
        if made:
            yield pa.array(made, pa.binary())


def _gunzip_one(raw: bytes) -> bytes | None:
    try:
        return gzip.decompress(raw)
    except OSError:
        return raw
    except Exception:
        return None


@F.arrow_udf(T.BinaryType())
def _gunzip(body: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return in_pieces(body, _gunzip_one)


def inflated(body: Column, flagged: Column, keep_broken: bool = False) -> Column:
    """Gunzip the flagged bodies.

    Bytes that are not gzip stay as they are. A truncated or corrupt stream gives
    NULL, or with ``keep_broken`` the bytes as landed.
    """
    gzipped = flagged & (F.hex(F.substring(body, 1, 2)) == "1F8B")
    # marked non-deterministic so that a filter on the result doesn't run it again; so it stands here once only
    out = _gunzip.asNondeterministic()(F.when(gzipped, body))
    return F.when(gzipped, F.coalesce(out, body) if keep_broken else out).otherwise(body)


@F.arrow_udf(T.StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    """Resolve HTML entities; only text with an ``&`` visits Python."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            values = dict(attrs)
            if "href" in values:
                self.found.append(values["href"] or "")


def _anchor_links(url: str, text: str, keep_empty: bool) -> list[str]:
    parser = _Anchors()
    try:
        parser.feed(text)
        parser.close()
    except AssertionError:
        pass
    links = []
    for href in parser.found:
        if href or keep_empty:
            try:
                links.append(urldefrag(urljoin(url, href))[0])
            except ValueError:
                pass
    return links


@F.arrow_udf(STRINGS)
def _dom_links(url: pa.Array, text: pa.Array) -> pa.Array:
    pairs = zip(url.to_pylist(), text.to_pylist())
    return pa.array([None if t is None else _anchor_links(u, t, False) for u, t in pairs], pa.list_(pa.string()))


@F.arrow_udf(STRINGS)
def _dom_links_all(url: pa.Array, text: pa.Array) -> pa.Array:
    pairs = zip(url.to_pylist(), text.to_pylist())
    return pa.array([None if t is None else _anchor_links(u, t, True) for u, t in pairs], pa.list_(pa.string()))


def dom_links(url: Column, text: Column, keep_empty: bool = False) -> Column:
    """Absolute, defragmented links of a page's anchors, in document order.

    Links that cannot be resolved are left out. Pages without the letters ``<a`` skip
    the parser.
    """
    parse = _dom_links_all if keep_empty else _dom_links
    # marked non-deterministic so that looking for empty lists doesn't parse a page twice
    found = parse.asNondeterministic()(url, F.when(text.rlike("<[aA]"), text))
    return F.coalesce(found, F.array().cast("array<string>"))


def _read_locs(text: str) -> dict | None:
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    is_index = root.tag.rpartition("}")[2].lower() == "sitemapindex"
    parent = "sitemap" if is_index else "url"
    texts = (loc.text for loc in root.iterfind(f".//{{*}}{parent}/{{*}}loc"))
    return {"is_index": is_index, "locs": [t.strip() for t in texts if t and t.strip()]}


@F.arrow_udf(LOCS)
def sitemap_locs(text: pa.Array) -> pa.Array:
    """Locations named by a sitemap document; NULL if it is not well-formed."""
    kind = pa.struct([("is_index", pa.bool_()), ("locs", pa.list_(pa.string()))])
    return pa.array([None if t is None else _read_locs(t) for t in text.to_pylist()], kind)
