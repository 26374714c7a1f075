"""URL columns: splitting, resolving, defragmenting and the predicates on them.

Everything is a built-in expression, so it stays in the JVM and filters built from
it run right above the scan. A malformed authority gives NULL, never an error.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from hrefsieve.functions.encoding import unquote
from hrefsieve.functions.text import let
from hrefsieve.params import BINARY_EXTENSIONS

# Which schemes resolve relative links, have an authority, or ";params".
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
NETLOC_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
)
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
    "sips", "mms", "sftp", "tel",
)

_URL = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_START = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?"
# A URL that splitting and joining again leaves as it is, up to its fragment.
_PLAIN = r"\Ahttps?://[A-Za-z0-9.:@_~%-]+(?:/[^?#;\t\r\n]*)?(?:\?[^#\t\r\n]+)?(?:#|\z)"
# A root-relative link without dot segments, params or empty query, up to its fragment.
_ROOTED = r"\A/(?!/)(?![^?#]*/\.)(?!\.)[^?#;\t\r\n]*(?:\?[^#\t\r\n]+)?(?:#|\z)"
_PLAIN_BASE = r"\Ahttps?://[A-Za-z0-9.:@_~%-]+(?:[/?#]|\z)"


def _ipv6_pattern() -> str:
    h, v4 = "[0-9A-Fa-f]{1,4}", r"(?:\d{1,3}\.){3}\d{1,3}"
    forms = [f"{h}(?::{h}){{7}}", f"(?:{h}:){{6}}{v4}"]
    for left in range(8):
        head = f"{h}(?::{h}){{{left - 1}}}" if left else ""
        tails = [f"(?:{h}(?::{h}){{0,{6 - left}}})?"] if left < 7 else [""]
        if left < 6:
            tails.append(f"(?:{h}:){{0,{5 - left}}}{v4}")
        forms += [f"{head}::{tail}" for tail in tails]
    return "(?:" + "|".join(forms) + ")(?:%.+)?"


@cache
def _delimiter_lookalikes() -> str:
    """Characters that normalise (NFKC) to text with a URL delimiter in it."""
    return "".join(
        ch for ch in map(chr, range(0x80, 0x10000))
        if not 0xD800 <= ord(ch) < 0xE000 and set(unicodedata.normalize("NFKC", ch)) & set("/?#@:")
    )


@cache
def _good_netloc() -> str:
    host = rf"(?:{_ipv6_pattern()}|v[a-fA-F0-9]+\.[^\]]+)"
    return rf"(?s)\A(?!.*[{_delimiter_lookalikes()}])(?:[^\[\]]*|(?=.*\])[^\[]*\[{host}(?:\].*)?)\z"


def _one_of(value: Column, names: tuple[str, ...]) -> Column:
    return value.rlike(rf"\A(?:{'|'.join(re.escape(n) for n in names)})\z")


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(url: Column, default_scheme: Column | None = None) -> Column:
    """Struct (scheme, netloc, path, params, query, fragment), NULL if malformed."""
    def parts(clean: Column) -> Column:
        def group(i: int) -> Column:
            return F.regexp_extract(clean, _URL, i)

        scheme = F.lower(group(1))
        if default_scheme is not None:
            scheme = F.when(scheme == "", default_scheme).otherwise(scheme)
        return F.struct(
            scheme.alias("scheme"), group(2).alias("netloc"), group(3).alias("path"),
            group(4).alias("query"), group(5).alias("fragment"),
        )

    def with_params(p: Column) -> Column:
        path = p["path"]
        has_params = F.contains(path, F.lit(";")) & _one_of(p["scheme"], PARAM_SCHEMES)
        bare = F.regexp_extract(path, r"(?s)\A((?:.*/)?[^/;]*)", 1)
        params = F.regexp_extract(path, r"(?s)\A(?:.*/)?[^/;]*;([^/]*)\z", 1)
        return F.when(
            p["netloc"].rlike(_good_netloc()),
            F.struct(
                p["scheme"], p["netloc"], F.when(has_params, bare).otherwise(path).alias("path"),
                F.when(has_params, params).otherwise("").alias("params"), p["query"], p["fragment"],
            ),
        )

    return let(let(_cleaned(url), parts), with_params)


def scheme_and_netloc(url: Column) -> Column:
    """Struct (scheme, netloc), NULL if malformed."""
    def parts(clean: Column) -> Column:
        netloc = F.regexp_extract(clean, _START, 2)
        return F.when(netloc.rlike(_good_netloc()), F.struct(
            F.lower(F.regexp_extract(clean, _START, 1)).alias("scheme"), netloc.alias("netloc")
        ))

    return let(_cleaned(url), parts)


def join_url(p: Column, fragment: bool = True, authority: bool = True) -> Column:
    """Put the parts of a URL together again; empty parts leave no delimiter."""
    def led(mark: str, part: Column) -> Column:
        return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")

    path = F.concat(p["path"], led(";", p["params"]))
    tail = [led("?", p["query"])] + ([led("#", p["fragment"])] if fragment else [])
    double = F.startswith(p["path"], F.lit("//"))
    if not authority:
        return F.concat(F.when(double, "//").otherwise(""), path, *tail)
    rooted = F.startswith(path, F.lit("/"))
    start = (
        F.when(p["netloc"] != "", F.concat(F.lit("//"), p["netloc"], F.when(rooted | (path == ""), "").otherwise("/")))
        .when(double, "//")
        .when((rooted | (path == "")) & (p["scheme"] != "") & _one_of(p["scheme"], NETLOC_SCHEMES), "//")
        .otherwise("")
    )
    scheme = F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise("")
    return F.concat(scheme, start, path, *tail)


def defragment(url: Column) -> Column:
    """The URL without its fragment; NULL if it has one and is malformed."""
    return (
        F.when(~F.contains(url, F.lit("#")), url)
        .when(url.rlike(_PLAIN), F.substring_index(url, "#", 1))
        .otherwise(let(split_url(url), lambda p: join_url(p, fragment=False)))
    )


def _merged_path(base_path: Column, path: Column) -> Column:
    """Path of a relative reference against the path of its base, dot segments resolved."""
    own = F.split(path, "/")
    base = F.split(base_path, "/")
    directory = F.when(F.element_at(base, -1) != "", F.slice(base, F.lit(1), F.size(base) - 1)).otherwise(base)

    def squeezed(all_parts: Column) -> Column:
        inner = F.filter(
            F.slice(all_parts, F.lit(2), F.greatest(F.size(all_parts) - 2, F.lit(0))), lambda s: s != ""
        )
        ends = F.concat(F.slice(all_parts, 1, 1), inner, F.slice(all_parts, -1, 1))
        return F.when(F.size(all_parts) > 1, ends).otherwise(all_parts)

    segments = F.when(F.startswith(path, F.lit("/")), own).otherwise(let(F.concat(directory, own), squeezed))

    def resolved(segs: Column) -> Column:
        last = F.element_at(segs, -1)
        walked = F.aggregate(
            segs,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        closed = F.concat(walked, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        return F.array_join(closed, "/")

    return let(let(segments, resolved), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _resolved(base: Column, href: Column, fragment: bool) -> Column:
    """Resolution of any link, by its parts."""
    def against(pair: Column) -> Column:
        b, u, scheme = pair["b"], pair["u"], pair["u"]["scheme"]
        foreign = (scheme != b["scheme"]) | ~_one_of(scheme, RELATIVE_SCHEMES)
        complete = _one_of(scheme, NETLOC_SCHEMES) & (u["netloc"] != "")
        same_path = (u["path"] == "") & (u["params"] == "")
        kept = ~complete & same_path
        parts = F.struct(
            scheme.alias("scheme"),
            F.when(complete, u["netloc"]).otherwise(b["netloc"]).alias("netloc"),
            F.when(complete, u["path"]).when(same_path, b["path"]).otherwise(_merged_path(b["path"], u["path"])).alias("path"),
            F.when(kept, b["params"]).otherwise(u["params"]).alias("params"),
            F.when(kept & (u["query"] == ""), b["query"]).otherwise(u["query"]).alias("query"),
            u["fragment"].alias("fragment"),
        )
        as_is = href if fragment else defragment(href)
        own = let(parts, lambda p: join_url(p, fragment))
        return F.when(b.isNotNull() & u.isNotNull(), F.when(foreign, as_is).otherwise(own))

    return let(split_url(base), lambda b: let(
        F.struct(b.alias("b"), split_url(href, b["scheme"]).alias("u")), against
    ))


def _linked(base: Column, href: Column, fragment: bool) -> Column:
    plain_base = base.rlike(_PLAIN_BASE)
    origin = F.regexp_extract(base, r"\A(https?://[A-Za-z0-9.:@_~%-]+)", 1)

    def ready(u: Column) -> Column:
        return u if fragment else F.substring_index(u, "#", 1)

    easy = plain_base & ~F.endswith(href, F.lit("#")) if fragment else plain_base
    return (
        F.when(easy & href.rlike(_ROOTED), F.concat(origin, ready(href)))
        .when(easy & href.rlike(_PLAIN), ready(href))
        .when(href == "", base if fragment else defragment(base))
        .when(base == "", href if fragment else defragment(href))
        .otherwise(_resolved(base, href, fragment))
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``; NULL if either is malformed."""
    return _linked(base, href, fragment=True)


def link_target(base: Column, href: Column) -> Column:
    """The resolved link without its fragment."""
    return _linked(base, href, fragment=False)


def authority(url: Column) -> Column:
    """Lower-cased authority, port and user included; NULL if malformed."""
    netloc = F.regexp_extract(_cleaned(url), _START, 2)
    return F.when(netloc.rlike(_good_netloc()), F.lower(netloc))


def path_of(url: Column) -> Column:
    """Lower-cased path without the ``;params`` of its last segment."""
    return F.lower(split_url(url)["path"])


def query_keys(url: Column) -> Column:
    """Decoded names of the query parameters that have a value; NULL if malformed."""
    pairs = F.when(authority(url).isNotNull(), F.split(F.regexp_extract(_cleaned(url), _URL, 4), "&"))
    valued = F.filter(pairs, lambda kv: kv.rlike(r"(?s)\A[^=]*=."))
    return F.array_distinct(F.transform(valued, lambda kv: unquote(F.substring_index(kv, "=", 1), plus_is_space=True)))


def host_in(host: Column, domains: Sequence[str]) -> Column:
    """Is the host one of the domains or below one? One pass over the host for all of them."""
    if not domains:
        return F.lit(False)
    listed = "|".join(re.escape(d) for d in domains)
    return F.coalesce(host.rlike(rf"(?s)\A(?:.*\.)?(?:{listed})\z"), F.lit(False))


def same_domain(url: Column, domains: Sequence[str]) -> Column:
    return host_in(authority(url), domains)


def is_binary(url: Column) -> Column:
    """Does the path end like a file that is not a page?"""
    endings = "|".join(e[1:] for e in BINARY_EXTENSIONS)
    return F.coalesce(path_of(url).rlike(rf"\.(?:{endings})\z"), F.lit(False))


def is_sitemap_like(url: Column) -> Column:
    """Does the URL look like a sitemap document?"""
    low = F.lower(url)
    by_key = F.exists(query_keys(url), lambda k: F.contains(F.lower(k), F.lit("sitemap")))
    by_text = low.rlike(r"(?s)\.xml(?:\.gz)?\z") | F.contains(low, F.lit("sitemap"))
    # Only a percent-encoded name can add to the plain text test.
    return by_text | F.coalesce(F.contains(url, F.lit("%")) & by_key, F.lit(False))


def host_suffixes(host: Column) -> Column:
    """The host and every parent of it: a.b.c, b.c, c."""
    labels = F.split(host, "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
