"""Match variants of the searched strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.functions.arrow import unescape
from hrefsieve.functions.encoding import encode_uri, quote_url
from hrefsieve.functions.text import JS_SPACE_CLASS, let, replace_first, strip
from hrefsieve.functions.urls import defragment, scheme_and_netloc


def _without_scheme(url: Column, scheme: Column) -> Column:
    return F.when(scheme != "", replace_first(url, F.concat(scheme, F.lit("://")), F.lit("")))


def _shortened(url: Column, host: Column, scheme: Column) -> Column:
    """The URL, it without scheme, without ``www.``, and without either; NULL where not apt."""
    bare = F.when(F.startswith(host, F.lit("www.")), replace_first(url, host, F.substr(host, F.lit(5))))
    both = let(bare, lambda b: F.when(b.isNotNull(), F.array(b, _without_scheme(b, scheme))))
    plain = F.array(url, _without_scheme(url, scheme))
    return F.coalesce(F.concat(plain, both), plain)


def _quote_forms(text: Column, unescaped: Column) -> Column:
    def forms(url: Column) -> Column:
        return let(scheme_and_netloc(url), lambda p: F.when(
            F.coalesce(p["netloc"] != "", F.lit(False)), _shortened(url, p["netloc"], p["scheme"])
        ).otherwise(F.array(url)))

    return F.concat(F.array(text, unescaped), let(F.coalesce(defragment(unescaped), unescaped), forms))


def _uri_forms(text: Column) -> Column:
    def forms(url: Column) -> Column:
        def by_host(p: Column) -> Column:
            host = F.lower(F.regexp_replace(p["netloc"], r"^.*@|:\d*\z", ""))
            named = F.coalesce((p["scheme"] != "") & (p["netloc"] != ""), F.lit(False))
            return F.when(named, let(host, lambda h: _shortened(url, h, p["scheme"]))).otherwise(F.array(url))

        return let(scheme_and_netloc(url), by_host)

    return F.concat(F.array(text), let(F.substring_index(text, "#", 1), forms))


def variants_of(text: Column, encode_mode: str = "quote", min_length: int = 6, unescaped: Column | None = None) -> Column:
    """All distinct forms of a searched string that are long enough to search for."""
    if encode_mode == "uri":
        trimmed, encode = strip(text, JS_SPACE_CLASS), encode_uri
        base = _uri_forms(trimmed)
        length = lambda v: F.octet_length(F.encode(v, "UTF-16BE")) / 2
    else:
        trimmed, encode, length = strip(text), quote_url, F.length
        base = _quote_forms(trimmed, unescaped if unescaped is not None else unescape(trimmed))
    both = let(F.array_distinct(F.array_compact(base)), lambda forms: F.array_union(forms, F.transform(forms, encode)))
    return F.filter(both, lambda v: length(v) >= min_length)


def input_variants(inputs: DataFrame, encode_mode: str = "quote", min_length: int = 6) -> DataFrame:
    """(queried_url, variant) for each distinct searched string.

    Repeated inputs are expanded once; the report joins them back. They meet in one
    exchange, repeats within a task first, so that a string listed many times sends a row
    from each; how many tasks expand them follows from the bytes that arrive.
    """
    once = inputs.select("queried_url").distinct()
    if encode_mode == "quote":
        once = once.withColumn("unescaped", unescape(strip(F.col("queried_url"))))
        forms = variants_of(F.col("queried_url"), encode_mode, min_length, F.col("unescaped"))
    else:
        forms = variants_of(F.col("queried_url"), encode_mode, min_length)
    return once.select("queried_url", F.explode(forms).alias("variant"))


def pattern_set(variants: DataFrame) -> DataFrame:
    """The distinct variants of all inputs."""
    return variants.select("variant").distinct()
