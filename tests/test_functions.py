import gzip
import html
import itertools
import unicodedata
from urllib.parse import parse_qs, quote, unquote, urldefrag, urljoin, urlparse

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hrefsieve.functions import arrow, encoding, text, urls

BATCH = settings(
    max_examples=2, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck)
)
url_text = st.text(alphabet="aZ09:/?#[]@!$&'()*+,;=%.-_~ \t\né漢😀wW", max_size=24)


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.repartition(1).sortWithinPartitions("i").select(expression(F.col("v"))).collect()]


def same(values, got, want):
    assert [x for x in zip(values, got, want) if x[1] != x[2]] == []


def expected(values, fn):
    out = []
    for v in values:
        try:
            out.append(fn(v))
        except ValueError:
            out.append(None)
    return out


URLS = [
    "https://EXAMPLE.com/a;p?q=1#f", "HTTP://www.x.com:80/A.PDF?x", "//host/p", "/p/../q/./r;x;y", "a/b?#", "?q", "#f", "",
    "mailto:b@c", "javascript:void(0)", "http://[", "http://[::1]/x", "http://[::1:2:3:4:5:6:7:8]/", "http://a]b/", "http://[1.2.3.4]/",
    "http://x/?", "http://x/#", "http:///p", "http:p", "https:p/q", " \x01https://x/\ty", "x;y", "/;y/z;w", "//", "///x", ".", "..", "../..",
    "./", "a//b/../c//", "http://℀x/", "http://é/", "1a:b", "a.b+c-d:e", "http://u:p@h:1/x?a=b;c#d", "ftp://h/x;type=a", "file:///x", "tel:1;x",
]


@pytest.mark.parametrize("base", ["https://example.com/es/12?u=1", "http://x.io", "https://x.io/a/b/;p?q#f", "HTTPS://X/a", "ftp://h/d/f"])
def test_resolve_table(spark, base):
    got = column(spark, URLS, lambda v: urls.resolve(F.lit(base), v))
    assert got == expected(URLS, lambda v: urljoin(base, v))
    got = column(spark, URLS, lambda v: urls.link_target(F.lit(base), v))
    assert got == expected(URLS, lambda v: urldefrag(urljoin(base, v))[0])


def test_defragment_table(spark):
    assert column(spark, URLS, urls.defragment) == expected(URLS, lambda v: urldefrag(v)[0])


def test_authority_and_path(spark):
    assert column(spark, URLS, urls.authority) == expected(URLS, lambda v: urlparse(v).netloc.lower())
    assert column(spark, URLS, urls.path_of) == expected(URLS, lambda v: urlparse(v).path.lower())


@BATCH
@given(st.lists(url_text, min_size=150, max_size=150))
def test_url_properties(spark, values):
    base = "https://h.com/a/b?c"
    same(values, column(spark, values, lambda v: urls.resolve(F.lit(base), v)), expected(values, lambda v: urljoin(base, v)))
    same(values, column(spark, values, lambda v: urls.link_target(F.lit(base), v)), expected(values, lambda v: urldefrag(urljoin(base, v))[0]))
    same(values, column(spark, values, urls.defragment), expected(values, lambda v: urldefrag(v)[0]))
    same(values, column(spark, values, encoding.quote_url), [quote(v, safe=":/?#[]@!$&'()*+,;=%") for v in values])
    same(values, column(spark, values, encoding.quote_path), [quote(v) for v in values])
    same(values, column(spark, values, encoding.unquote), [unquote(v) for v in values])
    same(values, column(spark, values, text.strip), [v.strip() for v in values])


@BATCH
@given(st.lists(st.text(alphabet="/.ab;?#", max_size=14), min_size=300, max_size=300))
def test_dot_segments(spark, values):
    base = "https://h.com/a/b/c;d?e"
    same(values, column(spark, values, lambda v: urls.resolve(F.lit(base), v)), expected(values, lambda v: urljoin(base, v)))
    same(values, column(spark, values, lambda v: urls.link_target(F.lit(base), v)), expected(values, lambda v: urldefrag(urljoin(base, v))[0]))


@BATCH
@given(st.lists(st.text(max_size=20), min_size=150, max_size=150))
def test_text_properties(spark, values):
    values = [v.replace("\x00", "") for v in values]
    same(values, column(spark, values, text.strip), [v.strip() for v in values])
    same(values, column(spark, values, text.lines), [v.splitlines() for v in values])
    same(values, column(spark, values, arrow.unescape), [html.unescape(v) for v in values])
    same(values, column(spark, values, encoding.quote_url), [quote(v, safe=":/?#[]@!$&'()*+,;=%") for v in values])


def test_unescape(spark):
    values = ["a&amp;b", "&lt;x&gt;", "&#10;", "&notit;", "plain", "&copy"]
    assert column(spark, values, arrow.unescape) == [html.unescape(v) for v in values]


def test_encode_uri(spark):
    values = ["https://x.io/a b%[é]", "#?;,/:@&=+$-_.!~*'()"]
    assert column(spark, values, encoding.encode_uri) == ["https://x.io/a%20b%25%5B%C3%A9%5D", values[1]]


def test_query_keys(spark):
    values = ["http://x/?a=1&b=&c&s%69temap=2&d+e=3", "http://x/", "http://x/?%zz=1", "?=1"]
    assert [sorted(k) for k in column(spark, values, urls.query_keys)] == [
        sorted(parse_qs(urlparse(v).query)) for v in values
    ]


def test_predicates(spark):
    def check(fn, yes, no):
        assert column(spark, yes + no, fn) == [True] * len(yes) + [False] * len(no)

    check(
        lambda v: urls.same_domain(v, ["example.com"]),
        ["https://EXAMPLE.com/", "https://a.example.com/"],
        ["https://notexample.com/", "https://example.com:8080/", "example.com/x", "http://["],
    )
    check(lambda v: urls.same_domain(v, []), [], ["https://example.com/"])
    check(urls.is_binary, ["https://x.io/a.PDF?v=1", "https://x.io/a.pdf;v=1"], ["https://x.io/a?f=b.pdf", "https://x.io/pdf", "http://[/a.pdf"])
    check(
        urls.is_sitemap_like,
        ["https://x.io/feed.xml", "https://x.io/?sitemap=1", "https://x.io/My-Sitemap/", "https://x.io/f.XML.gz", "https://x.io/?s%69temap=1"],
        ["https://x.io/feed.xml?p=1", "https://x.io/?s%69temap=", "https://x.io/", "http://[?s%69temap=1"],
    )


def test_lookalikes_are_all_in_the_basic_plane():
    assert not [c for c in map(chr, range(0x10000, 0x110000)) if set(unicodedata.normalize("NFKC", c)) & set("/?#@:")]


def test_bytes(spark):
    raw = [b"a\xffb\xc3", "é�".encode(), b"", b"\xe6\xbc", b"\xf0\x9f\x98ok"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, b binary").orderBy("i")
    assert [r[0] for r in rows.select(text.decode_utf8(F.col("b"))).collect()] == [b.decode("utf-8", "ignore") for b in raw]
    assert rows.select(text.decode_utf8(F.col("b"), drop_invalid=False)).first()[0] == "a�b�"


def test_gunzip(spark):
    packed = gzip.compress(b"hello" * 50)
    cases = [(packed, True), (packed, False), (b"plain", True), (packed[:-12], True), (b"", True), (packed[:15] + b"\x00\xff" * 20, True)]
    rows = spark.createDataFrame([(i, b, f) for i, (b, f) in enumerate(cases)], "i int, b binary, f boolean").orderBy("i")
    got = [None if r[0] is None else bytes(r[0]) for r in rows.select(arrow.inflated(F.col("b"), F.col("f"))).collect()]
    assert got[:5] == [b"hello" * 50, packed, b"plain", None, b""]
    kept = [bytes(r[0]) for r in rows.select(arrow.inflated(F.col("b"), F.col("f"), keep_broken=True)).collect()]
    assert kept[3] == packed[:-12]


def test_headers(spark):
    row = spark.createDataFrame([({"Content-TYPE": "a", "X": "c"},)], "h map<string,string>")
    got = row.select(text.lower_keys(F.col("h")), text.header(F.col("h"), "content-type"), text.header(F.col("h"), "no")).first()
    assert got[0] == {"content-type": "a", "x": "c"} and got[1] == "a" and got[2] == ""


def test_replace_first(spark):
    cases = list(itertools.product(["https://a/?u=https://b", "aaa", ""], ["https://", "a", ""], ["", "Z"]))
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, f string, r string").orderBy("i")
    got = [r[0] for r in rows.select(text.replace_first(F.col("s"), F.col("f"), F.col("r"))).collect()]
    assert got == [s.replace(f, r, 1) if f else s for s, f, r in cases]


def test_host_suffixes(spark):
    assert column(spark, ["a.b.c", "x"], urls.host_suffixes) == [["a.b.c", "b.c", "c"], ["x"]]


def test_looks_like_xml(spark):
    assert column(spark, ["  \n<a", "﻿<a", "x<a", ""], text.looks_like_xml) == [True, False, False, False]


def test_bodies_visit_python_once_and_in_pieces(spark, tmp_path, monkeypatch):
    from hrefsieve.plans.derived import byte_docs
    from hrefsieve.sources.landed import text_documents

    spark.createDataFrame([(i, f"https://h.test/{i}", f"<p>{i} é") for i in range(16)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    texts = text_documents(byte_docs(spark, str(tmp_path)))
    plan = texts._jdf.queryExecution().optimizedPlan().toString() + texts._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert [plan.count(f"ArrowEvalPython [{name}(") for name in ("_gzipped", "_gunzip")] == [2, 2]  # once in each of the plans
    assert plan.count("_gunzip(") == 2
    want = {f"https://h.test/{i}" + (".gz" if i % 8 in (1, 4) else ""): ("ab" if i % 8 == 5 else "") + f"<p>{i} é" for i in range(16) if i % 8 not in (3, 6, 7)}
    assert {r["url"]: r["text"] for r in texts.collect()} == want
    monkeypatch.setattr(arrow, "PIECE_BYTES", 8)
    pieces = list(arrow.in_pieces(iter([pa.array([b"abcd", b"abcd", None, b"x"], pa.binary()), pa.array([], pa.binary())]), lambda b: b + b"!"))
    assert [p.to_pylist() for p in pieces] == [[b"abcd!", b"abcd!"], [None, b"x!"]]
