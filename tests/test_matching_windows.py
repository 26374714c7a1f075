"""The window strategy: anchors, filter, passes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hrefsieve.operators import matching
from hrefsieve.operators.links import page_blobs
from hrefsieve.operators.matching import find_patterns, matcher
from tests.test_matching import PATTERNS, TEXTS, brute


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TEXTS, "url string, blob string").repartition(5), spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


@pytest.mark.parametrize("bits", [8, 11, 13])
def test_several_passes_equal_one(frames, bits):
    texts, patterns = frames
    prepared = matcher(patterns, "windows", bits)
    assert len(prepared.passes) > 1 or bits == 13 and len(prepared.passes) >= 1
    assert sorted({tuple(r) for r in prepared(texts, "url", "blob").collect()}) == brute()


def test_anchors_are_the_rarest_grams(spark):
    urls = [f"https://www.example.com/shop/{i:04d}/index.html" for i in range(300)]
    raw = spark.createDataFrame([(u,) for u in urls], "pattern string").withColumn("raw", F.col("pattern").cast("binary"))
    pages = spark.createDataFrame([("https://www.example.com/shop/ /index.html " * 5,)] * 20, "html string")
    for sample in (None, pages):
        counts = matching._gram_counts(raw, sample, "html")
        shared = spark.sparkContext.broadcast(counts)
        offsets = [r[0] for r in raw.select(matching._anchored(shared)("raw").alias("a")).select("a.offset").collect()]
        assert all(24 <= o <= 32 for o in offsets)  # the grams that hold the number


def test_false_candidates_of_a_full_filter(spark):
    """Near misses of real patterns: anchors, places and lengths are right, the rest is not."""
    rng = np.random.default_rng(3)
    words = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 24)) for _ in range(n)]
    n = (1 << 16) // (matching.KEYS * matching.KEY_BITS)
    patterns = [f"https://h.com/{w}" for w in words(n)]
    prepared = matcher(spark.createDataFrame([(p,) for p in patterns], "pattern string"), "windows", 16)
    assert len(prepared.passes) == 1
    near = [p[:-1] + ("A" if p[-1] != "A" else "B") for p in patterns] + [p + " " for p in patterns[:50]] + [f"https://h.com/{w}" for w in words(20_000)]
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(near)], "url string, blob string").repartition(4)
    found = prepared.passes[0](texts, ["url"], "blob").select(F.explode("found").alias("raw")).select(F.col("raw").cast("string").alias("raw"))
    false = found.where(~F.col("raw").isin(patterns)).count()
    assert found.count() - false == 50 and false <= 0.005 * len(near)


def test_hot_substrings_and_short_patterns(spark, monkeypatch):
    monkeypatch.setattr("hrefsieve.session.BROADCAST_BYTES", 0)
    monkeypatch.setattr("hrefsieve.session.HOT_ROWS", 10)
    texts = spark.createDataFrame([(f"u{i}", f"common.example é{i} b") for i in range(200)], "url string, blob string")
    patterns = spark.createDataFrame([(p,) for p in ("common.example", "é7", "b", "x", "é19 b")], "pattern string")
    got = {tuple(r) for r in find_patterns(texts, patterns, "windows").collect()}
    want = {(f"u{i}", p) for i in range(200) for p in ("common.example", "é7", "b", "x", "é19 b") if p in f"common.example é{i} b"}
    assert got == want


def test_gram_slots_of_short_and_empty_values():
    column = pa.array([b"", b"ab", None, b"abcdefgh"], pa.binary())
    within, rows, _, _ = matching._grams(column)
    assert rows.tolist() == [1, 3, 3, 3] and within.tolist() == [0, 0, 1, 2]


def test_anchors_are_chosen_on_texts_made_by_lambdas(spark):
    """Blobs of the regex mode: their links come from higher-order functions."""
    pages = spark.createDataFrame([("https://h.test/a", '<a href="/one">1</a> two'), ("https://h.test/b", "three")], "url string, html string")
    patterns = spark.createDataFrame([("h.test/one",), ("three",), ("four",)], "pattern string")
    hits = find_patterns(page_blobs(pages, "regex"), patterns, "windows")
    assert sorted(map(tuple, hits.collect())) == [("https://h.test/a", "h.test/one"), ("https://h.test/b", "three")]
