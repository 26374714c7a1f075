import random

import pytest
from pyspark.sql import functions as F

from hrefsieve.operators import matching
from hrefsieve.operators.matching import find_patterns
from hrefsieve.operators.pages_per_pattern import first_pages, page_sets

rng = random.Random(7)


def word(n, alphabet="abé漢"):
    return "".join(rng.choice(alphabet) for _ in range(n))


TEXTS = [(f"u{i:03d}", word(rng.randrange(0, 400))) for i in range(60)] + [("dup", "ababab" * 9), ("dup", "bababa" * 9), ("empty", "")]
PATTERNS = sorted({word(rng.randrange(6, 9)) for _ in range(120)} | {word(7, "ab") for _ in range(60)} | {"ababab", "abababab", "nowhere", "é漢"})


def brute():
    return sorted({(u, p) for u, t in TEXTS for p in PATTERNS if p in t})


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TEXTS, "url string, blob string").repartition(5), spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


@pytest.mark.parametrize("strategy", ["auto", "native", "automaton", "windows"])
def test_strategies_agree_with_brute_force(frames, strategy):
    got = {tuple(r) for r in find_patterns(*frames, strategy=strategy).collect()}
    assert sorted(got) == brute()


def test_windows_with_a_small_bitmap(frames):
    texts, patterns = frames
    got = find_patterns(texts, patterns, strategy="windows", bits=16)
    want = {}
    for u, p in brute():
        want.setdefault(p, []).append(u)
    got_sets = {r["pattern"]: r["pages"] for r in page_sets(got, 3).collect()}
    assert got_sets == {p: us[:3] for p, us in want.items()}


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(matching, "PIECE", 64)
    texts = spark.createDataFrame(TEXTS, "url string, blob string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    assert sorted({tuple(r) for r in find_patterns(texts, patterns, strategy="windows").collect()}) == brute()


@pytest.mark.parametrize("strategy", ["auto", "automaton", "windows"])
def test_no_patterns(frames, strategy):
    assert find_patterns(frames[0], frames[1].limit(0), strategy=strategy).count() == 0


def test_a_list_too_large_to_broadcast_takes_windows(frames, monkeypatch):
    monkeypatch.setattr(matching, "AUTOMATON_CHARS", 100)
    assert sorted({tuple(r) for r in find_patterns(*frames).collect()}) == brute()
    with pytest.raises(ValueError):
        find_patterns(*frames, strategy="automaton")


def test_without_the_automaton_library(frames, monkeypatch):
    monkeypatch.setattr(matching, "ahocorasick", None)
    assert sorted({tuple(r) for r in find_patterns(*frames).collect()}) == brute()


def test_first_pages_of_a_pattern_on_most_pages(spark):
    hits = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("pattern"),
        F.format_string("%06d", F.col("id") % 20_000).alias("url"),
    )
    capped = first_pages(hits, 4)
    got = {}
    for r in capped.collect():
        got.setdefault(r["pattern"], []).append(int(r["url"]))
    want = {}
    for i in range(50_000):
        want.setdefault("rare" if i % 3 == 0 else "hot", set()).add(i % 20_000)
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v)[:4] for p, v in want.items()}
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("WindowGroupLimit") == 2  # before and after the shuffle
