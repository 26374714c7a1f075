"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from hrefsieve.llm import jaccard_join as j


def plain_sets(rows, width):
    out = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        out.setdefault(i, []).append(frozenset(sets))
    return out


def plain_groups(rows, width, percent):
    sets = plain_sets([r for r in rows if r[0] is not None], width)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def corpus(seed, families, copies, words):
    """Families of texts that differ in a few words each, so that similarities lie about the bound."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice(words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(0, max(2, len(text) // 40))):
                at = r.randrange(len(text))
                text[at:at + r.choice([0, 1, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
            rows.append(" ".join(text).title() if r.random() < 0.2 else "  ".join(text))
    r.shuffle(rows)
    return [(i + 1, t) for i, t in enumerate(rows)]


def check(spark, rows, width=3, percent=90, **settings):
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, rep int").repartition(4)
    got = j.similar_groups(frame, width, percent, **settings).collect()
    assert len(got) == len(rows)
    want = plain_groups(rows, width, percent)
    sizes = plain_sets(rows, width)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["n_shingles"] in {len(s) for s in sizes[r["doc_id"]]}
    assert len({r["component_id"] for r in got}) > 1 or len(rows) < 2


@pytest.mark.parametrize("pair_cost", [j.PAIR_COST, 1e9])
def test_groups_equal_all_pairs(spark, pair_cost):
    check(spark, corpus(1, 14, 12, [5, 9, 14, 22, 40, 90, 160, 300]), pair_cost=pair_cost)


def test_other_widths_and_bounds(spark):
    check(spark, corpus(2, 10, 9, [12, 30, 80, 150]), width=2, percent=80)


def test_one_family_about_the_bound(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 16)
    check(spark, corpus(3, 1, 90, [220]) + [(1000 + i, f"other text {i} stands alone") for i in range(5)])


def test_odd_rows(spark, texts):
    check(spark, texts)


def test_no_rows(spark, no_docs):
    assert j.similar_groups(no_docs).count() == 0


def test_partners_lie_in_neighbouring_bands():
    lows = j.bands(90)
    for s in [*range(1, 3000), 10**6]:
        band = np.searchsorted(lows, s, "right") - 1
        assert s * 100 // 90 < lows[band + 2]
        assert j.cells_of(int(band), 90) >= j.most_differences(s + s * 100 // 90, 90) + 1


@pytest.mark.parametrize("chosen", [False, True])
def test_similar_sets_share_a_key(chosen):
    """Whatever the choice for each pair of cells, and with the spare cell left out."""
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(2, 400))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(int(r.integers(0, 1 + len(a) // 8))):
            b = np.unique(np.append(np.delete(b, r.integers(0, len(b))), r.integers(0, 1 << 63).astype(np.uint64)))
            if r.random() < 0.3 and len(b) > 1:
                b = np.delete(b, r.integers(0, len(b)))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        a, b = sorted((a, b), key=len)
        window = int(np.searchsorted(j.bands(90), len(a), "right")) - 1
        marks = r.random(j.CELLS // 2) < 0.5 if chosen else np.zeros(j.CELLS // 2, bool)
        skipped = int(r.integers(0, j.cells_of(window, 90))) if j.spare(window, 90) else -1
        keys = []
        for s in (a, b):
            sums = j._running(s)
            exact = j.exact_keys(s, sums, window, 90)
            cell = np.arange(len(exact))
            exact = exact[~marks[(cell // 2) % len(marks)] & ((cell != skipped) | marks[skipped // 2])]
            keys.append((set(exact.tolist()), *(set(k.tolist()) for k in j.deletion_keys(s, sums, window, 90, marks))))
        (ea, wa, la), (eb, wb, lb) = keys
        assert ea & eb or wa & (wb | lb) or wb & la


def test_sketches_never_turn_away_similar_sets():
    r = np.random.default_rng(5)
    for n in (1, 3, 40, 700, 5000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, 1, n // 20, n // 8):
            b = np.unique(np.concatenate([a[m:], r.integers(0, 1 << 63, m).astype(np.uint64)]))
            apart = int(np.bitwise_count(np.bitwise_xor(*j._folded([j.sketch(a, 90), j.sketch(b, 90)]))).sum())
            assert apart <= len(np.setxor1d(a, b))
