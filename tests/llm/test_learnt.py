"""Operators that learn, against brute force, held-out accuracy and targets."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hrefsieve.llm import mixing, neighbours, tool_calls, toxicity
from hrefsieve.llm.components import components
from tests.llm.conftest import prose


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(k, k + 1) for k in range(20, 60)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {k: 20 for k in range(20, 61)} | {k: 100 for k in range(100, 160)}
    assert got == want


def test_components_take_three_shuffles_a_round(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20, 60)] + [(100, k) for k in range(101, 160)], "a long, b long")
    stars = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    jobs = []
    for name, frame in (("chain", edges), ("stars", stars)):
        spark.sparkContext.setJobGroup(f"components of {name}", name)
        try:
            components(frame)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components of {name}")))
    assert jobs[0] <= 60 and jobs[1] <= 4  # with shuffles for distinct rows and for a check apart: 78 and 6


def brute_neighbours(rows, k):
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            scored = sorted((-float(np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y))), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=8).tolist()) for i in range(300)]
    good += [(1000 + i, good[50][1]) for i in range(40)]
    bad = [(None, good[0][1]), (2000, None), (2050, [0.0] * 8), (2001, [math.nan] * 8), (2002, [math.inf] + [0.0] * 7), (2003, [1.0, None] + [0.0] * 6), (2004, [1.0])]
    frame = spark.createDataFrame([(i, x, "y", 1) for i, x in good + bad + good[:20]], "vec_id long, embedding array<double>, part string, rank int")
    setup = neighbours.Settings(sample=200, part_rows=50, block=64, queries=4, mass=1.0, epochs=3)
    got = {}
    for row in neighbours.search(frame, F.col("vec_id") % 50 == 0, 5, setup).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    want = brute_neighbours(good, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q], strict=True))
    few = neighbours.search(spark.createDataFrame(good[:3] + [(4, [0.0] * 8)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert [(r.query_id, r.rank) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_parts_are_balanced_and_keep_neighbours():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(100, 6)) * 0.1 + c for c in np.eye(6)[:4] * 3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 5), 4)
    assert np.bincount(label).max() <= 105
    assert np.mean([np.bincount(label[i : i + 100]).max() for i in range(0, 400, 100)]) > 95


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    vectors = [{int(t): int(c) for t, c in zip(r.choice(30, 5, replace=False), r.integers(1, 4, 5), strict=True)} for _ in range(400)]
    index = toxicity.Index(vectors, list(range(400)), [k % 2 for k in range(400)], 1 + r.random(30), 16)
    for v in vectors[:50]:
        at, sims = index.nearest(v, 10)
        t, w = index.weights(v)
        q = np.zeros(30)
        q[t] = w
        dense = np.zeros((400, 30))
        for k, x in enumerate(vectors):
            t, w = index.weights(x)
            dense[k, t] = w
        exact = dense @ q
        order = np.lexsort((np.arange(400), -np.round(exact, 12)))[:10]
        assert index.ids[at].tolist() == order.tolist() and np.allclose(sims, exact[order])


def test_toxicity_learns_from_labels(spark, docs, no_docs, labels):
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, prose(i, 60) + (f" grubble{i % 7} " + prose(i, 5) if bad else "")))
        marks.append((i, 1, int(bad)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(made, marked).collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 250
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert all(e.toxic == 1 for r in held if r.predicted for e in r.evidence)
    assert toxicity.drop_toxic(made, marked).count() == sum(not r.predicted for r in got)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(no_docs, labels).count() == 0
    nothing = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in nothing)


def test_toxicity_neighbours_are_those_of_whole_texts(spark):
    """Every word of every text counts, also words that no example holds; nobody's label has a part in it."""
    texts = {i: prose(i, 5 + i % 40) + f" only{i} " * (i % 3) + (" Grubble" if i % 4 == 0 else "") for i in range(240)} | {900: None, 901: "", 902: "zzz", 903: "! ?"}
    made = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(made, marked, toxicity.Limits(block=8))
    words = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in texts.items()}
    df = Counter(w for c in words.values() for w in c)
    examples = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 0]
    known = {w for i in examples for w in words[i]}

    def vector(i):
        v = {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + (df[w] if w in known else 0))) + 1) for w, n in words[i].items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(i) for i in examples}
    for i in texts:
        v = vector(i)
        sims = {e: sum(x * vectors[e].get(w, 0.0) for w, x in v.items()) for e in examples}
        want = sorted((e for e in examples if sims[e] > 0), key=lambda e: (-round(sims[e], 12), e))[:10]
        at, got = model.index.nearest(*model.counts(texts[i])[:1], 10, model.counts(texts[i])[1])
        assert model.index.ids[at].tolist() == want and np.allclose(got, [sims[e] for e in want])
        assert bool(want) == bool(known & words[i].keys())


def test_rates_meet_targets(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet([0.3, 0.3, 0.3], 500)
    n = r.integers(1, 1000, 500)
    frame = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(500)], "doc_id long, n_tokens long, p_x double, p_y double, p_z double")
    rows = mixing.fit_rates(frame, {"x": 7, "y": 2, "z": 1}).collect()
    rate = np.array([x.rate for x in sorted(rows, key=lambda x: x.doc_id)])
    assert rate.min() >= 0 and (rate == 0).any()
    assert np.abs((rate * n) @ p / n.sum() - [0.7, 0.2, 0.1]).max() < 1e-5


def test_unmet_targets_are_approached(spark):
    frame = spark.createDataFrame([(1, 10, 1.0, 0.0), (2, 10, 1.0, 0.0)], "doc_id long, n_tokens long, p_x double, p_y double")
    assert all(abs(r.rate - 0.5) < 1e-6 for r in mixing.fit_rates(frame, {"x": 1, "y": 1}).collect())


def test_mixing_of_documents(docs, no_docs, labels):
    weights = {"good": 0.9, "low": 0.1}
    rows = mixing.mix(docs, labels, mixing.by_quality(), weights).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    assert mixing.mixed_documents(docs, labels, mixing.by_quality(), weights).columns == docs.columns
    assert mixing.mix(no_docs, labels, mixing.by_quality(), weights).count() == 0
    assert mixing.mix(docs, labels.limit(0), mixing.by_quality(), weights).count() == docs.count()


CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>, level string"


def test_tool_calls(spark):
    ok = '{"limit": 2, "query": "é"}'
    calls = [
        (1, 5, "c", "lookup", ok, ["b", "a", "nowhere", None], "x"), (1, 3, "b", "lookup", ok, ["a", "a"], "x"), (1, 7, "a", "lookup", ok, None, "x"),
        (1, 9, "a", "lookup", ok, ["c"], "x"), (1, 1, "p", "rewrite", '{"text": "t"}', ["q"], "x"), (1, 1, "q", "rewrite", None, ["p"], "x"),
        (1, 2, "r", "rewrite", '{"text": 1, "style": "loud"}', [], "x"), (1, 2, "s", "other", "{}", [], "x"), (1, 2, "t", "lookup", "{", [], "x"),
        (2, 1, "a", "lookup", '{"query": "", "limit": 99, "z": 1}', [], "x"), (None, 1, "a", "lookup", ok, [], "x"), (1, 1, None, "lookup", ok, [], "x"),
    ]
    results = [(1, "a", "r2"), (1, "a", "r1"), (1, "b", None), (3, "a", "r"), (None, "a", "r")]
    frame, found = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, call_id string, result string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(frame, found, tool_calls.SCHEMAS).collect()}
    level = {k: r.level for k, r in got.items()}
    assert level == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "p"): None, (1, "q"): None, (1, "r"): 0, (1, "s"): 0, (1, "t"): 0, (2, "a"): 0}
    assert {k: r.status for k, r in got.items()} == {
        (1, "a"): "ok", (1, "b"): "ok", (1, "c"): "no_result", (1, "p"): "cycle", (1, "q"): "cycle", (1, "r"): "invalid", (1, "s"): "invalid", (1, "t"): "invalid", (2, "a"): "invalid",
    }
    assert got[1, "a"].json == '{"arguments":{"limit":2,"query":"é"},"depends_on":[],"id":"a","result":"r1","tool":"lookup"}'
    assert got[2, "a"].problems == "$.query: too short; $.limit: above 40; $: unknown z"
    assert tool_calls.link(frame.limit(0), found, tool_calls.SCHEMAS).count() == 0


DEEP = "[" * 200_000


@pytest.mark.parametrize(("text", "json", "problems"), [
    (DEEP + "]" * 200_000, None, "$: nested too deep"), (DEEP, None, "$: nested too deep"), ('{"a":' * 3000 + "1" + "}" * 3000, None, None), ('{"text": "\\ud800"}', '{"text":"\\ud800"}', ""),
    ('{"\\ud800": 1}', '{"\\ud800":1}', ""), ('{"n": NaN}', None, "$: not JSON"), ('{"n": 1e400}', None, "$: not JSON"), ('{"n": -Infinity}', None, "$: not JSON"),
    ('{"n": 1.0, "m": 2.50, "k": 1e3, "z": -0.0}', '{"k":1000,"m":2.5,"n":1,"z":0}', ""), ('{"a": 1, "a": 2}', '{"a":2}', "$: repeated key a"), ('{"x": "' + "y" * 2_000_000 + '"}', None, ""),
])
def test_odd_arguments_neither_crash_nor_stay_uncanonical(spark, text, json, problems):
    calls = spark.createDataFrame([(1, 1, "c", "any", text, [])], "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>")
    row = tool_calls.link(calls, spark.createDataFrame([], "conv_id long, call_id string, result string"), {"any": {}}).first()
    assert problems is None or (row.problems or "") == problems
    assert json is None or row.json == '{"arguments":' + json + ',"depends_on":[],"id":"c","tool":"any"}'
    assert row.json.startswith('{"arguments":') and row.status == ("invalid" if row.problems else "no_result")


def test_levels_of_a_chain_are_one_table(spark):
    calls = [(1, k, f"c{k}", "any", "{}", [f"c{k - 1}"] if k else []) for k in range(25)]
    frame = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, depends_on array<string>")
    levels = tool_calls.ordered(frame)
    assert {r.call_id: r.level for r in levels.collect()} == {f"c{k}": k for k in range(25)}
    assert levels._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


@pytest.mark.parametrize("part_rows", [1000, 125, 40])
def test_recall_at_production_settings(spark, part_rows):
    """Whatever the number of parts that the rows call for; clustered and uniform vectors."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 32))
    x = np.vstack([centres[r.integers(0, 12, 1200)] + 0.6 * r.normal(size=(1200, 32)), r.normal(size=(400, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute_neighbours(rows, 5)
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, neighbours.Settings(part_rows=part_rows))
    got = {(n.query_id, n.vec_id) for n in found.collect()}
    assert len(got & {(q, i) for q, near in want.items() for i, _ in near}) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize(("value", "schema", "wrong"), [
    (1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), (None, {"type": ["null", "string"]}, 0), ([1, "a"], {"items": {"type": "number"}}, 1),
    ({"a": {}}, {"properties": {"a": {"required": ["b"]}}}, 1), ("ab", {"maxLength": 1}, 1), (5, {"enum": [1, 2]}, 1), ([], {"minItems": 1}, 1),
])
def test_schemas(value, schema, wrong):
    assert len(tool_calls.violations(value, schema)) == wrong


def test_rates_equal_a_plain_solver(spark):
    """Nearest to 1 in the squares of tokens' rates, nonnegative, with the wanted totals: plain dual ascent in numpy."""
    r = np.random.default_rng(9)
    p = r.dirichlet([0.4, 0.3, 0.2], 500)
    tokens = r.integers(1, 400, 500)
    want = {"good": 0.75, "low": 0.2, "toxic": 0.05}
    rows = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(tokens, p))], "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double")
    got = np.array([x.rate for x in mixing.fit_rates(rows, want).orderBy("doc_id").collect()])
    w, at = tokens / tokens.sum(), np.zeros(3)
    for _ in range(200_000):
        at += 0.5 * ((w * np.maximum(0, 1 - p @ at)) @ p - np.array(list(want.values())))
    assert np.abs(got - np.maximum(0, 1 - p @ at)).max() < 1e-4 and (got >= 0).all() and (got == 0).any()
    assert np.abs((w * got) @ p - np.array(list(want.values()))).max() < 1e-6


def test_calibrated_posteriors_fit_their_labels():
    r = np.random.default_rng(10)
    y = np.eye(3)[r.integers(0, 3, 20_000)]
    x = y @ r.normal(size=(3, 4)) * 2 + r.normal(size=(20_000, 4))
    line = mixing.logistic(x, y, np.full(20_000, 1 / 20_000))
    z = x @ line[:, :-1].T + line[:, -1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for k in range(3):
        for lo, hi in ((0, 0.2), (0.4, 0.6), (0.8, 1)):
            some = (p[:, k] >= lo) & (p[:, k] <= hi)
            assert some.sum() < 300 or abs(p[some, k].mean() - y[some, k].mean()) < 0.06
