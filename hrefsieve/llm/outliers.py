"""Robust multivariate outliers: minimum covariance determinant per language and source.

Built-in functions only. A text gives a few counts in one pass, without a shuffle; all
that follows reads those numbers. Estimates grow by concentration steps: the ``SHARE`` of
a group's rows nearest to the last estimate give the next one. A step is one aggregate by
group and distance bin, so it adds up on the map side whatever a group's size, and the
nearest share is read off the bins, of which a group has a bounded number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrefsieve.llm.tables import GAP, cut, small, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: share of a group that an estimate rests on, rows a group needs to have one of its own
SHARE, GROUP_ROWS = 0.75, 50
#: at most so many concentration steps; they end when no determinant moves
STEPS = 12
#: share of regular rows that a cut-off at this quantile would keep, were they normal
KEEP, REWEIGH = 0.99999, 0.975
#: the statistics, with a spread below which differences don't count (in their own unit)
STATISTICS = {"word_length": 0.08, "symbols": 0.25, "dup_lines": 0.25, "repeats": 0.15}
_X = list(STATISTICS)
_P = len(_X)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, some other columns, and the counts of each whole text.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word),
    n_dup_lines (those equal to an earlier one), n_repeat_words (words in windows of
    five words that the text holds twice or more). A null text has none of anything.
    """
    text = F.coalesce("text", F.lit(""))
    has_word = "[^\\x20\\x09-\\x0D]"
    rows = docs.select("doc_id", *keep, text.alias("text"))
    rows = rows.select(
        "doc_id", *keep, words_of(F.col("text")).alias("words"),
        F.length(F.translate("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(has_word)).alias("lines"),
    )
    rows = rows.select(
        "doc_id", *keep, F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    counts = ["doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.select(*counts, F.when(F.col("n_words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*counts, F.when(twice, placed).alias("placed"))
    same = lambda x, i, d: F.coalesce(F.get(F.col("placed"), i + d)["h"] == x["h"], F.lit(False))
    again = F.filter("placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    rows = rows.select(*counts, F.sort_array(F.transform(again, lambda x: x["i"])).alias("places"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.select(*counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _chi2_quantile(p: float, even_freedom: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, even_freedom) < p else (lo, mid)
    return lo


def _chi2(x: float, even_freedom: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even_freedom // 2))


def _consistency(share: float) -> float:
    """What a covariance of the nearest share is multiplied with to be that of normal rows."""
    return share / _chi2(_chi2_quantile(share, _P), _P + 2)


def _moments(weight: Column) -> list[Column]:
    sums = [F.sum(weight).alias("n")] + [F.sum(weight * F.col(x)).alias(f"s_{x}") for x in _X]
    return sums + [F.sum(weight * F.col(_X[i]) * F.col(_X[j])).alias(f"s_{i}_{j}") for i, j in _PAIRS]


def _estimates(sums: DataFrame, factor: float, keep: list[str]) -> DataFrame:
    """Centre, Cholesky factor and log determinant from sums; spreads have their floor added."""
    rows = sums.select(
        *keep, *[(F.col(f"s_{x}") / F.col("n")).alias(f"m_{x}") for x in _X], *[(F.col(f"s_{i}_{j}") / F.col("n")).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    )
    floors = list(STATISTICS.values())
    for i, j in _PAIRS:
        c = F.col(f"c_{i}_{j}") - F.col(f"m_{_X[i]}") * F.col(f"m_{_X[j]}")
        c = factor * (F.greatest(c, F.lit(0.0)) if i == j else c) + (floors[i] ** 2 if i == j else 0.0)
        for k in range(j):
            c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        # the floor keeps every pivot positive but for rounding
        rows = rows.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l_{j}_{j}"))
    log_det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, _P)), F.log(F.col("l_0_0")))
    return rows.withColumn("log_det", log_det).drop(*[f"c_{i}_{j}" for i, j in _PAIRS])


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(_X):
        d = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            d = d - F.col(f"l_{i}_{k}") * z[k]
        z.append(d / F.col(f"l_{i}_{i}"))
    return sum((d * d for d in z[1:]), z[0] * z[0])


def _grouped(rows: DataFrame) -> DataFrame:
    """Each language and source with the group whose estimate it uses.

    Its own, if it has rows enough; else that of its language, else that of all.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count_if(~base_failed()).alias("n"))
    by_lang = Window.partitionBy("lang")
    sizes = sizes.withColumn("n_lang", F.sum("n").over(by_lang))
    own = F.to_json(F.struct("lang", "source"))
    group = F.when(F.col("n") >= GROUP_ROWS, own).when(F.col("n_lang") >= GROUP_ROWS, F.to_json(F.struct("lang"))).otherwise(F.lit("{}"))
    return cut(sizes.select("lang", "source", group.alias("g")), "groups")


def score(docs: DataFrame) -> DataFrame:
    """The counts of every row, ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is the row's Mahalanobis distance from its group's estimate; rows that
    fail the base rules don't shape an estimate and have none. A row is kept if it passes
    the base rules and its distance is within the ``KEEP`` quantile. Missing languages or
    sources count as one value. Groups of under ``GROUP_ROWS`` rows use the estimate of
    their language or of all rows; if those are few as well, passing the base rules is
    enough. Equal statistics (ties at the share's bound) all take part. Nothing of an
    empty table is returned.
    """
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select("doc_id", "text", missing("lang"), missing("source"))
    counts = cut(base_counts(rows, "lang", "source"), "counts")
    rows = counts.join(small(_grouped(counts)), ["lang", "source"])
    means = rows.where(~base_failed()).groupBy("g").agg((F.sum("word_chars") / F.sum("n_words")).alias("usual"))
    words, lines = F.col("n_words"), F.col("n_lines")
    fine = rows.where(~base_failed()).join(small(cut(means, "means")), "g").select(
        # so many words of the usual length are added: short texts vary more
        "g", F.log((F.col("word_chars") + 50 * F.col("usual")) / (words + 50)).alias("word_length"),
        F.log1p(20 * F.col("n_symbols") / (words + 20)).alias("symbols"),
        F.log1p(5 * F.col("n_dup_lines") / (lines + 5)).alias("dup_lines"),
        F.log1p(5 * F.col("n_repeat_words") / (words + 50)).alias("repeats"),
        "doc_id", "lang", "source", *counts.columns[3:],
    )
    fine = cut(fine, "statistics")
    final = _concentrate(fine.select("g", *_X))
    known = fine.join(small(final), "g", "left").withColumn("distance", F.sqrt(_distance()))
    limit = math.sqrt(_chi2_quantile(KEEP, _P))
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    passed = known.select(*shown, F.lit(False).alias("base_failed"), F.coalesce(F.col("distance") <= limit, F.lit(True)).alias("kept"), "distance")
    failed = counts.where(base_failed()).select(*shown, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)


def _concentrate(x: DataFrame) -> DataFrame:
    """The estimate of the smallest determinant of each group, from three starts.

    Starts are weighted means and covariances of all rows: plain, and with weights that
    fall with a row's distance from the plain centre, once and squared.
    """
    zeros = _estimates(x.groupBy("g").agg(*_moments(F.lit(1.0))).where(F.col("n") >= GROUP_ROWS), 1.0, ["g"])
    plain = small(cut(zeros, "plain"))
    far = F.sqrt(sum(((F.col(v) - F.col(f"m_{v}")) ** 2 / F.col(f"l_{i}_{i}") ** 2 for i, v in enumerate(_X)), F.lit(0.01)))
    starts = x.join(plain, "g").select("g", *_X, F.posexplode(F.array(F.lit(1.0), 1 / far, 1 / far**2)).alias("start", "w"))
    now = small(cut(_estimates(starts.groupBy("g", "start").agg(*_moments(F.col("w"))), 1.0, ["g", "start"]), "starts"))
    by = Window.partitionBy("g", "start")
    last = None
    for _ in range(STEPS):
        near = x.join(now, "g").withColumn("bin", F.least(F.floor(32 * F.log2(1 + 16 * _distance())), F.lit(4000)))
        binned = near.groupBy("g", "start", "bin").agg(*_moments(F.lit(1.0)))
        binned = binned.withColumn("before", F.sum("n").over(by.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(by))
        taken = binned.where(F.col("before") < SHARE * F.col("all")).groupBy("g", "start")
        sums = taken.agg(*[F.sum(c).alias(c) for c in binned.columns[3:-2]])
        now = small(cut(_estimates(sums, 1.0, ["g", "start"]), "step"))
        total = now.agg(F.sum("log_det")).first()[0]
        if total is None or (last is not None and abs(total - last) < 1e-6):
            break
        last = total
    best = now.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("log_det", "start"))).where("place = 1")
    raw = _rescaled(best.drop("place", "start"), _consistency(SHARE))
    near = x.join(small(cut(raw, "raw")), "g").where(_distance() <= _chi2_quantile(REWEIGH, _P))
    return cut(_estimates(near.groupBy("g").agg(*_moments(F.lit(1.0))), _consistency(REWEIGH), ["g"]), "estimates")


def _rescaled(rows: DataFrame, factor: float) -> DataFrame:
    """Estimates with their covariance multiplied."""
    return rows.select("g", *[f"m_{x}" for x in _X], *[(F.col(f"l_{i}_{j}") * math.sqrt(factor)).alias(f"l_{i}_{j}") for i, j in _PAIRS])
