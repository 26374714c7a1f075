"""Soft-membership mixing: document rates whose expected domain totals match targets.

A classifier learnt from the labelled table and calibrated on rows it has not seen gives
each document a posterior over domains. Projected-gradient least squares then moves
nonnegative rates, all 1 at first, as little as it takes for the expected tokens of each
domain to match. A step is two aggregates of a few numbers; a rate is a function of its
document's posterior and one multiplier for each domain. Built-in functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut, free_name, small

#: the classifier is learnt from so many labelled rows of each domain and keeps so many terms
SAMPLE_ROWS, TERMS = 2000, 512
#: terms beyond so many count for less: words of a text aren't independent witnesses
WITNESSES = 12
STEPS, CLOSE = 40, 1e-7
#: one of so many of the sampled rows calibrates the classifier, if there are that many
HELD, CALIBRATING = 4, 40
SYMBOLS = "#*$%&|<>"


def by_quality_and_toxicity() -> Column:
    """Domain of a labelled row: toxic, low or good."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def by_quality() -> Column:
    """Domain of a labelled row: low or good."""
    return F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def _level(x: Column, name: str, bounds: list[float]) -> Column:
    level = F.lit(f"{name}:0")
    for k, b in enumerate(bounds, 1):
        level = F.when(x > b, F.lit(f"{name}:{k}")).otherwise(level)
    return level


#: what separates tokens: white space and the punctuation of sentences
SPLIT = "[\\x20\\x09-\\x0D.,;:!?]+"


def _seen(docs: DataFrame, *keep: str) -> DataFrame:
    """n_tokens of the whole text, its tokens (lower case), and a few terms for its shape."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    rows = rows.select(*keep, "text", F.array_remove(F.split(F.lower("text"), SPLIT), "").alias("tokens"), F.split("text", "\n").alias("lines"))
    rows = rows.select(*keep, "text", "tokens", F.size("tokens").alias("n"), F.size(F.array_distinct("tokens")).alias("n_distinct"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_distinct_lines"))
    n = F.greatest("n", F.lit(1))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    shape = F.array(
        _level(symbols / n, " symbols", [0.02, 0.2, 1.0]),
        _level(1 - F.col("n_distinct_lines") / F.col("n_lines"), " lines", [0.05, 0.3]),
        _level(1 - F.col("n_distinct") / n, " tokens", [0.3, 0.5, 0.7, 0.85]),
        _level(n.cast("double"), " size", [4.0, 9.0, 50.0, 400.0, 3000.0]),
    )
    return rows.select(*keep, F.col("n").cast("long").alias("n_tokens"), "tokens", shape.alias("shape"))


class Classifier:
    """Naive Bayes over the presence of chosen terms, and a calibration of its sums. Bounded by ``TERMS`` and the domains.

    Two numbers for each domain say what a text holds for it: the sum of its terms' log
    probabilities, and the strongest single term, by how far it speaks for that domain
    rather than any other. A posterior is the softmax of linear functions of these.
    """

    def __init__(self, domains: list[str], prior: dict[str, float], weights: list[tuple]):
        self.domains, self.prior, self.weights = domains, prior, weights
        k = len(domains)
        #: as it stands before calibration: the log prior and the sum of a domain's own
        self.linear = np.hstack([np.eye(k), np.zeros((k, k)), np.log([[prior[d]] for d in domains])])

    def features(self, docs: DataFrame, *keep: str) -> DataFrame:
        """``keep``, n_tokens, s_<domain> (sums) and m_<domain> (strongest terms) of every row."""
        spark = docs.sparkSession
        chosen = F.array(*[F.lit(t) for t, *_ in self.weights]) if self.weights else F.array().cast("array<string>")
        seen = _seen(docs, *keep)
        row = free_name(seen, "row")
        seen = seen.select(*keep, "n_tokens", F.concat(F.array_intersect("tokens", chosen), F.array_intersect("shape", chosen)).alias("terms"), F.monotonically_increasing_id().alias(row))
        rest = lambda w, i: max((x for j, x in enumerate(w) if j != i), default=0.0)
        rows = [(t, *w, *[x - rest(w, i) for i, x in enumerate(w)]) for t, *w in self.weights]
        weights = spark.createDataFrame(rows, "term string, " + ", ".join(f"{c}_{d} double" for c in "wv" for d in self.domains))
        terms = seen.select(*keep, "n_tokens", row, F.explode_outer("terms").alias("term"))
        found = terms.join(F.broadcast(weights), "term", "left").groupBy(*keep, "n_tokens", row)  # TERMS rows
        sums = found.agg(
            F.count("term").alias("hits"), *[F.coalesce(F.sum(f"w_{d}"), F.lit(0.0)).alias(f"s_{d}") for d in self.domains],
            *[F.greatest(F.coalesce(F.max(f"v_{d}"), F.lit(0.0)), F.lit(0.0)).alias(f"m_{d}") for d in self.domains],
        )
        share = F.least(F.lit(1.0), WITNESSES / F.greatest("hits", F.lit(1)))
        return sums.select(*keep, "n_tokens", *[(share * F.col(f"s_{d}")).alias(f"s_{d}") for d in self.domains], *[f"m_{d}" for d in self.domains])

    def posteriors(self, docs: DataFrame, *keep: str) -> DataFrame:
        """``keep``, n_tokens and p_<domain> of every row."""
        found = [F.col(f"{c}_{d}") for c in "sm" for d in self.domains]
        logs = {d: sum((float(a) * x for a, x in zip(line[:-1], found, strict=True)), F.lit(float(line[-1]))) for d, line in zip(self.domains, self.linear, strict=True)}
        rows = self.features(docs, *keep).select(*keep, "n_tokens", *[z.alias(f"z_{d}") for d, z in logs.items()])
        top = F.greatest(*[f"z_{d}" for d in self.domains]) if len(logs) > 1 else F.col(f"z_{self.domains[0]}")
        parts = rows.select(*keep, "n_tokens", *[F.exp(F.col(f"z_{d}") - top).alias(f"p_{d}") for d in self.domains])
        total = sum((F.col(f"p_{d}") for d in self.domains[1:]), F.col(f"p_{self.domains[0]}"))
        return parts.select(*keep, "n_tokens", *[(F.col(f"p_{d}") / total).alias(f"p_{d}") for d in self.domains])

    def calibrate(self, held: DataFrame) -> None:
        """Fits the linear functions to labelled rows that were not learnt from, each domain
        weighted by its share of all labels: at most ``SAMPLE_ROWS / HELD`` rows of a domain,
        a few numbers each. Too few leave them as they are."""
        names = [f"{c}_{d}" for c in "sm" for d in self.domains]
        rows = self.features(held, "doc_id", "domain").select("domain", *names).collect()
        counts = {d: sum(r["domain"] == d for r in rows) for d in self.domains}
        if len(rows) < CALIBRATING or min(counts.values()) < 5:
            return
        x = np.array([[r[n] for n in names] for r in rows])
        y = np.array([[float(r["domain"] == d) for d in self.domains] for r in rows])
        weight = np.array([self.prior[r["domain"]] / counts[r["domain"]] for r in rows])
        self.linear = logistic(x, y, weight / weight.sum())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Rows (one for each class) of the linear functions whose softmax fits y; the last entry is the constant.

    Accelerated gradient steps of a safe length on standardised columns, with a ridge.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    length = 2.0 / (np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 2 * ridge)
    a, ahead = np.zeros((y.shape[1], z.shape[1])), np.zeros((y.shape[1], z.shape[1]))
    for step in range(steps):
        logits = z @ ahead.T
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        after = ahead - length * (((p - y) * weight[:, None]).T @ z + ridge * ahead)
        a, ahead = after, after + step / (step + 3) * (after - a)
    line = a[:, :-1] / scale
    return np.hstack([line, a[:, -1:] - (line @ mean)[:, None]])


def learn(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str]) -> Classifier:
    """A classifier from a bounded sample of the labelled table: the rows of each domain
    with the smallest hash of doc_id. Shares of domains are counted over all labels. One
    of ``HELD`` sampled rows is not learnt from and calibrates the posteriors."""
    labelled = labels.where("doc_id is not null").select("doc_id", domain.alias("domain")).where(F.col("domain").isin(domains))
    labelled = labelled.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = {d: (counts.get(d, 0) + 1) / (sum(counts.values()) + len(domains)) for d in domains}
    picked = [labelled.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for d in domains]
    ids = picked[0]
    for more in picked[1:]:
        ids = ids.union(more)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(cut(ids, "labelled")), "doc_id")
    sample = cut(sample.groupBy("doc_id", "domain").agg(F.min("text").alias("text")), "sample")
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD)) == 0
    whole, sample = sample, sample.where(~held)
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    terms = _seen(sample, "doc_id", "domain").select("domain", F.explode(F.array_union("tokens", "shape")).alias("term"))
    table = terms.groupBy("term").agg(*[F.count_if(F.col("domain") == d).cast("double").alias(f"n_{d}") for d in domains])
    n = sum((F.col(f"n_{d}") for d in domains[1:]), F.col(f"n_{domains[0]}"))
    all_rows = sum(sizes.values())
    share = {d: (F.col(f"n_{d}") + 0.5) / (sizes.get(d, 0) + 1) for d in domains}
    g = sum((F.col(f"n_{d}") * F.log(share[d] * (all_rows + 1) / (n + 0.5)) for d in domains[1:]), F.col(f"n_{domains[0]}") * F.log(share[domains[0]] * (all_rows + 1) / (n + 0.5)))
    best = table.where(n >= 3).select("term", g.alias("g"), *[F.log(share[d]).alias(d) for d in domains]).where("g > 3")
    chosen = best.orderBy(F.desc("g"), "term").limit(TERMS).collect()
    model = Classifier(domains, prior, [(r["term"], *[r[d] for d in domains]) for r in chosen])
    model.calibrate(whole.where(held))
    return model


#: shares of a step that are tried at once
TRIES = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def fit_rates(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows (n_tokens, p_<domain>, ...) with ``rate``.

    Of all nonnegative rates that give every domain its share of the tokens, those nearest
    to 1 in the squares of tokens' rates. They are 1 less a combination of the row's
    posteriors, projected on what is not negative, so a step moves one multiplier for each
    domain along the scaled gradient, by the largest of ``TRIES`` that lowers the
    objective, and reads a few sums. Targets that no rates meet are approached.
    """
    domains = list(weights)
    p = [F.col(f"p_{d}") for d in domains]
    target = np.array([weights[d] / sum(weights.values()) for d in domains])
    k = len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    tokens = F.col("n_tokens")
    total = rows.agg(F.sum(tokens).cast("double").alias("n")).first()["n"] or 0.0

    def rate(at: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((float(m) * x for m, x in zip(at[1:], p[1:], strict=True)), float(at[0]) * p[0]))

    def objectives(places: list[np.ndarray]) -> np.ndarray:
        got = rows.agg(*[F.sum(tokens * rate(x) * rate(x)).alias(f"o{i}") for i, x in enumerate(places)]).first()
        return np.array([got[f"o{i}"] / total / 2 + x @ target for i, x in enumerate(places)])

    at = np.zeros(k)
    lowest = np.inf
    for _ in range(STEPS if total else 0):
        here = rate(at)
        free = F.when(here > 0, tokens).otherwise(0)
        got = rows.agg(*[F.sum(tokens * here * p[i]).alias(f"r_{i}") for i in range(k)], *[F.sum(free * p[i] * p[j]).alias(f"m_{i}_{j}") for i, j in pairs]).first()
        residual = np.array([got[f"r_{i}"] / total for i in range(k)]) - target
        if np.abs(residual).max() < CLOSE:
            break
        moments = np.zeros((k, k))
        for i, j in pairs:
            moments[i, j] = moments[j, i] = got[f"m_{i}_{j}"] / total
        move = np.linalg.pinv(moments, rcond=1e-12, hermitian=True) @ residual
        values = objectives([at + t * move for t in TRIES])
        best = int(np.argmin(values))
        if not values[best] < lowest - 1e-16:
            break
        at, lowest = at + TRIES[best] * move, values[best]
    return rows.withColumn("rate", rate(at))


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies for a rate: its expectation over keys is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every row.

    Empty and null texts have no tokens; they get the rate of their posterior, which
    moves no total. Rows that are equal get equal rates. Without labels all posteriors
    are alike and so are all rates. Other columns are not read.
    """
    domains = list(weights)
    model = learn(docs, labels, domain, domains)
    scored = cut(model.posteriors(docs.select("doc_id", "text", F.xxhash64("text").alias("version")), "doc_id", "version"), "posteriors")
    mixed = fit_rates(scored, weights).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("version")))
    return mixed.select("doc_id", "version", "n_tokens", *[f"p_{d}" for d in domains], "rate", "copies")


def mixed_documents(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float]) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns.

    Only numbers are joined back; they are broadcast while their files are small.
    """
    rates = mix(docs, labels, domain, weights).select("doc_id", "version", "copies").distinct()
    doc, version, times, one = (free_name(docs, f"_mix_{x}") for x in ("doc", "version", "times", "one"))
    rates = small(cut(rates.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("copies").alias(times)), "copies"))
    joined = docs.join(rates, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(version)))
    many = joined.where(F.col(times) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])
