"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

``fit`` takes a bounded sample of labelled rows (``Limits``): half of its folds become
examples, the other half calibrates. Everything else covers all documents: document
frequencies are counted over the whole corpus, every whole text is scored.

Terms are lower-case words. The index holds every word of every example, and norms cover
whole texts: a word that no example holds weighs like one that no document holds. So the
neighbours are those of the whole texts; labels have no part in finding them. They enter
with the votes: a neighbour votes with the part of its similarity that comes from words
which tell the labels apart (by G statistic, graded, of the word or a beginning of it, as
insults take endings), and the votes are calibrated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut, slices

WORD = re.compile(r"[^\W_]+")
#: lengths of beginnings of words that may tell the labels apart
ROOTS = range(3, 8)
NEIGHBOURS = 200
EVIDENCE = 3
REJECT = 0.7
#: what the rest of a similarity adds to a vote, and the weight of the prior
PLAIN_VOTE, PRIOR_VOTE = 0.01, 0.3
#: texts beyond so many characters are read word by word instead of as one list
LONG_TEXT = 1 << 20
#: words and beginnings are counted in so many bytes of text at a time: there are many of them
TERM_BYTES = 1 << 20
#: texts whose products with the common terms come at once
QUERIES = 64


@dataclass(frozen=True)
class Limits:
    """Bounds of the sample that is learnt from, and what makes a word telling."""

    #: labelled rows of each label and role (example, calibration)
    rows: int = 2000
    #: a word tells half as much as it can at a G statistic of ``g`` and ``g_row`` for each
    #: example, since copies among them lift it; it must be ``lift`` times as frequent under one label
    lift: float = 2.0
    g: float = 12.0
    g_row: float = 0.0045
    #: examples in a block of the index
    block: int = 128


def fold(doc_id: Column) -> Column:
    """Three folds by checksum of the id; fold 1 is held out from all learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def _words(text: str | None) -> Iterable[str]:
    text = (text or "").lower()
    return WORD.findall(text) if len(text) < LONG_TEXT else (m.group() for m in WORD.finditer(text))


def words_in(text: str | None) -> Counter:
    """The words of a whole text and how often each occurs."""
    return Counter(_words(text))


def terms_of(text: str | None) -> set[str]:
    """Distinct words of a text, and their beginnings (``root*``)."""
    words = set(words_in(text))
    return words | {w[:n] + "*" for w in words for n in ROOTS if len(w) > n}


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, ``length`` numbers each, one after the other."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


class Index:
    """Examples as lists of term weights, in blocks with each term's largest weight.

    Terms that a share of ``COMMON`` of all examples hold are an array, whose products with
    many queries come at once. The k-th best of them bounds the k-th score from below. All
    other terms have sparse lists: an entry is a term in a block, with its largest weight
    there, and points to its weights. A block's bound is its best product so far and the
    query's product with those maxima; only blocks that reach the k-th score are read. So
    the result is the exact k nearest, ties to the smaller id.
    """

    COMMON = 1 / 16

    def __init__(self, vectors: Iterable[dict[int, int]], ids: list[int], toxic: list[int], idf: np.ndarray, block: int, unseen: float = 0.0):
        self.idf, self.block = np.append(idf, unseen), block
        rows = [self.weights(v) for v in vectors]
        # a block's maxima are low if its texts have one language, so share their commonest
        # words (those of the smallest weights), and are of about one length
        common = [int(t[np.argmin(idf[t])]) if len(t) else -1 for t, _ in rows]
        order = sorted((k for k in range(len(rows)) if len(rows[k][0])), key=lambda k: (common[k], len(rows[k][0]), ids[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.toxic = np.array([toxic[k] for k in order], float)
        self.blocks = -(-len(order) // block)
        term = np.concatenate([rows[k][0] for k in order] or [np.empty(0, np.int64)]).astype(np.int32)
        place = np.repeat(np.arange(len(order), dtype=np.int32), [len(rows[k][0]) for k in order])
        by_term = np.argsort(term, kind="stable")
        term, self.place = term[by_term], place[by_term].astype(np.intp)
        self.weight = np.concatenate([rows[k][1] for k in order] or [np.empty(0)])[by_term]
        where = self.place // block
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (where[1:] != where[:-1])
        self.entry = np.flatnonzero(new)
        self.entry_length = np.diff(np.append(self.entry, len(term))).astype(np.int32)
        self.entry_block = where[self.entry]
        self.maxima = np.maximum.reduceat(self.weight, self.entry) if len(term) else np.empty(0)
        self.entries = np.searchsorted(term[self.entry], np.arange(len(idf) + 1))
        common = np.flatnonzero(np.bincount(term, minlength=len(idf)) > len(order) * self.COMMON)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.dense, held = np.zeros((len(common), self.blocks * block)), self.row[term] >= 0
        self.dense[self.row[term[held]], self.place[held]] = self.weight[held]

    def normed(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their normed weights: (1 + ln count) * idf. Words without a number are -1 and count in the norm."""
        w = (1 + np.log(counts)) * self.idf[terms]
        known = terms >= 0
        return terms[known], w[known] / (np.sqrt((w * w).sum()) or 1.0)

    def weights(self, counts: dict[int, int], others: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The same from term numbers with their counts, and the counts of words without a number."""
        others = [*others]
        return self.normed(np.array([*counts] + [-1] * len(others), np.int64), np.array([*counts.values()] + others, float))

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS, others: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest examples, of those that share a term."""
        return next(self.find([self.weights(counts, others)], np.zeros(len(self.idf)), k))[:2]

    def find(self, queries: list[tuple[np.ndarray, np.ndarray]], telling: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each query: places and similarities of its k nearest examples, and the part of each that ``telling`` has of its terms."""
        common = np.zeros((len(queries), len(self.dense)))
        for line, (terms, w) in zip(common, queries, strict=True):
            rows = self.row[terms]
            line[rows[rows >= 0]] = w[rows >= 0]
        size = len(self.ids)
        for total, (terms, w) in zip(common @ self.dense, queries, strict=True):
            sims, rare = total[:size], self.row[terms] < 0
            least = np.partition(sims, -k)[-k] if size > k else 0.0
            entry, weight = self._entries(terms[rare], w[rare])
            where = self.entry_block[entry]
            bounds = total.reshape(self.blocks, self.block).max(axis=1, initial=0.0) + np.bincount(where, weight * self.maxima[entry], self.blocks)
            read = bounds >= least - 1e-9
            sims += self._summed(entry[read[where]], weight[read[where]])
            at = np.flatnonzero(sims > 0)
            if len(at) > k:
                at = at[sims[at] >= np.partition(sims, -k)[-k] - 1e-9]
            # equal sums in another order differ by rounding; rounded they tie
            at = at[np.lexsort((self.ids[at], -np.round(sims[at], 12)))[:k]]
            told = telling[terms] > 0
            yield at, sims[at], self._summed(*self._entries(terms[told], (w * telling[terms])[told]))[at]

    def _entries(self, terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms' entries, and each one's weight in the query."""
        length = self.entries[terms + 1] - self.entries[terms]
        return _spread(self.entries[terms], length), np.repeat(w, length)

    def _summed(self, entry: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Products with the entries, by example."""
        length = self.entry_length[entry]
        at = _spread(self.entry[entry], length)
        return np.bincount(self.place[at], np.repeat(weight, length) * self.weight[at], len(self.ids))


class Model:
    """Vocabulary, index, how much each term tells, and calibration. All of it is bounded by ``Limits``."""

    def __init__(self, vocabulary: dict[str, int], index: Index, telling: np.ndarray, prior: float):
        self.vocabulary, self.index, self.telling, self.prior = vocabulary, index, telling, prior
        self.raw_at, self.score_at = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def counts(self, text: str | None) -> tuple[dict[int, int], list[int]]:
        """Term numbers with their counts, and the counts of all other words."""
        known, others = {}, []
        for w, n in words_in(text).items():
            k = self.vocabulary.get(w)
            if k is None:
                others.append(n)
            else:
                known[k] = n
        return known, others

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text with their weights, normed over the whole text."""
        seen = words_in(text)
        numbers = np.fromiter(map(self.vocabulary.get, seen, repeat(-1)), np.int64, len(seen))
        return self.index.normed(numbers, np.fromiter(seen.values(), float, len(seen)))

    def raw(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
        """Of each text: votes of its nearest examples with the prior as one weak vote, and the examples that voted with most weight."""
        for start in range(0, len(texts), QUERIES):
            for at, sims, told in self.index.find([self.vector(t) for t in texts[start : start + QUERIES]], self.telling, NEIGHBOURS):
                votes, toxic = told + PLAIN_VOTE * sims, self.index.toxic[at]
                vote = (float((votes * toxic).sum()) + PRIOR_VOTE * self.prior) / (float(votes.sum()) + PRIOR_VOTE)
                first = np.argsort(-np.round(votes, 12), kind="stable")[:EVIDENCE]
                yield vote, list(zip(self.index.ids[at[first]].tolist(), sims[first].tolist(), toxic[first].astype(int).tolist(), strict=True))

    def calibrate(self, raws: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Monotone fit of label frequency on votes (pool adjacent violators)."""
        order = np.argsort(raws, kind="stable")
        pools: list[list[float]] = []  # weight, weight of toxic ones, sum of votes
        for r, y, w in zip(raws[order], toxic[order], weight[order], strict=True):
            pools.append([w, w * y, w * r])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.raw_at = np.array([p[2] / p[0] for p in pools])
            self.score_at = np.array([p[1] / p[0] for p in pools])

    def score(self, raw: float) -> float:
        """Calibrated score; a hundredth of the vote keeps the order within flat pieces."""
        return float(min(1.0, max(0.0, 0.99 * np.interp(raw, self.raw_at, self.score_at) + 0.01 * raw)))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the number of toxic and other texts that hold them, summed by slice."""
    for batch in slices(batches, most=TERM_BYTES):
        seen = (Counter(), Counter())
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[toxic].update(terms_of(text))
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string())] + [pa.array([float(seen[y][t]) for t in terms], pa.float64()) for y in (1, 0)], names=["term", "a", "b"]
        )


def _sample(docs: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """(doc_id, toxic, role, text) of the labelled rows to learn from, written.

    Of each label and fold 0 (examples) or 2 (calibration), the rows with the smallest
    hash of doc_id. A doc_id labelled more than once counts as toxic if one label says
    so; of several texts under one doc_id the smallest is taken.
    """
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("role", fold(F.col("doc_id"))).where("role != 1 and toxic in (0, 1)")
    picked = [
        rows.where((F.col("role") == role) & (F.col("toxic") == toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.rows)
        for role in (0, 2) for toxic in (0, 1)
    ]
    ids = cut(picked[0].union(picked[1]).union(picked[2]).union(picked[3]), "labelled")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # 4 * limits.rows ids
    return cut(texts.groupBy("doc_id", "toxic", "role").agg(F.min("text").alias("text")), "sample")


def _counted(vocabulary: Broadcast) -> Callable:
    """Partial document frequencies, one row per term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        df = np.zeros(len(number) + 1, np.int64)  # the last counts words without a number
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                words = set(_words(text))
                df[np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))] += 1  # numbers are distinct
        df = df[:-1]
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], names=["term", "n"])

    return run


def _telling(sample: DataFrame, n0: int, n1: int, limits: Limits) -> DataFrame:
    """(term, telling) for every word of the examples: 0 to 1, the most of the word and its beginnings."""
    seen = sample.where("role = 0").mapInArrow(_term_rows, "term string, a double, b double").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate1, rate0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    both = (F.col("a") + F.col("b")) / (n0 + n1)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * both))).otherwise(0.0)
    g = 2 * (part(F.col("a"), n1) + part(F.col("b"), n0) + part(n1 - F.col("a"), n1 * (1 - both) / both) + part(n0 - F.col("b"), n0 * (1 - both) / both))
    lift = F.greatest(rate1 / rate0, rate0 / rate1)
    r = F.pow(F.greatest(g, F.lit(0.0)) / (limits.g + limits.g_row * (n0 + n1)), 4)
    rated = seen.select("term", F.when(lift >= limits.lift, r / (1 + r)).otherwise(0.0).alias("telling"))
    word = F.col("term")
    roots = F.array(word, *(F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in ROOTS))
    words = rated.where(~word.endswith("*")).select(word.alias("word"), F.explode(roots).alias("term"))
    return words.join(rated, "term").groupBy(F.col("word").alias("term")).agg(F.max("telling").alias("telling"))


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """Learns from labels outside fold 1. Without examples of both labels every score is near their frequency."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, limits)
    sizes = {(r["role"], r["toxic"]): r["n"] for r in sample.groupBy("role", "toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get((0, 0), 0), sizes.get((0, 1), 0)
    # what reaches the driver from here on is the examples' words, 2 * limits.rows texts
    rated = _telling(sample, n0, n1, limits).toArrow().sort_by("term") if n0 and n1 else None
    vocabulary = {w: k for k, w in enumerate(rated["term"].to_pylist())} if rated else {}
    telling = rated["telling"].to_numpy() if rated else np.empty(0)

    numbers = spark.sparkContext.broadcast(vocabulary)
    found = docs.select("text").mapInArrow(_counted(numbers), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary))
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    total = docs.count()
    idf = np.log((1 + total) / (1 + df)) + 1

    population = {r["toxic"]: r["n"] for r in labels.where((fold(F.col("doc_id")) != 1) & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = population.get(1, 0) / max(1, sum(population.values()))
    rows = sample.where("role = 0").mapInArrow(_features(numbers), "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    vectors = (dict(zip(t.as_py(), n.as_py(), strict=True)) for t, n in zip(rows["terms"], rows["counts"], strict=True))
    index = Index(vectors, rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), idf, limits.block, float(np.log(1 + total) + 1))
    numbers.unpersist()
    model = Model(vocabulary, index, telling, prior)

    voted = F.col("v").getField("score")
    voters = spark.sparkContext.broadcast(model)
    held = sample.where("role = 2").select("toxic", _verdict(voters, calibrated=False)(F.col("text")).alias("v"))
    held = held.select("toxic", voted.alias("raw")).toArrow()  # 2 * limits.rows pairs of numbers
    voters.unpersist()
    raw, toxic = held["raw"].to_numpy(), held["toxic"].to_numpy().astype(float)
    share = {y: population.get(y, 0) / max(1, int((toxic == y).sum())) for y in (0, 1)}
    model.calibrate(raw, toxic, np.array([share[int(y)] for y in toxic]))
    if not len(raw):
        model.score_at = np.array([prior, prior])
    return model


def _features(vocabulary: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in slices(batches):
            counts = [{number[w]: n for w, n in words_in(t.as_py()).items() if w in number} for t in batch.column("text")]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in counts], kind), pa.array([list(c.values()) for c in counts], kind)],
                names=["doc_id", "toxic", "terms", "counts"],
            )

    return run


VERDICT = "struct<score: double, evidence: array<struct<doc_id: bigint, similarity: double, toxic: int>>>"


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column that gives score and evidence, for use in any projection."""
    return _verdict(spark.sparkContext.broadcast(model), calibrated=True)  # bounded by Limits: the words of 4,000 examples


def _verdict(held: Broadcast, calibrated: bool) -> Callable[[Column], Column]:
    @F.arrow_udf(VERDICT)
    def verdict(texts: pa.Array) -> pa.Array:
        m, scores, evidence = held.value, [], []
        for batch in slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
            every = batch.column("text").to_pylist()
            once = list(dict.fromkeys(every))
            found = {}
            for text, (raw, shown) in zip(once, m.raw(once), strict=True):
                found[text] = m.score(raw) if calibrated else raw, [{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in shown]
            scores += [found[t][0] for t in every]
            evidence += [found[t][1] for t in every]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["score", "evidence"])

    return verdict


def score_documents(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row.

    Empty and null texts, and texts that share no word with an example, get what the
    calibration rows of that kind got. Evidence are the examples whose votes weigh most. Rows without doc_id are scored, never learnt
    from. Equal texts get equal scores. An empty table gives no rows. No other columns
    are read.
    """
    verdict = scorer(docs.sparkSession, fit(docs, labels, limits))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), verdict(F.col("text")).alias("v"))
    return scored.select("doc_id", "held_out", F.col("v.score").alias("score"), (F.col("v.score") >= REJECT).cast("int").alias("predicted"), F.col("v.evidence").alias("evidence"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows whose score is below ``REJECT``, with all their columns. Nothing is joined or moved.

    Rows without text or doc_id are judged like all others; equal texts go or stay together.
    """
    verdict = scorer(docs.sparkSession, fit(docs, labels, limits))
    return docs.where(verdict(F.col("text")).getField("score") < REJECT)
