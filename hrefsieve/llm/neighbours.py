"""Nearest neighbours through learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size that keep
neighbours together; a small classifier learns which part holds a vector's neighbours.
Every vector is filed under its most probable part; a query is sent to its most probable
parts and what they hold is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut, runs, small


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit and of the search."""

    #: vectors that the parts are learnt on, and neighbours of each in the graph
    sample: int = 8000
    links: int = 10
    #: parts are doubled until one holds fewer than ``part_rows`` rows, at most so many
    part_rows: int = 125
    parts: int = 256
    #: a query visits parts until their probabilities add up to this
    mass: float = 0.93
    #: rows of a part, and queries, that meet in one piece of work
    block: int = 4096
    queries: int = 1024
    epochs: int = 25


def neighbour_graph(x: np.ndarray, links: int) -> np.ndarray:
    """The nearest other rows of each row, by cosine of unit vectors."""
    links = min(links, len(x) - 1)
    out = np.empty((len(x), links), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, links - 1, axis=1)[:, :links] if links else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the graph.

    Halved again and again along the direction of widest spread, then refined: a row
    moves to the part of most of its neighbours while that part has room.
    """
    label = np.zeros(len(x), np.int64)
    while label.max() + 1 < parts:
        half = np.zeros(len(x), np.int64)
        for part in range(label.max() + 1):
            rows = np.flatnonzero(label == part)
            y = x[rows] - x[rows].mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ axis, kind="stable")
            half[rows[order[len(rows) // 2 :]]] = 1
        label = 2 * label + half
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    sizes = np.bincount(label, minlength=parts)
    back = [[] for _ in range(len(x))]
    for i, near in enumerate(graph):
        for j in near:
            back[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(label[np.concatenate([graph[i], np.array(back[i], np.int64)])], minlength=parts)
            own, votes[sizes >= room] = votes[label[i]], 0
            best = int(votes.argmax())
            if votes[best] > own:
                sizes[label[i]] -= 1
                sizes[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Softmax over one hidden layer: probabilities of the parts for unit vectors."""

    def __init__(self, width: int, parts: int, hidden: int = 128, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w1, self.b1 = r.normal(0, 1 / np.sqrt(width), (width, hidden)) * 2, np.zeros(hidden)
        self.w2, self.b2 = r.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 6) -> None:
        """Adam on cross-entropy with the parts of a row's neighbours as targets."""
        r, at = np.random.default_rng(seed), 0
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                h, p = self._forward(x[rows])
                d = (p - y[rows]) / len(rows)
                dh = (d @ self.w2.T) * (h > 0)
                grads = [x[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
                at += 1
                for k, g in enumerate(grads):
                    g = g + 1e-4 * params[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= 0.003 * (m[k] / (1 - 0.9**at)) / (np.sqrt(v[k] / (1 - 0.999**at)) + 1e-8)


def learn_router(vectors: np.ndarray, parts: int, settings: Settings) -> Router:
    """Graph, parts and classifier of a sample of vectors."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    router = Router(x.shape[1], parts)
    if parts > 1:
        graph = neighbour_graph(x, settings.links)
        label = balanced_parts(x, graph, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
        target[np.arange(len(x)), label] += 2
        router.train(x, target / target.sum(axis=1, keepdims=True), settings.epochs)
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each vec_id.

    Left out are rows without id, vectors that are null, zero, or hold null or non-finite
    components, and vectors of another length than most. Of several vectors under one id
    the smallest counts.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite & F.exists(x, lambda v: v != 0))
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    width = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    return rows.where(F.size("embedding") == (width["width"] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filed(router) -> Callable:
    """Each vector with its most probable part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.value.probabilities(_unit(_matrix(batch.column("embedding")))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(part.astype(np.int32))], names=["vec_id", "embedding", "part"])

    return run


def _routed(router, sizes: np.ndarray, mass: float, least: int) -> Callable:
    """Each query with the parts it visits: enough probability, and enough rows to choose from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = min(least, int(sizes.sum()))
        for batch in batches:
            if not batch.num_rows:
                continue
            p = router.value.probabilities(_unit(_matrix(batch.column("embedding"))))
            order = np.argsort(-p, axis=1, kind="stable")
            enough = (np.cumsum(np.take_along_axis(p, order, 1), axis=1) >= mass) & (np.cumsum(sizes[order], axis=1) >= need)
            count = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, p.shape[1])
            parts = [[int(x) for x in row[:n] if sizes[x]] for row, n in zip(order, count, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(parts, pa.list_(pa.int32()))], names=["vec_id", "embedding", "parts"])

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of two tables, each row summed in the same order wherever it stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _ranked(k: int) -> Callable:
    """The k best rows of a piece for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part", "block", "chunk"]):
            ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("embedding"))
            asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            rows, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(rows) or not len(queries):
                continue
            rough = _unit(x[queries]) @ _unit(x[rows]).T
            rough[ids[queries][:, None] == ids[rows][None, :]] = -np.inf
            kth = np.partition(rough, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
            at, near = np.nonzero((rough >= kth[:, None] - 1e-9) & (rough > -2))
            exact = cosine(x[queries[at]], x[rows[near]])
            order = np.lexsort((ids[rows[near]], -exact, at))
            at, near, exact = at[order], near[order], exact[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[queries[at[keep]]]), pa.array(ids[rows[near[keep]]]), pa.array(exact[keep])], names=["query_id", "vec_id", "score"]
            )

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query.

    Every row is indexed. Of equal vectors only the k + 1 with the smallest ids are ever
    compared, since no other can be among the nearest; so copies make no part large. Parts
    and the queries that visit them meet block by block. A query visits more parts where
    those it is sent to hold too few rows. Rows that ``usable`` leaves out don't take part;
    with fewer than k others a query gets all of them, in an empty table none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).select("embedding").toArrow()  # settings.sample vectors
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy")
    count, parts = rows.count(), 1
    while parts < settings.parts and count / parts > settings.part_rows:
        parts *= 2
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = spark.sparkContext.broadcast(learn_router(_matrix(sample.column("embedding")), parts, settings))
    index = cut(distinct.mapInArrow(_filed(router), "vec_id long, embedding array<double>, part int"), "index")
    sizes = np.zeros(parts, np.int64)
    for r in index.groupBy("part").agg(F.count("*").alias("n")).collect():  # one row per part
        sizes[r["part"]] = r["n"]
    asked = rows.where(is_query).mapInArrow(_routed(router, sizes, settings.mass, 4 * (k + 1)), "vec_id long, embedding array<double>, parts array<int>")
    asked = cut(asked.select("vec_id", "embedding", F.explode("parts").alias("part")), "queries")
    counts = index.groupBy("part").agg(F.count("*").alias("rows")).join(asked.groupBy("part").agg(F.count("*").alias("asked")), "part")
    grid = small(cut(counts.select("part", F.ceil(F.col("rows") / settings.block).cast("int").alias("blocks"), F.ceil(F.col("asked") / settings.queries).cast("int").alias("chunks")), "grid"))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    filed = index.join(grid, "part").select("part", place("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), "vec_id", "embedding")
    sent = asked.join(grid, "part").select("part", every("blocks").alias("block"), place("chunks").alias("chunk"), F.lit(True).alias("asks"), "vec_id", "embedding")
    by = ["part", "block", "chunk"]
    found = filed.unionByName(sent).repartition(*by).sortWithinPartitions(*by).mapInArrow(_ranked(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
