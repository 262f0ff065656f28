"""Approximate nearest neighbours: balanced posting lists, replicated boundary vectors, centroid graph, ratio pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import partitions, save

LIST_ROWS = 500  # vectors per posting list the number of lists aims at
MAX_LISTS = 2048  # lists grow beyond LIST_ROWS from here on; blocks keep tasks small
SAMPLE_BYTES = 32 << 20  # of vectors that fit the centroids, 16 or more per list
COPIES = 4  # lists a vector is put in at most
BOUNDARY = 1.10  # a vector also goes to lists whose centroid is at most so many times as far as the nearest
DEGREE = 16  # links of a centroid in the graph
STEP = 8  # centroids of a query whose links are followed at once
NEAR = 1e-6  # distances below count alike: a query may lie on a centroid
TUNING = 256  # queries that set the pruning ratio, measured against all vectors
RECALL = 0.97  # of the tuning queries' true neighbours that the ratio, and the walk with it, must reach
ROUNDING = 1e-9  # more than a product of unit vectors differs from the exact cosine
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, v (doubles as bytes) of rows with usable vectors."""
    for batch in batches:
        ids, vectors = [], []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if i is None or not x.is_valid or x.values is None or x.values.null_count or not len(x.values):
                continue
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(v).all() and 0 < np.linalg.norm(v) < np.inf:
                ids.append(i)
                vectors.append(v.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(v) // 8 for v in vectors], pa.int64()), pa.array(vectors, pa.binary())],
            ["vec_id", "dim", "v"],
        )


def _matrix(column, dim: int) -> np.ndarray:
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class CentroidGraph:
    """Centroids and links between near ones, walked best-first for many queries at once.

    A walk begins at centroids spread over all of them, because a near group need not be linked with the others, and
    goes on until ``beam`` centroids are seen and none that is still open is near enough. A beam of all centroids sees
    all of them.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        far = self._far(centroids, centroids)
        near = np.argsort(far, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        ring = (np.arange(len(centroids)) + 1) % len(centroids)  # one more link each keeps the graph connected
        self.links = np.hstack([near, ring[:, None]]) if len(centroids) > 1 else np.zeros((1, 1), int)
        entries, gap = [0], far[0].copy()  # each as far as possible from those before
        while len(entries) < min(len(centroids), 4 * math.isqrt(len(centroids))):
            entries.append(int(gap.argmax()))
            gap = np.minimum(gap, far[entries[-1]])
        self.entries = np.unique(entries)

    @staticmethod
    def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T))

    @classmethod
    def ratios(cls, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many times as far as the nearest centroid each one is."""
        far = cls._far(x, c) + NEAR
        return far / far.min(axis=1, keepdims=True)

    def search(self, queries: np.ndarray, ratio: float, least: int, beam: int) -> np.ndarray:
        """Mask of the lists whose centroid is at most ``ratio`` times as far as the nearest found, ``least`` at any rate."""
        n, k = len(queries), len(self.centroids)
        least, beam, step = min(least, k), min(max(beam, 2 * least), k), min(STEP, k)
        far = np.full((n, k), np.inf)
        far[:, self.entries] = self._far(queries, self.centroids[self.entries]) + NEAR
        todo = np.isfinite(far)
        live = np.arange(n)
        while len(live):
            open_ = np.where(todo[live], far[live], np.inf)
            at = np.argpartition(open_, step - 1, axis=1)[:, :step]
            best = far[live].min(axis=1, keepdims=True)
            seen = np.isfinite(far[live]).sum(axis=1, keepdims=True)
            ahead = np.take_along_axis(open_, at, 1)
            go = np.isfinite(ahead) & ((ahead <= ratio * best) | (seen < beam))
            r, c = np.nonzero(go)
            if not len(r):
                break
            row, at = live[r], at[r, c]
            todo[row, at] = False
            row, new = np.repeat(row, self.links.shape[1]), self.links[at].ravel()
            pair = np.unique((row * k + new)[~np.isfinite(far[row, new])])
            row, new = pair // k, pair % k
            far[row, new] = np.linalg.norm(self.centroids[new] - queries[row], axis=1) + NEAR
            todo[row, new] = True
            live = live[go.any(axis=1)]
        kth = np.partition(far, least - 1, axis=1)[:, least - 1]
        return (far <= ratio * far.min(axis=1, keepdims=True)) | (far <= kth[:, None])


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means in which full clusters look farther away, so that lists come out alike in size."""
    rng = np.random.default_rng(0)
    centroids = sample[rng.permutation(len(sample))[:k]]
    load = np.ones(k)
    for _ in range(rounds):
        far = CentroidGraph._far(sample, centroids)
        own = (far * (1 + 0.05 * np.log(load / load.mean() + 1e-3).clip(-1, 1))).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        load = np.bincount(own, minlength=k).astype(float)
        centroids = np.where(load[:, None] > 0, sums / np.maximum(load, 1)[:, None], centroids)
        load = np.maximum(load, 0.5)
    return centroids


def lists_of(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Mask of the lists each unit vector is put in."""
    far = CentroidGraph._far(vectors, centroids)
    copies = min(COPIES, far.shape[1])
    kth = np.partition(far, copies - 1, axis=1)[:, copies - 1]
    return (far <= BOUNDARY * far.min(axis=1, keepdims=True)) & (far <= kth[:, None])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, at = np.nonzero(lists_of(_unit(_matrix(batch.column("v"), dim)), centroids))
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("ids").take(row), batch.column("v").take(row)], ["list", "ids", "v"])


def _probe(batches: Iterator[pa.RecordBatch], graph: CentroidGraph, dim: int, ratio: float, least: int, beam: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            row, at = np.nonzero(graph.search(_unit(_matrix(part.column("v"), dim)), ratio, least, beam))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(at), part.column("vec_id").take(row), part.column("v").take(row)], ["list", "query_id", "v"])


def _best(q_ids: np.ndarray, q: np.ndarray, ids: list, v: np.ndarray, k: int) -> list[tuple]:
    """The k nearest ids of one block for each query, each with its best row: (query_id, vec_id, score)."""
    near = _unit(q) @ _unit(v).T
    q_norm, v_norm = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    out = []
    for i, query in enumerate(q_ids):
        found, take = {}, k + 1
        while len(found) < k:  # more vectors where rows of one vec_id or the query's own take places
            take = min(take, len(v))
            least = np.partition(near[i], len(v) - take)[len(v) - take]
            top = np.flatnonzero(near[i] >= least - ROUNDING)
            exact = (q[i] * v[top]).sum(axis=1) / (q_norm[i] * v_norm[top])  # alike in every block
            found = {}
            for s, j in zip(exact.tolist(), top):
                for x in ids[j]:
                    if x != query:
                        found[x] = max(s, found.get(x, -2.0))
            if take == len(v):
                break
            take *= 2
        best = sorted((-s, x) for x, s in found.items())
        out += [(int(query), x, -s) for s, x in best[:k]]
    return out


def _search(queries: pd.DataFrame, vectors: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    found = []
    if len(queries) and len(vectors):
        v = _matrix(vectors["v"], dim)
        for a in range(0, len(queries), 256):
            part = queries.iloc[a : a + 256]
            found += _best(part["query_id"].to_numpy(), _matrix(part["v"], dim), list(vectors["ids"]), v, k)
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def _truth(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, centroids: np.ndarray, graph: CentroidGraph, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The true neighbours in each batch, with the ratio at which one of their lists is searched, and these lists."""
    far = CentroidGraph.ratios(_unit(queries), graph.centroids)
    for batch in batches:
        v = _matrix(batch.column("v"), dim)
        near = _unit(queries) @ _unit(v).T
        near[ids[:, None] == batch.column("vec_id").to_numpy()[None, :]] = -2
        take = min(k, len(v))
        if not take:
            continue
        top = np.argpartition(-near, take - 1, axis=1)[:, :take]
        inside = lists_of(_unit(v), centroids)
        q = np.repeat(np.arange(len(ids)), take)
        t = top.ravel()
        need = np.where(inside[t], far[q], np.inf).min(axis=1)
        lists = [np.flatnonzero(x) for x in inside[t]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(near[q, t]), pa.array(need), pa.array(lists, pa.list_(pa.int64()))], ["q", "score", "need", "lists"]
        )


def reached_beam(graph: CentroidGraph, queries: np.ndarray, ratio: float, least: int, q: np.ndarray, lists: list) -> int:
    """The smallest beam, doubled from ``least``, whose walk meets a list of as many neighbours as ``ratio`` promises."""
    beam = 2 * least
    while beam < len(graph.centroids):
        mask = graph.search(queries, ratio, least, beam)
        if np.mean([mask[i, own].any() for i, own in zip(q, lists)]) >= RECALL:
            break
        beam *= 2
    return min(beam, len(graph.centroids))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine found for each row with vec_id divisible by ``every``.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
    vec_id and vectors of another length than most. Equal vectors are searched once and stand for their k + 1
    smallest ids, which is all that can be among k nearest. Rows of one vec_id are one candidate, and one query: the
    row whose vector comes first in the order of its bytes asks. Fewer rows than
    k give all of them; an empty table gives no rows; other columns are ignored.

    Centroids come from a bounded sample; every vector is indexed. The pruning ratio and the beam of the walk over the
    graph are set so that queries from the query set, searched against all vectors, reach ``RECALL``. Lists are searched in blocks of bounded size.
    """
    rows = save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_clean, "vec_id long, dim long, v binary"))
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = common["dim"], common["count"]
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v")
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    distinct = save(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))

    lists = int(min(MAX_LISTS, max(1, total // LIST_ROWS), max(1, SAMPLE_BYTES // (dim * 8 * 16))))
    sample = distinct.select("v").orderBy(F.xxhash64(F.lit(3), "v"), "v").limit(min(16 * lists, 1 << 15) if lists > 1 else 16).toPandas()
    sample = _unit(_matrix(sample["v"], dim))
    lists = min(lists, len(sample))
    centroids = balanced_centroids(sample, lists)
    graph = CentroidGraph(centroids)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    some = queries.orderBy(F.xxhash64(F.lit(33), "vec_id"), "vec_id").limit(TUNING).toPandas()
    ratio, least, beam = 1.0, 4, lists
    if len(some) and lists > 1:
        found = rows.mapInArrow(
            partial(_truth, ids=some["vec_id"].to_numpy(), queries=_matrix(some["v"], dim), centroids=centroids, graph=graph, dim=dim, k=k),
            "q long, score double, need double, lists array<long>",
        )
        true = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k)
        true = true.select("q", "need", "lists").toPandas()  # TUNING * k rows at most
        need = np.sort(true["need"].to_numpy())
        if len(need):
            ratio = float(need[min(len(need) - 1, int(len(need) * RECALL))]) + 1e-9
            beam = reached_beam(graph, _unit(_matrix(some["v"], dim)), ratio, least, true["q"].to_numpy(), list(true["lists"]))

    posted = save(distinct.mapInArrow(partial(_assign, centroids=centroids, dim=dim), "list long, ids array<long>, v binary"))
    probed = save(queries.mapInArrow(partial(_probe, graph=graph, dim=dim, ratio=ratio, least=least, beam=beam), "list long, query_id long, v binary"))
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("nv")).join(probed.groupBy("list").agg(F.count(F.lit(1)).alias("nq")), "list")
    sizes = sizes.select("list", F.ceil(F.col("nv") / BLOCK_VECTORS).alias("vs"), F.ceil(F.col("nq") / BLOCK_QUERIES).alias("qs"))

    def to(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = probed.join(sizes, "list").withColumn("qb", F.pmod(F.xxhash64("query_id"), "qs")).withColumn("vb", to("vs"))
    right = posted.join(sizes, "list").withColumn("vb", F.pmod(F.xxhash64("v"), "vs")).withColumn("qb", to("qs"))
    n = partitions(vectors.sparkSession)
    left = left.select("list", "vb", "qb", "query_id", "v").repartition(n, "list", "vb", "qb").groupBy("list", "vb", "qb")
    right = right.select("list", "vb", "qb", "ids", "v").repartition(n, "list", "vb", "qb").groupBy("list", "vb", "qb")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _search(q, v, dim, k)

    hits = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark, sf_dir):
    from trailmark.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"))
