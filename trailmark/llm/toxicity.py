"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import crc_mod, save, whole_text

LABELLED = 8_000  # labelled rows a model is fitted on at most, the first by hash of doc_id
UNLABELLED = 8_000  # further documents the label model sees without labels, at most
UNITS = 128
PREFIXES = range(4, 9)
DENSE = 1 / 150  # share of words from which a unit is a pattern of the text and no accident
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def letters(text: str | None) -> str:
    """Runs of letters between single marks: A-Z lower-cased, any other ASCII a blank; bytes as characters."""
    return " " + (text or "").encode().translate(_CLEAN).decode("latin-1") + " "


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(letters(text).split(" ")) - {""}
            units = {f" {w} " for w in words} | {" " + w[:k] for w in words for k in PREFIXES if len(w) > k}
            yield pa.RecordBatch.from_arrays(
                [pa.array([u.encode("latin-1") for u in units], pa.binary()), pa.array([toxic] * len(units), pa.int64())],
                ["unit", "toxic"],
            )


def _automaton(units: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, u in enumerate(units):
        found.add_word(u, i)
    if units:
        found.make_automaton()
    return found


def count_units(texts: list[str | None], units: list[str], automaton) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit occurs in each text, and the number of words."""
    counts, words = np.zeros((len(texts), len(units)), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        clean = letters(text)
        words[i] = len(clean.split())
        if units:
            hits = [j for _, j in automaton.iter(clean)]
            if hits:
                counts[i] = np.bincount(hits, minlength=len(units))
    return counts, words


def features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(words, 1)[:, None]
    total = share.sum(axis=1, keepdims=True)
    return np.hstack([
        np.minimum(counts, 3) / 3, np.minimum(share / DENSE, 2), np.minimum(total / DENSE, 8),
        np.minimum((counts > 0).sum(axis=1, keepdims=True), 8) / 2, np.ones((len(counts), 1)),
    ])


def voters(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Two votes per unit: it occurs; it is dense."""
    return np.hstack([counts > 0, (counts / np.maximum(words, 1)[:, None] >= DENSE) & (counts > 0)]).astype(float)


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row by expectation maximisation over conditionally dependent voters.

    ``known``: 1, 0, or nan without a label; known labels start the model and count as 98 % sure. Each voter has a
    rate per label. Voters that agree beyond what the label explains share their weight: a voter's log odds are
    divided by its summed correlation with all voters given the label.
    """
    sure = np.where(known == 1, 0.98, 0.02)
    has = ~np.isnan(known)
    post = np.where(has, sure, np.nanmean(known) if has.any() else 0.5)
    shared = np.ones(votes.shape[1])
    for i in range(rounds):
        used = has if i == 0 and has.any() else np.ones(len(post), bool)
        p, v = post[used], votes[used]
        n1, n0 = p.sum(), (1 - p).sum()
        r1, r0 = (p @ v + 0.1) / (n1 + 1), ((1 - p) @ v + 0.1) / (n0 + 1)
        if i % 5 == 0 and len(v) > 2:
            rest = v - np.outer(p, r1) - np.outer(1 - p, r0)
            norm = np.sqrt((rest**2).sum(axis=0)) + 1e-6
            shared = np.maximum(1, np.abs(rest.T @ rest / np.outer(norm, norm)).sum(axis=0) ** 0.5)
        on, off = np.log(r1 / r0) / shared, np.log((1 - r1) / (1 - r0)) / shared
        odds = np.log(n1 / n0) + votes @ on + (1 - votes) @ off
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        post = np.where(has, np.clip(0.5 * post + 0.5 * sure, 0.01, 0.99), post)
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    units: list[str]
    weights: np.ndarray
    posterior_share: float


def _sample(docs: DataFrame, keys: DataFrame | None, size: int) -> DataFrame:
    """At most ``size`` rows in hash order of their id; the ids are few enough to broadcast."""
    order = F.xxhash64(F.lit(7), "doc_id")
    ids = (docs if keys is None else keys).where("doc_id is not null").orderBy(order, "doc_id").limit(size)
    return docs.join(F.broadcast(ids if keys is not None else ids.select("doc_id").distinct()), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> ToxicityModel:
    """Voters from labelled rows in ``train``, label model, classifier. Only ``train`` rows' labels are read."""
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    keys = labels.where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    labelled = save(_sample(rows, keys, LABELLED))
    stats = labelled.mapInArrow(_units, "unit binary, toxic long").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    sizes = labelled.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, n1 = sizes[0], sizes[1] or 0
    ratio = (F.col("hits") + 0.5) * (n - n1 + 1) / ((F.col("n") - F.col("hits") + 0.5) * (n1 + 1))
    best = stats.where((F.col("n") >= 3) & (ratio > 3)).orderBy(F.desc(F.col("hits") * F.log(ratio)), "unit").limit(UNITS)
    units = [bytes(r["unit"]).decode("latin-1") for r in best.select("unit").collect()]
    further = _sample(rows, None, UNLABELLED).join(labelled.select("doc_id"), "doc_id", "left_anti")
    both = labelled.unionByName(further.withColumn("toxic", F.lit(None).cast("long")))
    seen = both.mapInArrow(partial(_count, units=units), "doc_id long, toxic long, counts array<long>, words long").toPandas()
    seen = seen.sort_values("doc_id")
    if not len(seen):
        return ToxicityModel(units, features(np.zeros((1, len(units)), int), np.zeros(1, int))[0] * 0, 0.0)
    counts, words = np.stack(seen["counts"].to_numpy()).reshape(len(seen), -1), seen["words"].to_numpy()
    known = seen["toxic"].to_numpy(float)
    post = label_model(voters(counts, words), known)
    return ToxicityModel(units, fit_linear(features(counts, words), post), float(post.mean()))


def _count(batches: Iterator[pa.RecordBatch], units: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(units)
    for batch in batches:
        counts, words = count_units(batch.column("text").to_pylist(), units, automaton)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(list(counts), pa.list_(pa.int64())), pa.array(words)],
            ["doc_id", "toxic", "counts", "words"],
        )


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(model.units)
    for batch in batches:
        counts, words = count_units(batch.column("text").to_pylist(), model.units, automaton)
        odds = np.clip(features(counts, words) @ model.weights, -30, 30) if len(counts) else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) for each row; only the text counts.

    Null and empty texts get the score of a text without any unit. Repeated rows and null ids are scored as they
    come; an empty table gives no rows; other columns are ignored. Without labelled rows every score is 0.5.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, score double")


def op8_toxicity(spark, sf_dir):
    from trailmark.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted")
    )
