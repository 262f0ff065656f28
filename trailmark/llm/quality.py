"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import bytestext as bt
from trailmark.llm.common import save, whole_text
from trailmark.operators.skew import _nth_value, small_side

BROADCAST_IDS = 1_000_000  # ids of labelled documents that may be broadcast; beyond, the texts are shuffled to them
BUCKETS = 1 << 13
PRIOR = 0.02  # weight of the raw model in the target model
LOSS = 0.001  # share of the target documents that the cut may lose
_CLASS = np.full(256, 2, np.uint8)  # 0 blank, 1 letters and digits, 2 other marks
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token and of every pair of neighbours, and the row of each.

    Tokens are runs of letters and digits, and runs of other marks, A-Z lower-cased. All pairs of equal tokens share
    one bucket: saying a word twice is one event, whichever word it is.
    """
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    starts = np.flatnonzero(change[:-1] & (kind > 0))
    ends = np.flatnonzero(change[1:] & (kind > 0)) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    h = bt.word_hashes(bt.lower(data), starts, ends)
    pair = bt.mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[h[:-1] == h[1:]] = np.uint64(0x1234567)
    inside = row[1:] == row[:-1]
    both = np.concatenate([h, pair[inside]])
    return (both % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][inside]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for first, end, data, offsets in bt.parts(batch.column("text")):
            bucket, row = ngram_buckets(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[first:end][row]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weights(batches: Iterator[pa.RecordBatch], raw: np.ndarray, target: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Log weights; a target document is judged by the model without its own n-grams, like any other document."""
    share = np.log(raw / raw.sum())
    ratio = np.log(target / target.sum()) - share
    for batch in batches:
        sums = np.zeros(batch.num_rows)
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for first, end, data, offsets in bt.parts(batch.column("text")):
            bucket, row = ngram_buckets(data, offsets)
            sums[first:end] = np.bincount(row, ratio[bucket], minlength=end - first)
            own = good[first:end]
            if own.any():
                mine = own[row]
                pair, times = np.unique(row[mine] * BUCKETS + bucket[mine], return_counts=True)
                r, b = pair // BUCKETS, pair % BUCKETS
                size = np.bincount(row, minlength=end - first)
                left = np.log((target[b] - times) / (target.sum() - size[r])) - share[b]
                sums[first:end][own] = np.bincount(r, times * left, minlength=end - first)[own]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), batch.column("good"), pa.array(sums)],
            ["doc_id", "text_hash", "good", "log_weight"],
        )


def _nth_key(keys: DataFrame, n: int) -> float:
    """The ``n``-th smallest ``key`` of ``n`` rows or more, by counting ranges; no row is ordered or collected."""
    placed = keys.select("key", F.floor(F.col("key") * (1 << 20)).cast("long").alias("_at"))
    at, before, _ = _nth_value(placed, "_at", n)
    if at is None:
        return placed.agg(F.max("key").alias("key")).first()["key"]
    for key, count in sorted((r["key"], r["count"]) for r in placed.where(F.col("_at") == at).groupBy("key").count().collect()):
        before += count
        if before >= n:
            break
    return key


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, text_hash, log_weight, key, kept for each row of ``docs``.

    log_weight is the log ratio of the text's n-grams under the target model (all documents labelled quality 1) and
    the raw model (all documents). key adds Gumbel noise, drawn from a hash of id and text, so that the ``k`` largest
    keys are a sample without replacement by importance; rows whose key equals the k-th largest stay with it. Without
    a given k it is as large as needed to keep all but ``LOSS`` of the target documents, and without labelled
    documents everything is kept.

    Null and empty texts have log_weight 0. Equal rows get equal keys; null ids draw noise from their text alone; a
    label given twice counts as good if one of them is. Empty tables give empty results; other columns are ignored.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    ids = save(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    marked = rows.join(small_side(ids.withColumn("good", F.lit(True)), BROADCAST_IDS), "doc_id", "left")
    marked = marked.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.coalesce("good", F.lit(False)).alias("good"))
    sums = marked.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = sums.toPandas()
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] += found["target"]
    target += raw / raw.sum() * max(1.0, PRIOR * target.sum())  # n-grams new to the target model keep some of their raw share
    weighed = marked.mapInArrow(partial(_weights, raw=raw, target=target), "doc_id long, text_hash long, good boolean, log_weight double")
    noise = (F.pmod(F.xxhash64(F.lit(66), "doc_id", "text_hash"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keyed = save(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(noise))))
    ranked = keyed.where("good") if k is None else keyed
    total = ranked.count()
    nth = int(total * LOSS) + 1 if k is None else total - k + 1  # by the smallest key
    least = float("-inf") if nth < 1 or not total else float("inf") if nth > total else _nth_key(ranked, nth)
    return keyed.select("doc_id", "text_hash", "log_weight", "key", (F.col("key") >= least).alias("kept"))


def op6_quality(spark, sf_dir):
    from trailmark.llm.common import table

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "key", "kept")
