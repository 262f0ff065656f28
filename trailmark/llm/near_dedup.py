"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard check on full shingle sets, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import bytestext as bt
from trailmark.llm.common import partitions, save, whole_text
from trailmark.llm.components import components

BANDS, ROWS = 40, 5  # a pair at similarity 0.8 misses all bands once in 8 million
SLACK = 0.15  # five standard errors of a similarity estimated from BANDS * ROWS coordinates
BLOCK = 512  # rows of a bucket compared at once
PACK = 4096  # rows of small buckets given to a task's function at once
PAIRS = 1 << 15  # pairs whose signatures are compared at once
FEW = 1 << 16  # classes whose texts are found by a broadcast
WIDE = 4096  # sets up to this size are compared in their block, 16 KB each; wider ones by estimate, then by join


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, row = bt.words(data, offsets)
    hashes = bt.word_hashes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled += hashes[i : i + len(rolled)]
    rolled = bt.mix64(rolled)
    for first, end in zip(bounds[:-1], bounds[1:]):
        if end - first >= words:
            yield np.unique(rolled[first : end - words + 1])
        elif end > first:  # the whole short sequence, kept apart from full shingles by its length
            h = np.uint64(end - first)
            with np.errstate(over="ignore"):
                for x in hashes[first:end]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
            yield bt.mix64(np.array([h ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))
        else:
            yield np.empty(0, np.uint64)


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates of one set from two permutations of the 32-bit numbers.

    The first permutation is the shingle hash folded to 32 bits. The second is a one-to-one mixing function;
    coordinate k takes it circularly shifted by k, so no further permutation is needed.
    """
    first = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 1024):
        x = first[None, at : at + 1024] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    band_of = np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n", "hi", "lo", "bands", "small")}
        for _, _, data, offsets in bt.parts(batch.column("text")):
            for s in shingle_sets(bt.lower(data), offsets, words):
                out["n"].append(len(s))
                if not len(s):
                    for k in ("hi", "lo", "bands", "small"):
                        out[k].append(None)
                    continue
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                sig = circulant_signature(s, BANDS * ROWS)
                key = band_of.copy()
                for c in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
                    key = bt.mix64(key * np.uint64(0xD6E8FEB86659FD93) + c)
                out["hi"].append(int(digest[0]))
                out["lo"].append(int(digest[1]))
                out["bands"].append(key.view(np.int64))
                out["small"].append(sig.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("of"), pa.array(out["n"], pa.int64()), pa.array(out["hi"], pa.int64()),
             pa.array(out["lo"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64())), pa.array(out["small"], pa.binary())],
            ["doc_id", "of", "n_shingles", "hi", "lo", "bands", "small"],
        )


def _fold(shingles: np.ndarray, wide: int) -> bytes | None:
    """Distinct 32-bit foldings of a set; none for wide sets."""
    return np.unique((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)).tobytes() if len(shingles) <= wide else None


def _sets(batches: Iterator[pa.RecordBatch], words: int, fold: int | None) -> Iterator[pa.RecordBatch]:
    pack = np.ndarray.tobytes if fold is None else partial(_fold, wide=fold)
    for batch in batches:
        for first, end, data, offsets in bt.parts(batch.column("text")):
            sets = [pack(s) for s in shingle_sets(bt.lower(data), offsets, words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, end - first), pa.array(sets, pa.binary())], ["node", "shingles"]
            )


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            x, y = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_link(x: np.ndarray, others: list[np.ndarray], n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``sizes`` shingles can be similar enough, from their foldings ``x`` and ``others``.

    A common shingle is a common folding, and a set has lost as many foldings as its size exceeds theirs, so the
    count below is never under the true one.
    """
    widths = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(widths) - widths, dtype=np.int64) + np.minimum(n - len(x), sizes - widths)
    return 100 * both >= percent * (n + sizes - both)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes of each row agree; rows have a multiple of 8 bytes and less than 256, so eight sums fit into one number."""
    return (((x == y).view(np.uint64).sum(axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _across(rows: pd.DataFrame, percent: int, best: bool, limit: int) -> pd.DataFrame:
    """Pairs of two blocks of a bucket whose components differ and whose sizes, estimates and sets allow a link.

    ``rows`` hold one pair of blocks or several, of different buckets. A pair that meets in several buckets is given by
    the first of them. ``best``: only each row's likeliest partner.
    """
    rows = rows.sort_values(["key", "ci", "cj", "chunk"])
    key, ci, cj, chunk, n, comp, hi, lo = (rows[c].to_numpy() for c in ("key", "ci", "cj", "chunk", "n", "comp", "hi", "lo"))
    small = np.frombuffer(b"".join(rows["small"]), np.uint8).reshape(len(rows), -1)
    at, left = np.arange(len(rows)), chunk == ci
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])]))
    sizes = np.diff(np.append(first, len(rows)))
    # a row of the left block meets those of the right one; inside one block the rows behind it, or all for the best
    start = np.where(ci < cj, np.repeat(first + np.add.reduceat(left, first, dtype=np.int64), sizes), np.repeat(first, sizes) if best else at + 1)
    count = np.where(left, np.repeat(first + sizes, sizes) - start, 0)
    ends = np.cumsum(count)
    if not best:
        bands, wide = np.stack(rows["bands"].to_numpy()), n > limit
        sets = [None if s is None else np.frombuffer(s, np.uint32) for s in rows["folded"]]
    found, row = [], 0
    while row < len(rows):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] - count[row] + PAIRS, "right")))
        times = count[row:stop]
        i = np.repeat(at[row:stop], times)
        j = np.arange(len(i)) + np.repeat(start[row:stop] - np.cumsum(times) + times, times)
        row = stop
        may = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
        i, j = i[may], j[may]
        like = _alike(small[i], small[j])
        may = like / small.shape[1] >= percent / 100 - SLACK
        i, j, like = i[may], j[may], like[may]
        if best:
            order = np.lexsort((-like, i))
            i, j = i[order], j[order]
            may = np.diff(i, prepend=-1) > 0
        else:
            may = bands[i, (bands[i] == bands[j]).argmax(axis=1)] == key[i]
            i, j = i[may], j[may]
            may = wide[i] | wide[j]
            for k in np.unique(i[~may]):
                near = np.flatnonzero((i == k) & ~may)
                may[near] = _may_link(sets[k], [sets[x] for x in j[near]], n[k], n[j[near]], percent)
        i, j = i[may], j[may]
        found.append(np.stack([hi[i], lo[i], hi[j], lo[j]], axis=1))
    return pd.DataFrame(np.concatenate(found), columns=["ahi", "alo", "bhi", "blo"], dtype="int64")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, wide: int = WIDE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for each row of ``docs``.

    Words are runs of non-blanks with A-Z lower-cased. A document's set is its distinct shingles of ``words`` words;
    a shorter text is one shingle; null, empty and blank texts have none and are linked with nothing. Documents are
    linked where 100 * common >= ``percent`` * all shingles. component_id is the smallest doc_id reachable over links,
    kept marks the documents that carry it. Repeated rows share their component; rows of one doc_id with other texts
    are documents of their own, and all rows of a component's smallest doc_id are kept. A null doc_id counts only
    where a component has no other. Empty tables give empty results; other columns are ignored.

    Equal sets are one class from the start, so copies make no pairs. Within a bucket of a band every class is first
    checked against the bucket's smallest class only. Where that leaves a bucket with several components, all pairs
    across components whose sizes and signatures allow a link are compared too, block by block on sets folded to 32
    bits, and those that can be links are confirmed on full sets: no link between different components is lost, and
    groups of near copies, above the limit or just below it, make no square of pairs. Sets are made only for classes
    that are compared.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text")).withColumn("of", F.xxhash64("text"))
    signed = save(rows.mapInArrow(
        partial(_sign, words=words),
        "doc_id long, of long, n_shingles long, hi long, lo long, bands array<long>, small binary",
    ))
    banded = signed.where("hi is not null").select(F.explode("bands").alias("key"), "hi", "lo")
    pivots = banded.groupBy("key").agg(
        F.min("hi").alias("phi"), F.min_by("lo", "hi").alias("plo"), F.max("hi").alias("top")
    )
    # equal classes meet in all bands: a bucket of one class has one hi
    pivots = save(pivots.where("phi <> top").select("key", "phi", "plo"))
    shared = save(banded.join(pivots, "key").select("key", "hi", "lo", "phi", "plo").distinct())
    pairs = save(_ordered(
        shared.where("hi <> phi or lo <> plo").select(F.struct("hi", "lo").alias("a"), F.struct(F.col("phi").alias("hi"), F.col("plo").alias("lo")).alias("b"))
    ))
    links = _verified(rows, signed, pairs, words, percent)
    found = components(links)

    tested = pairs
    for best in (True, False):  # likely partners first: they join most of what can be joined, so few pairs are left
        more = save(_left_over(rows, signed, shared, found, words, percent, best, wide).join(tested, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            tested = tested.unionByName(more)
            links = links.unionByName(_verified(rows, signed, more, words, percent))
            found = components(links)

    node = F.struct("hi", "lo")
    marked = signed.select("doc_id", "of", "n_shingles", F.when(F.col("hi").isNotNull(), node).alias("node"))
    joined = marked.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    first = joined.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    joined = joined.join(first, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.col("of").alias("text_hash"),
    )


def _left_over(
    rows: DataFrame, signed: DataFrame, shared: DataFrame, found: DataFrame, words: int, percent: int, best: bool, wide: int
) -> DataFrame:
    """Pairs to check between different components of a bucket."""
    comp = found.select(F.col("node").alias("c_node"), "component")
    node = F.struct("hi", "lo")
    placed = save(
        shared.join(comp, node == F.col("c_node"), "left")
        .select("key", "hi", "lo", F.xxhash64(F.coalesce("component", node)).alias("comp"))
    )
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("rows"))
    left = placed.join(mixed.where("c0 <> c1").select("key", F.ceil(F.col("rows") / BLOCK).alias("chunks")), "key")
    classes = left.select("hi", "lo").distinct()
    small = signed.join(classes, ["hi", "lo"]).dropDuplicates(["hi", "lo"])
    small = small.select("hi", "lo", "small", F.col("n_shingles").alias("n"), *([] if best else ["bands"]))
    if not best:
        sets = _sets_of(rows, signed, classes.select(node.alias("node")), words, fold=wide)
        small = small.join(sets.select("node.hi", "node.lo", F.col("shingles").alias("folded")), ["hi", "lo"])
    left = left.join(small, ["hi", "lo"])
    left = left.withColumn("chunk", F.pmod("lo", "chunks"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    left = left.select(
        "key", *small.columns, "comp", "chunk", "chunks",
        F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"),
    )
    # most buckets are a few rows, so those of one block share a call; ``placed`` is counted from its files' footers
    packs = F.lit(1 + placed.count() // PACK).cast("long")
    pack = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("key"), packs)).otherwise(F.xxhash64("key", "ci", "cj"))
    left = left.withColumn("pack", pack).drop("chunks")

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        return _across(rows, percent, best, wide)

    found = left.repartition(partitions(left.sparkSession), "pack").groupBy("pack")
    pairs = found.applyInPandas(across, "ahi long, alo long, bhi long, blo long")
    a = F.struct(F.col("ahi").alias("hi"), F.col("alo").alias("lo"))
    return _ordered(pairs.select(a.alias("a"), F.struct(F.col("bhi").alias("hi"), F.col("blo").alias("lo")).alias("b")))


def _sets_of(rows: DataFrame, signed: DataFrame, nodes: DataFrame, words: int, fold: int | None = None) -> DataFrame:
    """The shingle sets of the classes in ``nodes``, folded up to that size if ``fold`` is given."""
    text_of = signed.where("hi is not null").select(F.struct("hi", "lo").alias("node"), "of").join(nodes, "node")
    text_of = save(text_of.groupBy("node").agg(F.min("of").alias("of")))
    if text_of.count() <= FEW:
        text_of = F.broadcast(text_of)
    texts = rows.join(text_of, "of").groupBy("node").agg(F.first("text").alias("text"))
    return save(texts.mapInArrow(partial(_sets, words=words, fold=fold), "node struct<hi:long,lo:long>, shingles binary"))


def _verified(rows: DataFrame, signed: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    sets = _sets_of(rows, signed, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    ready = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return save(ready.mapInArrow(partial(_similar, percent=percent), pairs.schema))


def op4_near_dedup(spark, sf_dir):
    from trailmark.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4
           THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM worded
), classes AS (
  SELECT s, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT c, len(s) AS n, unnest(s) AS item FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.item = b.item AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT c, c AS r FROM classes
  UNION
  SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.r
), comps AS (
  SELECT c, min(r) AS component FROM reach GROUP BY c
)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id,
       doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN comps USING (c)
"""
