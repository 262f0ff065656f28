"""Packing documents into training sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import save, whole_text

CACHE_WORDS = 600_000  # words whose ids a worker keeps; only speed depends on it
ROWS_PER_RANGE = 20_000
_TAIL = ".,;:!?&$#%*|()[]\"-"  # neither letters, digits, blanks nor apostrophes: a token boundary before them is certain
# Latin letters that are their own composed form and have one lower-case letter each
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
# the character a byte-level model writes for each byte
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_BYTES = "".join(_HIDDEN.get(b, chr(b)) for b in range(256))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCache:
    """Token ids of blank-separated words. The tokenizer never joins across blanks, so texts are sums of their words."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def learn(self, words: set[str]) -> None:
        if len(self.cores) > CACHE_WORDS:
            self.cores.clear()
        if len(self.tails) > CACHE_WORDS:
            self.tails.clear()
        plain, known, cores, tails = [], self.words, self.cores, self.tails
        # lower-case Latin letters are their own normal form and one token boundary unit: the model alone is enough
        model = self.tokenizer.model.tokenize
        for w in words:
            core = w.rstrip(_TAIL)
            ascii_ = core.isascii()
            if not (core.isalpha() if ascii_ else _LATIN(core)):
                plain.append(w)
                continue
            low = core.lower()
            ids = cores.get(low)
            if ids is None:
                shown = low if ascii_ else charmap_decode(low.encode(), "strict", _BYTES)[0]
                ids = cores[low] = array("I", [t.id for t in model(shown)]).tobytes()
            if len(core) != len(w):
                tail = w[len(core):]
                if tail not in tails:
                    tails[tail] = self._encode([tail])[0]
                ids += tails[tail]
            known[w] = ids
        known.update(zip(plain, self._encode(plain)))

    def ids(self, texts: list[str], end: bytes) -> list[bytes]:
        # split() also cuts at four control characters that are no blanks to the tokenizer: such texts stay whole
        split = [[t] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        known = self.words
        missing = set(filterfalse(known.__contains__, chain.from_iterable(split)))
        if len(known) + len(missing) > CACHE_WORDS:  # the cache starts anew, with the words of these texts
            known = self.words = {w: known[w] for w in set(chain.from_iterable(split)).intersection(known)}
        if missing:
            self.learn(missing)
        get = known.__getitem__
        return [b"".join(map(get, s)) + end for s in split]


@lru_cache(maxsize=1)
def _cache(path: str) -> WordCache:
    """The words a worker knows, over all its tasks."""
    return WordCache(path)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache, end = _cache(path), np.array([end_id], np.uint32).tobytes()
    task, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first in range(0, len(texts), 256):
            ids = cache.ids(texts[first : first + 256], end)
            keys = np.arange(seen, seen + len(ids), dtype=np.int64) + (task << 40)
            seen += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("doc_id").slice(first, 256), pa.array(ids, pa.binary()),
                 pa.array([len(x) // 4 for x in ids], pa.int64())],
                ["key", "doc_id", "ids", "doc_tokens"],
            )


@dataclass
class PackPlan:
    """Where the pieces of each length go, by rank; one entry per step of the packing, not per piece."""

    step_key: np.ndarray  # length << 44 | first rank of the step, ascending
    step_rank: np.ndarray
    step_pack: np.ndarray
    step_offset: np.ndarray
    group_first: np.ndarray  # packs with the same content length, ascending
    group_base: np.ndarray
    group_used: np.ndarray
    group_cuts: list[list[int]]  # where packs of the group are cut into sequences


def plan_packs(histogram: dict[int, int], size: int, max_padding: int) -> PackPlan:
    """Place lengths longest first, always into the pack that is shortest so far.

    Packs with equal content are counted together, so a step places many pieces at once and the work depends on the
    number of lengths, at most ``size``, not on the number of documents. A pack left with more than ``max_padding``
    free tokens is cut at powers of two, which need no padding.
    """
    heap: list[tuple[int, int, int]] = []  # (content, first pack, packs)
    steps, packs = [], 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while count:
            if heap and heap[0][0] + length <= size:
                used, first, n = heapq.heappop(heap)
            else:
                used, first, n = 0, packs, -(-count // (size // length))
                packs += n
            placed = min(n, count)
            steps.append(((length << 44) | rank, rank, first, used))
            if placed < n:
                heapq.heappush(heap, (used, first + placed, n - placed))
            heapq.heappush(heap, (used + length, first, placed))
            rank, count = rank + placed, count - placed
    groups = sorted((first, n, used) for used, first, n in heap if used)
    cuts, bases, base = [], [], 0
    for _, n, used in groups:
        cut = [0, used]
        if size - used > max_padding and used & (used - 1):
            cut, at = [0], 0
            while at < used:
                at += 1 << ((used - at).bit_length() - 1)
                cut.append(at)
        cuts.append(cut)
        bases.append(base)
        base += n * (len(cut) - 1)
    steps.sort()
    columns = np.array(steps, np.int64).reshape(-1, 4).T
    first, _, used = np.array(groups, np.int64).reshape(-1, 3).T
    return PackPlan(*columns, first, np.array(bases, np.int64), used, cuts)


def _place(batches: Iterator[pa.RecordBatch], plan: PackPlan) -> Iterator[pa.RecordBatch]:
    whole = np.array([len(c) == 2 for c in plan.group_cuts], bool)
    for batch in batches:
        key, start, length, rank = (batch.column(c).to_numpy() for c in ("key", "start", "length", "rank"))
        step = np.searchsorted(plan.step_key, (length << 44) | rank, "right") - 1
        pack = plan.step_pack[step] + rank - plan.step_rank[step]
        offset = plan.step_offset[step]
        group = np.searchsorted(plan.group_first, pack, "right") - 1
        inside = pack - plan.group_first[group]
        easy = whole[group]
        out = [np.stack([key, start, length, plan.group_base[group] + inside, offset])[:, easy]]
        for i in np.flatnonzero(~easy):
            cut = plan.group_cuts[group[i]]
            base = plan.group_base[group[i]] + inside[i] * (len(cut) - 1)
            for j, (a, b) in enumerate(zip(cut, cut[1:])):
                lo, hi = max(a, offset[i]), min(b, offset[i] + length[i])
                if lo < hi:
                    out.append(np.array([[key[i]], [start[i] + lo - offset[i]], [hi - lo], [base + j], [lo - a]]))
        columns = np.concatenate(out, axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "start", "length", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, max_padding: int = 64) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset for each piece.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone. Documents are cut every
    ``size`` tokens; pieces of equal length are interchangeable and get their places by rank. Every id lies in one
    piece; offsets in a sequence are gapless from 0. Rows are packed one by one, so repeated rows and ids, and null ids,
    are packed as often as they occur. An empty table gives no pieces; other columns are ignored.

    Token ids are written once; only keys and lengths are shuffled for the ranks. The plan is made from the length
    histogram, which has at most ``size`` entries for any amount of documents.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    tokens = save(rows.mapInArrow(
        partial(_tokens, path=tokenizer, end_id=end_id), "key long, doc_id long, ids binary, doc_tokens long"
    ))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(size).cast("long")))
    pieces = tokens.select("key", "doc_tokens", start.alias("start"))
    pieces = pieces.select("key", "start", F.least(F.lit(size), F.col("doc_tokens") - F.col("start")).cast("long").alias("length"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packs(histogram, size, max_padding)
    ranges = max(1, sum(histogram.values()) // ROWS_PER_RANGE)
    pieces = pieces.withColumn("range", F.pmod(F.xxhash64("key", "start"), F.lit(ranges)))
    starts = pieces.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "range").orderBy("key", "start")
    ranked = pieces.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["length", "range"])
    ranked = ranked.select("key", "start", "length", (F.col("first") + F.col("at")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(partial(_place, plan=plan), "key long, start long, length long, sequence_id long, offset long")
    cut = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return placed.join(tokens, "key").select("doc_id", "start", "length", cut.alias("ids"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark, sf_dir):
    import public_tokenizers

    from trailmark.llm.common import table

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
