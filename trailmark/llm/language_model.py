"""Language-model scoring: an n-gram trie of three levels, sharded by context, queried by context-relative search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import bytestext as bt
from trailmark.llm.blobs import joined, pack_arrays, planes, unpack_arrays
from trailmark.llm.common import crc_mod, save, whole_text
from trailmark.llm.elias_fano import EliasFano, mapped

SHARD_BYTES = 4 << 20
HOT = 1 << 16  # uses of a word as context that one shard takes; contexts of more are dealt to several
RARE = 16  # uses in a part below which a part does not name a word when hot ones are sought
END, BEGIN = np.uint64(1), np.uint64(2)  # stand for the end of a text and the context of its first word
ASK_BYTES = 8 << 20  # texts that ask together; a larger part names its frequent words, pairs and triples less often
COMMON = (1 << 16) - 1  # frequent words that travel as 16-bit codes instead of hashes
COMMON_BYTES = 64 << 20  # text from which they are chosen; the choice changes sizes, never results
LEVELS = 255  # codes of a quantised probability
_STEP = 12.0 / (LEVELS - 1)  # decades per code
BINS = 40  # of context counts, by powers of two


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _steps(keys: np.ndarray) -> np.ndarray:
    """Planes of the differences of 32-bit keys, which are small where keys ascend."""
    return planes(np.diff(keys, prepend=np.uint32(0)))


def _keys(steps: np.ndarray) -> np.ndarray:
    """The keys of ``_steps``; differences below zero have wrapped around."""
    return np.cumsum(joined(steps, np.uint32), dtype=np.uint32)


class Common:
    """Frequent words, known to all tasks: their codes count from 1 in order of frequency, 0 stands for all other words."""

    def __init__(self, words: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.codes = words[order], (order + 1).astype(np.uint16)
        self.keys = np.concatenate([[np.uint64(0)], words >> np.uint64(32)]).astype(np.uint32)

    def code(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.uint16)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.codes[at], np.uint16(0))

    def pack(self, words: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending words as steps between the places of common ones and steps between the others."""
        places = np.searchsorted(self.words, words[codes > 0]).astype(np.uint16)
        return planes(np.diff(places, prepend=np.uint16(0))), planes(np.diff(words[codes == 0], prepend=np.uint64(0)))

    def unpack(self, places: np.ndarray, others: np.ndarray) -> np.ndarray:
        places = np.cumsum(joined(places, np.uint16), dtype=np.uint16)
        return np.sort(np.concatenate([self.words[places], np.cumsum(joined(others, np.uint64), dtype=np.uint64)]))

    def pack_keys(self, keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return planes(codes), _steps(keys[codes == 0])

    def unpack_keys(self, codes: np.ndarray, others: np.ndarray) -> np.ndarray:
        codes = joined(codes, np.uint16)
        keys = self.keys[codes]
        keys[codes == 0] = _keys(others)
        return keys


NO_WORDS = Common(np.empty(0, np.uint64))


def _ranks(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes of each id's place by frequency, which compress better than ids, and how often ids occur."""
    times = np.bincount(ids, minlength=size)
    place = np.empty(size, np.uint32)
    place[np.argsort(-times, kind="stable")] = np.arange(size, dtype=np.uint32)
    return planes(place[ids]), planes(_small(times))


def _ids(ranks: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    times = joined(times, np.dtype(f"u{len(times) // size}")).astype(np.int64)
    return np.argsort(-times, kind="stable")[joined(ranks, np.uint32)]


def quantise(p: np.ndarray) -> np.ndarray:
    """Code of a probability on a log scale; 0 stands for 0."""
    with np.errstate(divide="ignore"):
        code = LEVELS - np.rint(-np.log10(p) / _STEP)
    return np.where(p > 0, np.clip(code, 1, LEVELS), 0).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(LEVELS - code.astype(float)) * _STEP), 0.0)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the row of each."""
    starts, ends, row = bt.words(data, offsets)
    hashes = bt.word_hashes(bt.lower(data), starts, ends)
    hashes = np.where(hashes <= BEGIN, hashes + np.uint64(3), hashes)
    n = len(offsets) - 1
    row = np.concatenate([row, np.arange(n)])
    hashes = np.concatenate([hashes, np.full(n, END)])
    order = np.argsort(row, kind="stable")
    return hashes[order], row[order]


def _context_counts(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """How often each part has the words it has ``least`` times or more as contexts; one part of ``every`` also tells
    how often it has the words it has twice or more (``seen``)."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        for _, _, data, offsets in bt.parts(batch.column("text"), 2 * bt.PART_BYTES):
            words, times = np.unique(_tokens(data, offsets)[0], return_counts=True)
            words[words == END] = BEGIN  # as many texts begin as end
            seen = np.where((times > 1) & (part % every == 0), times, 0)
            times[times < least] = 0
            told = (times > 0) | (seen > 0)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)[told]), pa.array(times[told]), pa.array(seen[told])], ["word", "times", "seen"])
            part += 1


def _frequent(rows: DataFrame, size: int, shards: int) -> tuple[tuple[np.ndarray, np.ndarray], Common]:
    """Contexts with more uses than ``HOT``, and over how many shards each is dealt; words that travel as codes.

    A part leaves out what it has less than its share of ``HOT`` of, or less than ``RARE``: so much is missed at most.
    """
    least = max(HOT // (2 * (1 + size // (2 * bt.PART_BYTES))), RARE)
    every = -(-size // COMMON_BYTES) or 1
    found = rows.select("text").mapInArrow(partial(_context_counts, least=least, every=every), "word long, times long, seen long")
    found = save(found.groupBy("word").agg(F.sum("times").alias("times"), F.sum("seen").alias("seen")))
    hot = found.where(F.col("times") > HOT // 2).select("word", "times").toPandas()
    words, times = hot["word"].to_numpy(np.int64).view(np.uint64), hot["times"].to_numpy(np.int64)
    order = np.argsort(words)
    common = found.where("seen > 0").orderBy(F.desc("seen"), "word").select("word").limit(COMMON).toPandas()
    return (words[order], np.minimum(-(-times // (HOT // 2)), shards)[order]), Common(common["word"].to_numpy(np.int64).view(np.uint64))


def _hot(rows: DataFrame, size: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return _frequent(rows, size, shards)[0]


def _lanes(words: np.ndarray, ids: np.ndarray, context: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lane of each token under its context, by the token's hash, and the hash that deals it to a shard; lane 0 keeps the context's own."""
    fan = np.ones(len(words), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], words), len(hot[0]) - 1)
        fan = np.where(hot[0][at] == words, hot[1][at], 1)
    lane = (bt.mix64(words) & np.uint64(0xFFFFFFFF)).astype(np.int64)[ids] % fan[context]
    split = lane > 0
    own = words[context]
    own[split] = bt.mix64(own[split] + lane[split].astype(np.uint64) * bt.BASE)
    return lane, own


def _before(ids: np.ndarray, row: np.ndarray, begin: int) -> np.ndarray:
    """The word before each token in its text."""
    out = np.empty(len(ids), np.int64)
    if len(ids):
        out[0] = begin
        out[1:] = np.where(row[1:] == row[:-1], ids[:-1], begin)
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the index of each; keys and places are sorted as one number where they fit into 63 bits."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << bits) | np.arange(len(keys)))
    at, both = both & ((1 << bits) - 1), both >> bits
    first = np.concatenate([[True], both[1:] != both[:-1]])
    index = np.empty(len(keys), np.int64)
    index[at] = np.cumsum(first) - 1
    return both[first], index


def _grams(ids: np.ndarray, last: np.ndarray, context: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs (context, word), longer contexts (context, word before it) and triples (longer context, pair) of
    the texts, each followed by the index of every token in it; tokens behind two others of their text (the begin
    counts) have triples, and the last result says which they are. ``context`` is ``last``, the word before, or its lane."""
    pairs, pair = _distinct(context * size + ids)
    deep = np.flatnonzero(row[1:] == row[:-1]) + 1
    befores, before = _distinct(context[deep] * size + last[deep - 1])
    triples, triple = _distinct(before * max(len(pairs), 1) + pair[deep])
    return pairs, pair, befores, before, triples, triple, deep


def _ask(batches: Iterator[pa.RecordBatch], shards: int, hot: tuple[np.ndarray, np.ndarray], common: Common = NO_WORDS) -> Iterator[pa.RecordBatch]:
    """Per part of the input: its texts as local word ids, and for every shard its words, the distinct words behind and
    before them in the part, and the distinct triples around them, with training counts (0: only asked for). The lanes
    of a hot context are words of their own, which no text has."""
    task, seen = TaskContext.get().partitionId(), 0
    width = np.uint64((1 << 64) // shards + 1)
    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        ids_of = batch.column("doc_id").to_numpy()
        total = len(bt.text_bytes(batch.column("text"))[0])
        size = total // max(1, total // ASK_BYTES) + ASK_BYTES // 64  # no part for what a batch has over
        for first, end, data, offsets in bt.parts(batch.column("text"), size):
            part = (task << 32) | seen
            seen += 1
            hashes, row = _tokens(data, offsets)
            vocab, ids = np.unique(np.concatenate([hashes, [BEGIN]]), return_inverse=True)
            begin, ids = int(ids[-1]), ids[:-1].astype(np.int64)
            last = _before(ids, row, begin)
            lane, own = _lanes(vocab, ids, last, hot)
            split = lane > 0
            if split.any():
                words, vocab = vocab, np.union1d(vocab, own[split])
                moved = np.searchsorted(vocab, words)
                begin, ids, last = int(moved[begin]), moved[ids], moved[last]
            context = last.copy()
            context[split] = np.searchsorted(vocab, own[split])
            size = len(vocab)
            learn = train[first:end][row]
            counts = np.bincount(ids[learn], minlength=size)
            pairs, pair, befores, _, triples, triple, deep = _grams(ids, last, context, row, size)
            times = np.bincount(pair[learn], minlength=len(pairs))
            times3 = np.bincount(triple[learn[deep]], minlength=len(triples))
            key, code = (vocab >> np.uint64(32)).astype(np.uint32), common.code(vocab)  # keys ascend with the ids
            lanes, at = np.unique(last[split] * shards + lane[split], return_index=True)
            lane_words = context[split][at]
            context, before_context = pairs // size, befores // size
            above, after = np.divmod(triples, max(len(pairs), 1))
            after = after - np.searchsorted(context, before_context)[above]  # place among the words behind the context
            cuts = np.searchsorted((vocab // width).astype(np.int64), np.arange(shards + 1))
            pair_cuts, before_cuts = np.searchsorted(context, cuts), np.searchsorted(before_context, cuts)
            triple_cuts = np.searchsorted(above, before_cuts)
            # the texts travel with the first question and come back with the answers
            blobs = [pack_arrays(
                *_ranks(ids, size), np.bincount(row, minlength=end - first), np.array([size, begin]),
                planes(ids_of[first:end].astype(np.int64)), train[first:end].astype(np.uint8),
                planes(_small(lane)), planes(lanes), planes(lane_words), level=1,
            )]
            rows, kinds = [part % shards], [0]
            for s in np.flatnonzero(np.diff(cuts)):
                v, p, b, t = (slice(c[s], c[s + 1]) for c in (cuts, pair_cuts, before_cuts, triple_cuts))
                n = cuts[s + 1] - cuts[s]
                child, before = pairs[p] % size, befores[b] % size
                blobs.append(pack_arrays(
                    *common.pack(vocab[v], code[v]), *common.pack_keys(key[child], code[child]), *common.pack_keys(key[before], code[before]),
                    _small(counts[v]), _small(np.bincount(context[p] - cuts[s], minlength=n)), _small(times[p]),
                    _small(np.bincount(before_context[b] - cuts[s], minlength=n)),
                    _small(np.bincount(above[t] - before_cuts[s], minlength=before_cuts[s + 1] - before_cuts[s])),
                    planes(_small(after[t])), _small(times3[t]), level=3,
                ))
                rows.append(int(s))
                kinds.append(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(kinds, pa.int64()), pa.array(blobs, pa.binary())],
                ["shard", "part", "kind", "blob"],
            )


class Level:
    """Ascending 32-bit keys under each parent with their counts; the pointers give each parent's range of keys."""

    def __init__(self, parents: int, parent: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))]))
        self.keys, self.times = mapped(key.astype(np.uint32)), mapped(_small(times))

    def range(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pointers.at(parent), self.pointers.at(parent + 1)

    def find(self, low: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each key inside its range, and whether it is there."""
        low, keys = low.copy(), np.asarray(self.keys)
        if not len(keys):
            return low, np.zeros(len(low), bool)
        go = np.flatnonzero(low < end)
        first, top, want = low[go], end[go], key[go]
        while len(go):
            mid = (first + top) >> 1
            less = keys[mid] < want
            first, top = np.where(less, mid + 1, first), np.where(less, top, mid)
            found = first == top
            low[go[found]] = first[found]
            go, first, top, want = (x[~found] for x in (go, first, top, want))
        return low, (low < end) & (keys[np.minimum(low, len(keys) - 1)] == key)

    def count(self, low: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 where the parent never had the key."""
        at, same = self.find(low, end, key)
        out = np.zeros(len(at), np.int64)
        out[same] = self.times[at[same]]
        return out


class Trie:
    """Words of a shard, the words behind each of them, and the words behind each of them and the word before it.

    Keys are relative to their context: a context's successors are one ascending range, whose ends the pointers give,
    and only that range is searched. ``longer`` holds the words before each word, as (word, key); ``third`` the words
    behind such a pair, as (pair, key, times).
    """

    def __init__(
        self, words: np.ndarray, counts: np.ndarray, context: np.ndarray, child: np.ndarray, times: np.ndarray,
        longer: tuple[np.ndarray, np.ndarray] | None = None, third: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    ) -> None:
        none = np.empty(0, np.int64)
        self.words = EliasFano(words)
        self.counts = mapped(counts)
        self.total = np.bincount(context, times, minlength=len(words)).astype(np.int64)
        self.behind = Level(len(words), context, child, times)
        longer, third = longer or (none, none), third or (none, none, none)
        self.longer = Level(len(words), *longer, none)
        self.third = Level(len(longer[0]), *third)

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words.successor(word)

    def probability(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Codes of the successors' shares of their contexts; 0 where a context never had the successor."""
        return quantise(self.behind.count(*self.behind.range(context), child) / np.maximum(self.total[context], 1))


def _bin(count: np.ndarray) -> np.ndarray:
    """0 for none, then one bin per power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.uint8)


def _unique_sums(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys as their upper and lower 32 bits, and the sum of each."""
    found, inverse = np.unique(key, return_inverse=True)
    summed = np.bincount(inverse, times, minlength=len(found)).astype(np.int64)
    return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), summed


def _question(blob: bytes, common: Common) -> tuple[np.ndarray, ...]:
    """Words, their counts, successors (degree, key, times), words before them (degree, key) and triples (degree, place, times)."""
    places, others, child, child_others, before, before_others, counts, degree, times, degree_b, degree3, after, times3 = unpack_arrays(blob)
    after = joined(after, np.dtype(f"u{len(after) // max(len(times3), 1) or 1}")).astype(np.int64)
    return (
        common.unpack(places, others), counts, degree, common.unpack_keys(child, child_others), times,
        degree_b, common.unpack_keys(before, before_others), degree3, after, times3,
    )


def _answer(rows: pd.DataFrame, common: Common = NO_WORDS) -> pd.DataFrame:
    """Build one shard's trie from the training counts of all parts and answer every part's questions with it."""
    out = [(r.part, r.shard, 0, r.blob) for r in rows[rows["kind"] == 0].itertuples()]
    asked = rows[rows["kind"] == 1]
    parts = [_question(b, common) for b in asked["blob"]]
    if parts:
        words = [p[0] for p in parts]
        known, inverse = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
        wide, shift = np.uint64, np.uint64(32)
        at = np.split(inverse, np.cumsum([len(w) for w in words])[:-1])
        keys, keys_b, keys3 = [], [], []
        for where, (_, _, degree, child, times, degree_b, before, degree3, after, times3) in zip(at, parts):
            degree, degree_b = degree.astype(np.int64), degree_b.astype(np.int64)
            keys.append((np.repeat(where, degree).astype(wide) << shift) | child)
            keys_b.append((np.repeat(where, degree_b).astype(wide) << shift) | before)
            keys3.append(child[np.repeat(np.repeat(np.cumsum(degree) - degree, degree_b), degree3) + after])
        times = np.concatenate([p[4] for p in parts]).astype(np.int64)
        times3 = np.concatenate([p[9] for p in parts]).astype(np.int64)
        key, learned = np.concatenate(keys), times > 0
        pairs = _unique_sums(key[learned], times[learned])
        above, learned = np.concatenate([np.repeat(k, p[7]) for k, p in zip(keys_b, parts)]), times3 > 0
        longer, above = np.unique(above[learned], return_inverse=True)
        third = _unique_sums((above.astype(wide) << shift) | np.concatenate(keys3)[learned], times3[learned])
        trie = Trie(known, counts, *pairs, ((longer >> shift).astype(np.int64), (longer & wide(0xFFFFFFFF)).astype(np.uint32)), third)
        shard = int(asked["shard"].iat[0])
        out.append((-1 - shard, shard, 2, pack_arrays(np.array([counts.sum(), (counts > 0).sum()], float), np.array([(counts.astype(float) ** 2).sum()]))))
        # the questions of all parts at once
        degree, child, degree_b, before, degree3 = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 5, 6, 7))
        where = trie.find(known)[0]
        low, end = (np.repeat(x[inverse], degree) for x in trie.behind.range(where))
        found = trie.behind.count(low, end, child)
        low, end = (np.repeat(x[inverse], degree_b) for x in trie.longer.range(where))
        pair, same = trie.longer.find(low, end, before)
        low, end = trie.third.range(np.where(same, pair, 0)) if len(longer) else (np.zeros(len(pair), np.int64),) * 2
        end = np.where(same, end, low)
        found3 = trie.third.count(np.repeat(low, degree3), np.repeat(end, degree3), np.concatenate(keys3))
        answers = [np.asarray(trie.counts)[where][inverse], found, found3]
        for i, sizes in enumerate(([len(w) for w in words], [len(p[3]) for p in parts], [len(k) for k in keys3])):
            answers[i] = np.split(answers[i], np.cumsum(sizes)[:-1])
        for part, *answer in zip(asked["part"], *answers):
            out.append((part, shard, 1, pack_arrays(*map(_small, answer), level=3)))
    return pd.DataFrame(out, columns=["part", "shard", "kind", "blob"])


def _contexts(count: np.ndarray, count2: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often training texts have the context of each token, one word and two words long.

    All texts end, so the first word's context occurs as often as the end does; it is no longer context.
    """
    first = np.cumsum(length) - length
    total, total2 = np.empty_like(count), np.empty_like(count)
    total[1:], total2[1:] = count[:-1], count2[:-1]
    total[first], total2[first] = count[-1:], 0
    return total, total2


def _merge(rows: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Counts of every token of a part, and its training tokens' leave-one-out statistics; totals of a shard pass through."""
    rows = rows.drop_duplicates(["kind", "shard"]).sort_values("shard")
    if (rows["kind"] == 2).any():
        return pd.DataFrame({"blob": [None], "stats": [pack_arrays(*[np.zeros(BINS)] * 4, *unpack_arrays(rows["blob"].iat[0]))]})
    ranks, often, length, (size, begin), doc, train, lane, lanes, lane_words = unpack_arrays(rows[rows["kind"] == 0]["blob"].iat[0])
    ids = _ids(ranks, often, int(size))
    row = np.repeat(np.arange(len(length)), length)
    last = _before(ids, row, int(begin))
    lane = joined(lane, np.dtype(f"u{len(lane) // len(ids)}")).astype(np.int64)
    context, split = last.copy(), lane > 0
    context[split] = joined(lane_words, np.int64)[np.searchsorted(joined(lanes, np.int64), last[split] * shards + lane[split])]
    answers = [unpack_arrays(b) for b in rows[rows["kind"] == 1]["blob"]]
    known, known2, known3 = (np.concatenate([a[i] for a in answers]).astype(np.int64) for i in range(3))
    _, pair, _, _, _, triple, deep = _grams(ids, last, context, row, int(size))
    count, count2, count3 = known[ids], known2[pair], np.zeros(len(ids), np.int64)
    count3[deep] = known3[triple]
    # leave one out: how likely is a training token under the other occurrences of its context
    learn, stats = train[row] > 0, []
    for c, total in zip((count2, count3), _contexts(count, count2, length)):
        again = learn & (total > 1)
        bins = _bin(total[again] - 1)
        stats += [np.bincount(bins, (c[again] - 1) / (total[again] - 1), minlength=BINS), np.bincount(bins, minlength=BINS).astype(float)]
    blob = pack_arrays(planes(count), planes(count2), planes(count3), length, doc, level=3)
    return pd.DataFrame({"blob": [blob], "stats": [pack_arrays(*stats, np.zeros(2), np.zeros(1))]})


def _finish(batches: Iterator[pd.DataFrame], mix: np.ndarray, mix3: np.ndarray, total: int, types: int) -> Iterator[pd.DataFrame]:
    """Scores of the texts of each part under one, two and three words."""
    for batch in batches:
        for blob in batch["blob"]:
            *counts, length, doc = unpack_arrays(blob)
            count, count2, count3 = (joined(c, np.int64) for c in counts)
            one, two = _contexts(count, count2, length)
            row, n = np.repeat(np.arange(len(length)), length), len(length)
            base = (count + 1) / (total + types + 1)
            weight, weight3 = mix[_bin(one)], mix3[_bin(two)]
            p = weight * (count2 / np.maximum(one, 1)) + (1 - weight) * base
            p3 = weight3 * (count3 / np.maximum(two, 1)) + (1 - weight3) * p
            yield pd.DataFrame({
                "doc_id": joined(doc, np.int64), "n_tokens": length.astype(np.int64), "n_known": np.bincount(row, count > 0, minlength=n).astype(np.int64),
                "base_score": np.bincount(row, np.log10(base), minlength=n), "pair_score": np.bincount(row, np.log10(p), minlength=n),
                "score": np.bincount(row, np.log10(p3), minlength=n),
            })


def _mix(hits: np.ndarray, tokens: np.ndarray, chance: float) -> np.ndarray:
    mix = np.where(tokens > 0, (hits / np.maximum(tokens, 1) - chance) / max(1 - chance, 1e-9), 0.0)
    mix = np.clip(mix, 0, 0.95)
    mix[0] = 0
    return mix


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, pair_score, score for each row; the model learns where ``train`` holds.

    Tokens are runs of non-blanks with A-Z lower-cased, and one end per text, so null and empty texts have one token.
    The unigram gives (c + 1) / (N + V + 1), with one share for all unknown tokens. The bigram share c(v, w) / c(v)
    is mixed in with a weight that depends on how often the context v was seen (``pair_score``), and the trigram share
    c(u, v, w) / c(u, v) likewise on top (``score``); the weights make the mixture agree with how often training tokens
    repeat what else follows their context. Each step sums to one over all tokens.

    Repeated rows are scored as they come; ids must not be null here (see ``score_all``); other columns are ignored.

    Parts of the input ask shards about their distinct words, the words behind and before them and the triples around
    them, with their training counts; a shard sums the counts into a trie and answers with counts. Frequent words are
    thus sent once per part, as codes of a list of ``COMMON`` words. The number of shards grows with the text, and no part of the model is sent whole to any task.

    Contexts of many uses are found by a count first, and their successors are dealt to several shards by hash. Shards
    answer with counts, so no total is split: a context occurs as often as its word or pair, which one shard counts.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    hot, common = _frequent(rows, size, shards)
    asked = rows.mapInArrow(partial(_ask, shards=shards, hot=hot, common=common), "shard long, part long, kind long, blob binary")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        return _answer(rows, common)

    answered = asked.repartition(shards, "shard").groupBy("shard").applyInPandas(answer, "part long, shard long, kind long, blob binary")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _merge(rows, shards)

    merged = save(answered.repartition(shards, "part").groupBy("part").applyInPandas(merge, "blob binary, stats binary"))
    stats = [np.zeros(BINS)] * 4 + [np.zeros(2), np.zeros(1)]
    for r in merged.select("stats").toLocalIterator():
        stats = [a + b for a, b in zip(stats, unpack_arrays(bytes(r["stats"])))]
    hits, tokens, hits3, tokens3, (total, types), (squares,) = stats
    total, types = int(total), int(types)
    mix = _mix(hits, tokens, squares / max(total, 1) ** 2)
    mix3 = _mix(hits3, tokens3, hits.sum() / max(tokens.sum(), 1))
    scored = merged.where("blob is not null").select("blob").mapInPandas(
        partial(_finish, mix=mix, mix3=mix3, total=total, types=types),
        "doc_id long, n_tokens long, n_known long, base_score double, pair_score double, score double",
    )
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "pair_score", "score")


def score_all(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """``score`` with every id, null ids as well, held out where crc32 of the id as text modulo ``modulus`` is ``rest``."""
    held_out = crc_mod(F.col("doc_id"), modulus) == rest
    least = docs.agg(F.min("doc_id")).first()[0]
    stand_in = (least or 0) - 1  # for null ids, which count as empty text in the hash
    rows = docs.select(F.coalesce("doc_id", F.lit(stand_in)).alias("doc_id"), "text", (~held_out).alias("train"))
    out = score(rows, F.col("train"))
    doc_id = F.when(F.col("doc_id") != stand_in, F.col("doc_id"))
    return out.withColumn("doc_id", doc_id).withColumn("held_out", held_out)


def op9_language_model(spark, sf_dir):
    from trailmark.llm.common import table

    return score_all(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
