"""Repeated byte strings across documents: sampled super-windows, hash-compared suffix sort, removal by position."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import bytestext as bt
from trailmark.llm.blobs import joined, pack_arrays, planes, unpack_arrays
from trailmark.llm.common import whole_text

WIDTH = 50  # bytes of a string that counts as repeated
SEED = 8  # bytes of the strings whose smallest hash picks a window's bucket
BUCKET_BYTES = 4 << 20  # text per bucket
HOT = 4 << 20  # distinct windows of one seed that stay together
BLOCK = 1 << 14  # windows hashed at once
FILTER = 22  # bits of a hash that name its place in a filter
RARE = 64  # windows of a seed in a part below which the part does not name it when hot seeds are sought
_LANES = np.array([0, 8, 16, 24, 32, 40, WIDTH - 8])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _loads(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes at every position, as numbers; ``data`` is padded at its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), order, padded, 0, (1,))


def _window_hashes(loads: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ``at``, a few at a time, which stay in the processor's cache."""
    total = np.zeros(len(at), np.uint64)
    for first in range(0, len(at), BLOCK):
        some, out = at[first : first + BLOCK], total[first : first + BLOCK]
        for lane, odd in zip(_LANES, _ODD):
            x = loads[some + lane]
            x *= odd
            x ^= x >> np.uint64(29)
            x *= odd
            out += x
    return total


def _smallest(h: np.ndarray) -> np.ndarray:
    """Place of the seed with the smallest hash in each window."""
    bits = np.uint64(max(len(h).bit_length(), 24))  # the same for all parts, which must agree on equal windows
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span, wide = 1, WIDTH - SEED + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ascending ``some``."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _runs(
    data: np.ndarray, offsets: np.ndarray, hot: tuple[np.ndarray, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows and key of each run of windows with the same smallest seed, and whether that is in ``hot[0]``."""
    n = len(data) - WIDTH + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(bool)
    loads = _loads(data)
    h = loads[: len(data) - SEED + 1] * _ODD[0]
    h ^= h >> np.uint64(31)
    h *= _ODD[3]
    seed = _smallest(h)
    new = np.ones(n, bool)
    np.not_equal(seed[1:], seed[:-1], out=new[1:])
    new[offsets[offsets < n]] = True
    at = np.flatnonzero(new)
    key, warm = h[seed[at]], np.zeros(len(at), bool)
    if len(hot) and (warm := _among(key, hot[0])).any():
        lengths = np.diff(np.append(at, n))[warm]
        inner = _ranges(at[warm], lengths)  # windows whose smallest seed is hot
        # only what they cover is hashed again, and windows that follow each other together
        edge = np.flatnonzero(np.r_[True, inner[1:] != inner[:-1] + 1])
        size = np.diff(np.append(edge, len(inner)))
        covered = _ranges(inner[edge], size + WIDTH - SEED)
        h2 = bt.mix64(h[covered] * _ODD[1])
        h2[_among(h[covered], hot[0])] = np.uint64((1 << 64) - 1)
        second = _smallest(h2)[_ranges(edge + np.arange(len(edge)) * (WIDTH - SEED), size)]
        least, second = h2[second], covered[second]
        own = np.repeat(key[warm], lengths)
        parted = np.ones(len(inner), bool)
        parted[1:] = (second[1:] != second[:-1]) | (inner[1:] != inner[:-1] + 1)
        own = bt.mix64(own * _ODD[2] + least)
        if len(hot) > 1 and (boiling := _among(own, hot[1])).any():
            own[boiling] = bt.mix64(_window_hashes(loads, inner[boiling]))
            parted |= boiling
            parted[1:] |= boiling[:-1]
        parted |= new[inner]
        at, key = np.concatenate([at[~warm], inner[parted]]), np.concatenate([key[~warm], own[parted]])
        order = np.argsort(at)
        warm = np.repeat([False, True], [len(at) - int(parted.sum()), int(parted.sum())])[order]
        at, key = at[order], key[order]
    row = np.searchsorted(offsets, at, "right") - 1
    count = np.minimum(np.append(at[1:], n), offsets[row + 1] - WIDTH + 1) - at
    inside = count > 0  # windows that do not cross documents
    return at[inside], count[inside], key[inside], warm[inside]


def _contents(loads: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the strings of runs of windows, by their first and last windows and their number."""
    first, last = (_window_hashes(loads, at) for at in (start, start + count - 1))
    return bt.mix64(first * _ODD[4] + last * _ODD[5] + count.astype(np.uint64))


def super_windows(
    data: np.ndarray, offsets: np.ndarray, hot: tuple[np.ndarray, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows, key and content hash of each run of windows with the same smallest seed.

    Equal windows have equal seeds at equal distances, so they meet in the bucket of their key, the seed's hash. Where
    that is in ``hot[0]``, a second seed that is not, smallest by another hash, tells windows apart further; where the
    key of both is in ``hot[1]``, each window is a run and its own hash the key.
    """
    start, count, key, _ = _runs(data, offsets, hot)
    return start, count, key, _contents(_loads(data), start, count)


def told_apart(text: np.ndarray, start: np.ndarray, count: np.ndarray, content: np.ndarray) -> np.ndarray:
    """``content``, but numbers of the strings themselves if it is equal for super-windows of unequal bytes."""
    if not len(content):
        return content
    order = np.argsort(content, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = content[order][1:] != content[order][:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[head][np.cumsum(head) - 1]
    loads = _loads(text)
    same = (count == count[lead]).all()
    for lane in _LANES:
        same = same and (loads[start + lane] == loads[start[lead] + lane]).all()
        same = same and (loads[start + count - 1 + lane] == loads[start[lead] + count - 1 + lane]).all()
    if same:
        return content
    strings = [text[a : a + n + WIDTH - 1].tobytes() for a, n in zip(start.tolist(), count.tolist())]
    numbers = {x: i for i, x in enumerate(dict.fromkeys(strings))}
    return np.array([numbers[x] for x in strings], np.uint64)


def _seed_counts(batches: Iterator[pa.RecordBatch], least: int, hot: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Distinct windows per key in each part, of the keys with ``least`` or more; with ``hot``, only of its windows."""
    for batch in batches:
        for _, _, data, offsets in bt.parts(batch.column("text"), 2 * bt.PART_BYTES):
            start, count, key, warm = _runs(data, offsets, hot)
            if len(hot):
                start, count, key = start[warm], count[warm], key[warm]
            # copies count once, which takes their contents: only of keys that have enough windows with all copies
            keys, inverse = np.unique(key, return_inverse=True)
            may = (np.bincount(inverse, count, minlength=len(keys)) >= least)[inverse]
            start, count, key = start[may], count[may], key[may]
            _, once = np.unique(_contents(_loads(data), start, count), return_index=True)
            keys, inverse = np.unique(key[once], return_inverse=True)
            times = np.bincount(inverse, count[once], minlength=len(keys)).astype(np.int64)
            many = times >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(times[many])], ["key", "times"])


def hot_keys(rows: DataFrame, size: int) -> tuple[np.ndarray, ...]:
    """Seeds of more distinct windows than ``HOT``, and keys of two seeds that are still such.

    A part leaves out what it has less than its share of ``HOT`` of, or less than ``RARE``: so much is missed at most.
    """
    least = max(HOT // (2 * (1 + size // (2 * bt.PART_BYTES))), RARE)
    hot: tuple[np.ndarray, ...] = ()
    while len(hot) < 2:
        found = rows.select("text").mapInArrow(partial(_seed_counts, least=least, hot=hot), "key long, times long")
        found = found.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") > HOT // 2).select("key").toPandas()
        if found.empty:
            break
        hot += (np.sort(found["key"].to_numpy(np.int64).view(np.uint64)),)
    return hot


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start+1, .. start+length-1 of every pair, one after the other."""
    first = np.cumsum(length) - length
    return np.arange(int(length.sum())) - np.repeat(first - start, length)


def _split(batches: Iterator[pa.RecordBatch], buckets: int, hot: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Per part of a batch and bucket: distinct super-windows, where they occur, and occurrences already decided."""
    for batch in batches:
        ids, ofs = batch.column("doc_id").to_numpy(), batch.column("of").to_numpy()
        for first, end, data, offsets in bt.parts(batch.column("text"), 2 * bt.PART_BYTES):
            start, count, key, content = super_windows(data, offsets, hot)
            if not len(start):
                continue
            content = told_apart(data, start, count, content)
            row = np.searchsorted(offsets, start, "right") - 1
            doc = ids[first:end][row]
            order = np.argsort(content, kind="stable")
            head = np.ones(len(order), bool)
            head[1:] = content[order][1:] != content[order][:-1]
            heads = np.flatnonzero(head)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(head) - 1
            # a copy in a smaller document of the same part decides all windows at once
            open_ = doc == np.minimum.reduceat(doc[order], heads)[group]
            bucket = (bt.mix64(key) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")  # in text order inside a bucket
            seen, at = np.unique(group[by][open_[by]], return_index=True)
            top = np.zeros(len(by), bool)
            top[np.flatnonzero(open_[by])[at]] = True
            place = np.cumsum(top) - 1
            number = np.empty(len(heads), np.int64)
            number[seen] = place[np.flatnonzero(open_[by])[at]]
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows, blobs = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                mine = by[cuts[b] : cuts[b + 1]]
                text = mine[top[cuts[b] : cuts[b + 1]]]
                held, times = np.unique(row[mine], return_counts=True)
                base = place[cuts[b]] + (not top[cuts[b]])
                frag = np.where(open_[mine], number[group[mine]] - base, -1)
                rows.append(b)
                blobs.append(pack_arrays(
                    data[_ranges(start[text], count[text] + WIDTH - 1)], count[mine].astype(np.uint8),
                    planes(np.diff(frag, prepend=0)), planes(start[mine] - offsets[row[mine]]),
                    planes(np.diff(ids[first:end][held], prepend=0)), ofs[first:end][held], planes(times),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def suffix_sort(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``width`` bytes, and for each place whether it differs from the one before.

    Prefix polynomial hashes give the hash of any substring, so the common extension of two suffixes takes a binary
    search. Each round finds how far every group of equal suffixes agrees with its first, skips those bytes and merge
    sorts the group by the eight bytes behind them. Groups that agree on ``width`` bytes are compared byte by byte at
    the end, which splits those that only their hashes made equal.
    """
    order = np.arange(len(at))
    new = np.zeros(len(at), bool)
    if not len(at):
        return order, new
    new[0] = True
    power = bt.powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    big = _loads(data, ">u8")
    open_ = np.ones(len(at), bool)  # places whose group is not decided
    while open_.any():
        places = np.flatnonzero(open_)
        head = new[places]
        heads = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        a = at[order[places]]
        b = a[heads][group]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), width)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (sums[a + mid] - sums[a]) * power[b] == (sums[b + mid] - sums[b]) * power[a]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        depth = np.minimum.reduceat(low, heads)
        done = (depth >= width)[group]
        open_[places[done]] = False
        places, group, a = places[~done], group[~done], a[~done]
        if not len(places):
            break
        depth = depth[group]
        key = big[a + depth].astype(np.uint64) >> (np.maximum(depth + 8 - width, 0) * 8).astype(np.uint64)
        by = np.lexsort((key, group))  # a stable merge sort
        order[places] = order[places][by]
        key = key[by]
        new[places[1:]] |= key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    first = at[order[heads]][np.cumsum(new) - 1]
    little = _loads(data)
    for lane in _LANES:
        if (little[at[order] + lane] != little[first + lane]).any():  # equal hashes of unequal strings: sort the strings
            strings = np.array([data[p : p + width].tobytes() for p in at])
            order = np.argsort(strings, kind="stable")
            new[1:] = strings[order][1:] != strings[order][:-1]
            break
    return order, new


def _decide(rows: pd.DataFrame, groups: int) -> pd.DataFrame:
    """Windows of one bucket that also start in a smaller document: start and bit mask of each run, by group of documents."""
    columns: list[list] = [[] for _ in range(7)]
    base = 0
    for blob in rows["blob"]:
        text, count, frag, pos, held, of, times = unpack_arrays(blob)
        frag, times = np.cumsum(joined(frag, np.int64)), joined(times, np.int64)
        windows = np.zeros(frag.max() + 1, np.uint8)
        windows[frag[frag >= 0]] = count[frag >= 0]
        frag = np.where(frag >= 0, frag + base, -1)
        base += len(windows)
        held = np.repeat(np.cumsum(joined(held, np.int64)), times)
        for c, x in zip(columns, (text, windows, count, frag, joined(pos, np.int64), held, np.repeat(of, times))):
            c.append(x)
    text, windows, count, frag, pos, doc, of = (np.concatenate(c) for c in columns)
    del columns
    windows, count, open_ = windows.astype(np.int64), count.astype(np.int64), frag >= 0
    lengths = windows + WIDTH - 1
    at = np.cumsum(lengths) - lengths
    loads = _loads(text)
    content = _contents(loads, at, windows)
    content = told_apart(text, at, windows, content)
    least = np.full(len(windows), np.iinfo(np.int64).max)
    np.minimum.at(least, frag[open_], doc[open_])
    order = np.lexsort((least, content))
    head = np.ones(len(order), bool)
    head[1:] = content[order][1:] != content[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    lead = order[head]  # one super-window of each content, with the smallest document that holds it
    smallest = least[lead]

    start = _ranges(at[lead], windows[lead])
    of_lead = np.repeat(np.arange(len(lead)), windows[lead])
    hashes = _window_hashes(loads, start)
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    # most windows occur once: a filter leaves few to be looked up
    may = np.zeros(1 << FILTER, bool)
    may[twice >> np.uint64(64 - FILTER)] = True
    cand = np.flatnonzero(may[hashes >> np.uint64(64 - FILTER)])
    cand = cand[_among(hashes[cand], twice)]
    mask = np.zeros(len(lead), np.int64)
    if len(cand):
        used = np.unique(of_lead[cand])
        small = text[_ranges(at[lead][used], lengths[lead][used])]
        moved = np.cumsum(lengths[lead][used]) - lengths[lead][used]
        where = moved[np.searchsorted(used, of_lead[cand])] + start[cand] - at[lead][of_lead[cand]]
        by, new = suffix_sort(small, where, WIDTH)
        holder = smallest[of_lead[cand]][by]
        heads = np.flatnonzero(new)
        first = np.minimum.reduceat(holder, heads)[np.cumsum(new) - 1]
        hit = cand[by[first < holder]]
        np.bitwise_or.at(mask, of_lead[hit], np.int64(1) << (start[hit] - at[lead][of_lead[hit]]))
    own = (np.int64(1) << count) - 1
    same = np.flatnonzero(open_)
    same = same[doc[same] == smallest[group[frag[same]]]]
    own[same] = mask[group[frag[same]]]
    hit = own != 0
    doc, of, pos, own = doc[hit], of[hit], pos[hit], own[hit]
    by = np.lexsort((of, doc, doc % groups))
    doc, of, pos, own = doc[by], of[by], pos[by], own[by]
    cuts = np.searchsorted(doc % groups, np.arange(groups + 1))
    some = np.flatnonzero(np.diff(cuts))
    marks = []
    for g in some:
        x = slice(cuts[g], cuts[g + 1])
        marks.append(pack_arrays(planes(np.diff(doc[x], prepend=0)), of[x], planes(pos[x].astype(np.int32)), planes(own[x])))
    return pd.DataFrame({"g": some, "marks": marks})


def _cut(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Remove the marked windows from one group of documents."""
    columns: list[list] = [[np.empty(0, np.int64)] for _ in range(4)]
    for blob in rows["marks"]:
        doc, of, pos, own = unpack_arrays(blob)
        for c, x in zip(columns, (np.cumsum(joined(doc, np.int64)), of, joined(pos, np.int32), joined(own, np.int64))):
            c.append(x)
    doc, of, pos, own = (np.concatenate(c) for c in columns)
    by = np.lexsort((of, doc))
    doc, of, pos, own = doc[by], of[by], pos[by], own[by]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])]) if len(doc) else np.empty(0, np.int64)
    where = {(d, o): (a, z) for d, o, a, z in zip(doc[cut].tolist(), of[cut].tolist(), cut, np.append(cut[1:], len(doc)))}
    bits, out = np.arange(WIDTH - SEED + 1), []
    for d, o, text in zip(docs["doc_id"].tolist(), docs["of"].tolist(), docs["text"]):
        text = np.frombuffer(text.encode(), np.uint8)
        gone = np.zeros(len(text), bool)
        if (d, o) in where:
            a, z = where[d, o]
            hit, bit = np.nonzero((own[a:z, None] >> bits) & 1)
            starts = np.unique(pos[a:z][hit] + bit)
            step = np.zeros(len(text) + 1, np.int64)
            step[starts] += 1
            step[starts + WIDTH] -= 1
            gone = np.cumsum(step)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, text[~gone].tobytes(), len(text), int(gone.sum()), spans))
    return pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans for each row of ``docs``.

    A byte goes if some 50-byte string that covers it also starts in a row with a smaller doc_id; strings are judged
    on the input, and overlaps count. Null text is empty. Rows with equal doc_id do not take from each other; rows
    with null doc_id neither lose nor take anything. ``kept`` may be cut inside a UTF-8 character. Empty tables give
    empty results; other columns are ignored.

    Each window of 50 bytes goes to the bucket of its smallest 8-byte seed, together with its neighbours that have
    the same seed: one run of about 70 bytes for 20 windows, compressed per bucket. Copies inside a part of a task
    are decided before the shuffle, so a passage in a large share of all documents reaches its bucket once per part.
    Buckets grow in number with the text. Windows per seed are counted first; those of a seed with too many for a
    bucket are dealt by a second seed as well, and if that does not part them by their own hash. In a bucket, windows whose hash occurs once are done; the rest are suffix
    sorted by compared hashes and checked byte by byte. Decisions go back to groups of documents, dealt by doc_id, as packed bit masks.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    again = rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("again"))
    if again.isEmpty():  # ids alone name the rows; else rows of one id are told apart by their text
        rows = rows.withColumn("of", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("of", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    named = rows.where("doc_id is not null")
    hot = hot_keys(named, size)
    part = named.mapInArrow(partial(_split, buckets=buckets, hot=hot), "bucket long, blob binary")
    groups = buckets | 1

    def decide(bucket: pd.DataFrame) -> pd.DataFrame:
        return _decide(bucket, groups)

    decided = part.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(decide, "g long, marks binary")
    left = rows.where("doc_id is not null").withColumn("g", F.expr(f"pmod(doc_id, {groups})")).repartition(groups, "g").groupBy("g")
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    cut = left.cogroup(decided.repartition(groups, "g").groupBy("g")).applyInPandas(_cut, schema)
    zero = F.lit(0).cast("long")
    rest = rows.where("doc_id is null").select(
        "doc_id", F.col("text").cast("binary").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans")
    )
    return cut.unionByName(rest)


def op5_suffix_dedup(spark, sf_dir):
    from trailmark.llm.common import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
