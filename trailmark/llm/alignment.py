"""Alignment of two tokenizations by merge-path partitioning of their byte ends, with corpus-wide link counts."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.blobs import joined, pack_arrays, planes, unpack_arrays
from trailmark.llm.bytestext import mix64, powers
from trailmark.llm.common import save, whole_text

BLOCK_BYTES = 16 << 20  # text whose chunks, groups and links are numbered together; a longer text is a block of its own
DOCS_PER_ROW = 256
CHUNKS_AT_ONCE = 4096  # a tokenizer's own result is some hundred times its text
WORK = 1 << 16  # ends that one piece of the merge holds
WIDE_GROUP = 1 << 16  # links of a group from which equal ids are counted before they are paired
# A text is cut before a blank that follows a character which is neither white space nor could become it. Neither
# tokenizer joins across such a place: the first starts a token there, the second has no piece with an inner blank.
_CHUNK = re.compile(r" +(?:[^ ]+(?:(?<![!-~À-ɏ]) +[^ ]*)*)?")


@dataclass
class Vocabularies:
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_text: list[bytes]  # decimal id and separator: "," then "|"
    b_text: list[bytes]  # "," then ";"
    blank: int  # B's piece of one blank


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes as they are, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Vocabularies:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    letters = _byte_letters()
    a_bytes = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab().items():
        a_bytes[i] = bytes(letters.get(c, 0) for c in token)
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("the second vocabulary joins words: texts cannot be cut at blanks")
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    text = [[b"%d%s" % (i, s) for s in seps for i in range(n)] for n, seps in ((len(a_bytes), (b",", b"|")), (len(b_bytes), (b",", b";")))]
    return Vocabularies(a, b, a_bytes, b_bytes, *text, b.piece_to_id("▁"))


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending arrays crosses every ``work``-th diagonal: entries of ``a`` and ``b`` before it.

    Equal ends are merged with ``a`` first. All diagonals are searched at once, in log steps.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work, dtype=np.int64), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        take = np.zeros(len(d), bool)
        take[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        lo = np.where(open_ & take, mid + 1, lo)
        hi = np.where(open_ & ~take, mid, hi)
    return lo, d - lo


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of ``a`` and ``b`` that end a group inside one piece of the merge."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = np.flatnonzero(b[at] == a)
    return same, at[same]


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the entries that ``a`` and ``b`` share, piece by piece.

    Each piece of the merge is handled by itself; only an end whose two entries lie on both sides of a diagonal is
    left to the seam of two pieces.
    """
    i, j = diagonals(a, b, work)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(i) - 1):
        if k and i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:
            found_a.append(i[k : k + 1] - 1)
            found_b.append(j[k : k + 1])
        x, y = overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        found_a.append(x + i[k])
        found_b.append(y + j[k])
    return np.concatenate(found_a), np.concatenate(found_b)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. n[0] of them, then those from first[1]."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))


def _sequence_hash(ids: np.ndarray, first: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    inside = np.arange(len(ids)) - np.repeat(first, n)
    value = mix64(ids.astype(np.uint64) + np.uint64(seed)) * powers(int(n.max(initial=1)))[inside]
    sums = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
    return sums[first + n] - sums[first]


def _distinct_groups(a, b, a_first, a_n, b_first, b_n) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct group, and the number of each group's representative."""
    for seed in range(1, 1 << 20):
        keys = [mix64(_sequence_hash(a, a_first, a_n, s) + mix64(_sequence_hash(b, b_first, b_n, s + 1))) for s in (seed, seed + 7919)]
        _, first, number = np.unique(keys[0], return_index=True, return_inverse=True)
        if (keys[1][first][number] == keys[1]).all() and (a_n[first][number] == a_n).all() and (b_n[first][number] == b_n).all():
            return first, number
    raise ValueError("groups could not be told apart")


def _group_links(a, b, a_first, a_n, b_first, b_n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id pair (a << 32 | b) and occurrences of each distinct link of each group."""
    wide = a_n * b_n >= WIDE_GROUP
    n = np.where(wide, 0, a_n * b_n)
    group = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pair = (a[a_first[group] + inside // b_n[group]].astype(np.int64) << 32) | b[b_first[group] + inside % b_n[group]]
    groups, pairs, times = [group], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(wide):
        x, cx = np.unique(a[a_first[g] : a_first[g] + a_n[g]], return_counts=True)
        y, cy = np.unique(b[b_first[g] : b_first[g] + b_n[g]], return_counts=True)
        pairs.append(((x.astype(np.int64) << 32)[:, None] | y[None, :]).ravel())
        times.append((cx[:, None] * cy[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    group, pair, times = np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)
    order = np.lexsort((pair, group))
    group, pair, times = group[order], pair[order], times[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])
    starts = np.flatnonzero(new)
    return group[starts], pair[starts], np.add.reduceat(times, starts) if len(starts) else times


def _pack(x: np.ndarray, dtype: type) -> bytes:
    return pack_arrays(planes(x.astype(dtype)).ravel(), level=3)


def _unpack(blob: bytes, dtype: type) -> np.ndarray:
    return joined(unpack_arrays(blob)[0].reshape(np.dtype(dtype).itemsize, -1), dtype)


class Block:
    """Documents as numbers of chunks; when the block is full its chunks are tokenized and aligned, each once."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.chunks: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.doc_ids: list[int | None] = []
        self.places: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        found = _CHUNK.findall(" " + text) if text else []
        self.doc_ids.append(doc_id)
        self.places.append(np.fromiter(map(self.chunks.__getitem__, found), np.uint32, len(found)))
        self.size += len(text)

    def tokens(self, v: Vocabularies) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of all chunks and how many each has, for A and B, none where the bytes of the ids are not the chunk's;
        and which chunks those are."""
        chunks = list(self.chunks)
        wrong = np.zeros(len(chunks), bool)
        ids, sizes = ([], []), ([], [])
        for at in range(0, len(chunks), CHUNKS_AT_ONCE):
            some = chunks[at : at + CHUNKS_AT_ONCE]
            a = [e.ids for e in v.a.encode_batch_fast(some, add_special_tokens=False)]
            b = v.b.encode([c[1:] for c in some], num_threads=1)
            for k, c in enumerate(some):
                if c == " ":
                    b[k] = [v.blank]
                raw = c.encode()
                if b"".join(map(v.a_bytes.__getitem__, a[k])) != raw or b"".join(map(v.b_bytes.__getitem__, b[k])) != raw:
                    wrong[at + k], a[k], b[k] = True, [], []
            for side, lists in enumerate((a, b)):
                ids[side].append(np.fromiter(itertools.chain.from_iterable(lists), np.int64))
                sizes[side].append(np.fromiter(map(len, lists), np.int64, len(lists)))
        none = [np.zeros(0, np.int64)]
        return [np.concatenate(none + x) for x in ids], [np.concatenate(none + x) for x in sizes], wrong

    def rows(self, v: Vocabularies, digest: bool) -> Iterator[dict]:
        ids, sizes, wrong = self.tokens(v)
        n_chunks = len(wrong)
        first = [np.append(0, np.cumsum(n)) for n in sizes]
        ends = [np.cumsum(np.array([len(x) for x in known], np.int64)[flat]) for flat, known in zip(ids, (v.a_bytes, v.b_bytes))]
        (a, b), (a_chunk, b_chunk) = ids, first
        cut_a, cut_b = common_ends(*ends)
        a_first, b_first = np.append(0, cut_a[:-1] + 1)[: len(cut_a)], np.append(0, cut_b[:-1] + 1)[: len(cut_b)]
        a_n, b_n = cut_a + 1 - a_first, cut_b + 1 - b_first
        chunk_groups = np.searchsorted(cut_a, a_chunk[1:] - 1, "right")  # groups up to each chunk's end
        chunk_groups = np.append(0, np.maximum.accumulate(np.where(a_chunk[1:] > 0, chunk_groups, 0)))
        links = np.append(0, np.cumsum(a_n * b_n))

        # texts: a group's A ids, then its B ids
        a_code, b_code = a.copy(), b + (1 << 32)
        a_code[cut_a] += len(v.a_bytes)
        b_code[cut_b] += len(v.b_bytes)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(b_first, a_n)] = a_code
        code[np.arange(len(b)) + np.repeat(a_first + a_n, b_n)] = b_code
        bounds, texts = a_chunk + b_chunk, []
        for at in range(0, n_chunks, CHUNKS_AT_ONCE):
            some = bounds[at : at + CHUNKS_AT_ONCE + 1]
            text = [v.b_text[c - (1 << 32)] if c >> 32 else v.a_text[c] for c in code[some[0] : some[-1]].tolist()]
            some = (some - some[0]).tolist()
            texts += [b"".join(text[x:y]) for x, y in zip(some, some[1:])]
        del code, a_code, b_code

        distinct, number = _distinct_groups(a, b, a_first, a_n, b_first, b_n)
        of, pair, times = _group_links(a, b, a_first[distinct], a_n[distinct], b_first[distinct], b_n[distinct])
        pairs, of_pair = np.unique(pair, return_inverse=True)
        link_first = np.searchsorted(of, np.arange(len(distinct) + 1))
        held = np.zeros(len(pairs), np.int64)

        per_chunk = [np.diff(x) for x in (a_chunk, b_chunk, chunk_groups, links[chunk_groups])]
        for at in range(0, len(self.doc_ids), DOCS_PER_ROW):
            places = self.places[at : at + DOCS_PER_ROW]
            lengths = np.array([len(p) for p in places])
            bad = np.array([bool(wrong[p].any()) for p in places])
            doc = np.repeat(np.arange(len(places)), np.where(bad, 0, lengths))
            flat = np.concatenate([np.zeros(0, np.int64), *(p for p, x in zip(places, bad) if not x)]).astype(np.int64)
            sums = [np.bincount(doc, x[flat], len(places)).astype(np.int64).tolist() for x in per_chunk] if n_chunks else [[0] * len(places)] * 4
            shown = [b"" if x else b"".join(map(texts.__getitem__, p.tolist()))[:-1] for p, x in zip(places, bad)]
            shown = [hashlib.sha256(x).hexdigest() if x and digest else x.decode() for x in shown]
            n = (chunk_groups[1:] - chunk_groups[:-1])[flat]
            key = (np.repeat(doc, n) << 32) | number[_ranges(chunk_groups[flat], n)]
            key, times_in_doc = np.unique(key, return_counts=True)
            owner, used = key >> 32, key & 0xFFFFFFFF
            n = (link_first[1:] - link_first[:-1])[used]
            seen = np.unique((np.repeat(owner, n) << 32) | of_pair[_ranges(link_first[used], n)])
            held += np.bincount(seen & 0xFFFFFFFF, minlength=len(pairs))
            yield {
                "block": self.number, "doc_ids": self.doc_ids[at : at + DOCS_PER_ROW], "sums": sums, "groups": shown,
                "lengths": np.bincount(owner, minlength=len(places)).tolist(),
                "used": _pack(used, np.uint32), "times": _pack(times_in_doc, np.uint32),
            }
        yield {
            "block": self.number, "pairs": pairs.tolist(), "held": held.tolist(),
            "group_links": _pack(np.diff(link_first), np.uint32), "link_pairs": _pack(of_pair, np.uint32), "link_times": _pack(times, np.uint64),
        }


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sums", pa.list_(pa.list_(pa.int64()))), ("groups", pa.list_(pa.string())),
    ("lengths", pa.list_(pa.int32())), ("used", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())),
    ("held", pa.list_(pa.int64())), ("group_links", pa.binary()), ("link_pairs", pa.binary()), ("link_times", pa.binary()),
])
_BLOCKS_SQL = (
    "block long, doc_ids array<long>, sums array<array<long>>, groups array<string>, lengths array<int>, used binary, times binary, "
    "pairs array<long>, held array<long>, group_links binary, link_pairs binary, link_times binary"
)


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    v = load(a_path, b_path)
    task, block = TaskContext.get().partitionId() << 32, None
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            block = block or Block(task)
            block.add(doc_id, text.as_py())
            if block.size >= BLOCK_BYTES:
                for row in block.rows(v, digest):
                    yield pa.RecordBatch.from_pylist([row], _BLOCKS)
                task, block = task + 1, None
    if block:
        for row in block.rows(v, digest):
            yield pa.RecordBatch.from_pylist([row], _BLOCKS)


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])


def _counted(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Link counts of each document of a block from the corpus-wide counts of the block's pairs."""
    parts = rows.to_pylist()
    table = next(r for r in parts if r["group_links"] is not None)
    n = _unpack(table["group_links"], np.uint32).astype(np.int64)
    place = known.column("place").to_numpy()
    values = np.zeros((2, len(place)), np.int64)
    values[0, place] = known.column("n").to_numpy()
    values[1, place] = known.column("best").to_numpy(zero_copy_only=False)
    times = _unpack(table["link_times"], np.uint64).astype(np.int64)
    of_pair = _unpack(table["link_pairs"], np.uint32).astype(np.int64)
    bounds = np.append(0, np.cumsum(n))
    group = []
    for x in values:
        sums = np.append(0, np.cumsum(x[of_pair] * times))
        group.append(sums[bounds[1:]] - sums[bounds[:-1]])
    out = []
    for r in parts:
        if r["doc_ids"] is None:
            continue
        used, often = _unpack(r["used"], np.uint32).astype(np.int64), _unpack(r["times"], np.uint32).astype(np.int64)
        ends = np.append(0, np.cumsum(np.array(r["lengths"], np.int64)))
        both = []
        for x in group:
            sums = np.append(0, np.cumsum(x[used] * often))
            both.append((sums[ends[1:]] - sums[ends[:-1]]).tolist())
        out.append(pa.table([r["doc_ids"], *r["sums"], both[1], both[0], r["groups"]], schema=_OUT))
    return pa.concat_tables(out)


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (or their SHA-256) of each row.

    A is a byte-level vocabulary and reads a blank and the text, B a vocabulary of pieces that adds the blank itself.
    Byte offsets where tokens of both end cut them into groups; all A-B pairs of a group are linked. A pair's count is
    the number of rows that hold it linked; ``n_best`` counts the links whose count is the highest of their A id, ties
    included, ``count_sum`` adds the counts of all links. ``groups`` reads ``a1,a2|b1;a3|b2,b3``.

    Texts that are null, empty, or not given back by the tokens of both vocabularies have no tokens: zeros and ''.
    Each row counts as a document, also repeated rows and those with equal or no ids. Other columns are ignored; an
    empty table gives no rows. A very long text is a block of its own.

    A task cuts its texts into chunks that no token crosses and numbers them. The distinct chunks of a block are
    tokenized and their ends merged in pieces of equal work (``common_ends``). Documents are kept as numbers of groups
    with their frequencies, groups as numbers of pairs. Only a block's distinct pairs are shuffled to be counted, and
    their counts go back to the blocks.
    """
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    blocks = save(rows.mapInArrow(partial(_aligned, a_path=a_path, b_path=b_path, digest=digest), _BLOCKS_SQL))
    pair = F.explode(F.arrays_zip("pairs", "held"))
    held = blocks.where("pairs is not null").select(pair.alias("x")).select("x.pairs", "x.held")
    counts = held.groupBy("pairs").agg(F.sum("held").alias("n"))
    counts = save(counts.select("pairs", F.shiftright("pairs", 32).alias("a"), "n"))
    counts = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    uses = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pairs"))
    known = uses.join(counts, "pairs").select(F.col("block").alias("of_block"), "place", "n", "best")
    texts = blocks.drop("pairs", "held")
    out = texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        _counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return out


def op11_alignment(spark, sf_dir):
    import public_tokenizers

    from trailmark.llm.common import table

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), a, b, digest=True).withColumnRenamed("groups", "groups_sha256")
