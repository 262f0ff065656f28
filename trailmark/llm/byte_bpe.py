"""Byte-level BPE: ranked merges folded by Spark over the byte arrays of distinct words; decoding joins binary pieces."""

from __future__ import annotations

import base64
import heapq
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.blobs import joined, pack_arrays, planes, unpack_arrays
from trailmark.llm.common import partitions, save, save_by, whole_text

BLOCK_BYTES = 32 << 20  # text whose words share one dictionary; a longer text is a block of its own
DOCS_PER_ROW = 512
ERA = 256  # tasks whose uses of one word are listed together; bounds that list for any amount of text
LONG_WORD = 1024  # bytes; the fold is quadratic in a word's length, longer words are merged by a heap
BUCKETS = 1 << 16
PACK_BYTES = 8 << 20  # uses of words that are packed at once on their way back to the blocks


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The ranks as one value: maps of some pieces each, by their checksum, since a map is searched from its start.

    A scalar subquery over one row: Spark puts it into the plan as a literal when it runs, so that no step of the
    optimizer has to walk through the map.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS][piece.hex().upper()] = rank
    kind = pa.list_(pa.map_(pa.string(), pa.int32()))
    one = pa.table({"ranks": pa.array([[list(b.items()) for b in buckets]], kind)})
    return save(spark.createDataFrame(one)).scalar()


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of a binary word by a rank map: its bytes are merged pair by pair, the lowest rank first, until no pair has a rank.

    A step merges every pair of the lowest rank, from the left and without overlaps. That equals one merge at a time:
    a pair that comes up later, around the merged piece, has a higher rank.
    """

    def rank(piece: Column) -> Column:
        return F.element_at(F.get(table, (F.crc32(piece) % BUCKETS).cast("int")), F.hex(piece))

    def ranks_of(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        return F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), rest, lambda a, b: rank(F.concat(a, b)))

    def merged(pieces: Column, marks: Column) -> Column:
        """``marks``: 1 where a piece takes in the next one, 2 where it is taken in and would have had the same rank."""
        places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | (F.get(marks, i - 1) != "1"))
        both = lambda i: F.concat(F.get(pieces, i), F.get(pieces, i + 1))
        return F.transform(places, lambda i: F.when(F.get(marks, i) == "1", both(i)).otherwise(F.get(pieces, i)))

    def merge(state: Column, lowest: Column) -> Column:
        flags = F.array_join(F.transform(state["r"], lambda x: F.when(x == lowest, "1").otherwise("0")), "")
        marks = F.split(F.replace(flags, F.lit("11"), F.lit("12")), "")
        next_ = _let(marks, lambda m: merged(state["p"], m))
        return _let(next_, lambda p: F.struct(p.alias("p"), ranks_of(p).alias("r")))

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state["r"]), lambda m: F.when(m.isNull(), state).otherwise(merge(state, m)))

    bytes_ = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    start = _let(bytes_, lambda p: F.struct(p.alias("p"), ranks_of(p).alias("r")))
    steps = F.sequence(F.lit(1), F.length(word))
    return F.aggregate(steps, start, step, lambda s: F.transform(s["p"], rank))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for one word of any length, in n log n."""
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    before, after = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(pieces) and (r := ranks.get(pieces[i] + pieces[j])) is not None:
            heapq.heappush(heap, (r, i, len(pieces[i]), len(pieces[j])))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if pieces[i] is None or len(pieces[i]) != a or j >= len(pieces) or len(pieces[j]) != b:
            continue  # one of the two has been merged since
        pieces[i], pieces[j] = pieces[i] + pieces[j], None
        after[i] = after[j]
        if after[j] < len(pieces):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in pieces if p is not None]


def _heap_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    ranks = read_ranks(path)
    for batch in batches:
        ids = pa.array([heap_merges(w, ranks) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("uses"), ids], ["uses", "ids"])


def _words(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of some documents as numbers in their block's dictionary; the block's last row has the dictionary."""
    import regex

    split = regex.compile(pattern).findall
    task, number, size = TaskContext.get().partitionId(), 0, 0
    words: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    doc_ids, lengths, places = [], [], []

    def row(last: bool) -> pa.RecordBatch:
        blob = pack_arrays(planes(np.concatenate([np.zeros(0, np.uint32), *places])).ravel(), level=3)
        known = [[w.encode() for w in words]] if last else [None]
        out = [pa.array([(task << 32) + number]), pa.array([list(doc_ids)], pa.list_(pa.int64())),
               pa.array([list(lengths)], pa.list_(pa.int32())), pa.array([blob], pa.binary()), pa.array(known, pa.list_(pa.binary()))]
        for x in (doc_ids, lengths, places):
            x.clear()
        return pa.RecordBatch.from_arrays(out, ["block", "doc_ids", "lengths", "places", "words"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            found = split(text)
            doc_ids.append(doc_id)
            lengths.append(len(found))
            places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield row(True)
                words = defaultdict(itertools.count().__next__)
                number, size = number + 1, 0
            elif len(doc_ids) == DOCS_PER_ROW:
                yield row(False)
    yield row(True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses of words and their ids, as one value for each block of some thousand words."""

    def pack(rows: pa.Table) -> pa.RecordBatch:
        uses, ids = (rows.column(c).combine_chunks() for c in ("uses", "ids"))
        word = pc.list_parent_indices(uses).to_numpy()
        block, place = (uses.flatten().field(i).to_numpy() for i in (0, 1))
        size = pc.list_value_length(ids).to_numpy().astype(np.int64)
        first, flat = np.cumsum(size) - size, ids.flatten().to_numpy().astype(np.uint32)
        order = np.lexsort((place, block))
        block, place, word = block[order], place[order], word[order]
        bounds = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)).tolist()
        blobs = []
        for x, y in zip(bounds, bounds[1:]):
            n = size[word[x:y]]
            own = flat[_ranges(first[word[x:y]], n)]
            blobs.append(pack_arrays(*(planes(v.astype(np.uint32)).ravel() for v in (place[x:y], n, own)), level=3))
        return pa.RecordBatch.from_arrays([pa.array(block[bounds[:-1]]), pa.array(blobs, pa.binary())], ["of_block", "known"])

    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield pack(pa.Table.from_batches(waiting))
            waiting, size = [], 0
    if sum(b.num_rows for b in waiting):
        yield pack(pa.Table.from_batches(waiting))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))


def _assemble(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Ids of each document of a block from the ids of its words."""
    parts = [[joined(x.reshape(4, -1), np.uint32) for x in unpack_arrays(blob)] for blob in known.column("known").to_pylist()]
    place, n, flat = (np.concatenate([np.zeros(0, np.uint32), *(p[i] for p in parts)]).astype(np.int64) for i in range(3))
    sizes, first = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    sizes[place], first[place] = n, np.cumsum(n) - n
    flat = flat.astype(np.int32)
    doc_ids, values, ends = [], [], [np.zeros(1, np.int64)]
    total = 0
    for row in docs.to_pylist():
        places = joined(unpack_arrays(row["places"])[0].reshape(4, -1), np.uint32)
        n = sizes[places]
        values.append(flat[_ranges(first[places], n)])
        stops = np.append(0, np.cumsum(n))[np.cumsum(row["lengths"], dtype=np.int64)]
        ends.append(total + stops)
        total += len(values[-1])
        doc_ids += row["doc_ids"]
    ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate(ends)), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids.cast(pa.list_(pa.int32()))})


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, as a byte-level BPE of these ranks gives them.

    The text is cut into the matches of ``pattern``, which are encoded one by one, without special tokens. Null and
    empty texts have no ids. Rows are encoded one by one, also those that share an id or have none; other columns are
    ignored; an empty table gives no rows. A very long text is one block with its own dictionary, a very long word is
    merged by a heap.

    A task numbers the distinct words of its documents and writes the documents as numbers. Each distinct word is then
    shuffled once, folded once, and its ids go back to the blocks that use it. How many uses are listed in a row is
    bounded by ``ERA`` tasks. Texts are read once and never shuffled: the table of blocks is bucketed by block, only the
    packed ids of its words come to it.
    """
    spark, ranks = docs.sparkSession, read_ranks(ranks_path)
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    blocks = save_by(rows.mapInArrow(
        partial(_words, pattern=pattern),
        "block long, doc_ids array<long>, lengths array<int>, places binary, words array<binary>",
    ), "block")
    uses = blocks.where("words is not null").select("block", F.posexplode("words").alias("place", "word"))
    era = F.floor(F.shiftright("block", 32) / ERA).cast("int")
    uses = uses.select("word", era.alias("era"), "block", "place")
    # by number: the folds are long for the few bytes they read, tasks must not be merged by size
    uses = uses.repartition(partitions(spark), "word", "era")
    distinct = uses.groupBy("word", "era").agg(F.collect_list(F.struct("block", "place")).alias("uses"))
    distinct = distinct.select("word", "uses")
    short = distinct.where(F.length("word") <= LONG_WORD).withColumn("ranks", _rank_map(spark, ranks))
    short = short.select("uses", _let(F.col("ranks"), lambda t: fold_merges(F.col("word"), t)).alias("ids"))
    long = distinct.where(F.length("word") > LONG_WORD).mapInArrow(
        partial(_heap_ids, path=ranks_path), "uses array<struct<block:long,place:int>>, ids array<int>"
    )
    known = short.unionByName(long).mapInArrow(_packed, "of_block long, known binary")
    texts = blocks.select("block", "doc_ids", "lengths", "places")
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of an array of ids: their pieces, one after the other. An unknown id adds nothing; null stays null."""
    ranks = read_ranks(ranks_path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from trailmark.llm.common import table

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
