"""Phrase collocations: prefix-free parsing into overlapping chunks, n-grams counted in distinct chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.bytestext import mix64, text_bytes, word_hashes, words
from trailmark.llm.common import save, whole_text

LONGEST = 4  # words of a phrase
OVERLAP = LONGEST - 1  # words that two chunks share: every phrase lies in one chunk as a whole
MODULUS = 12  # one in so many windows ends a chunk
PART_BYTES = 4 << 20  # text handled at once; a longer piece is handled alone
FILTER_BITS = (1 << 16, 1 << 28)  # least and largest filter; what passes a filter wrongly is counted and dropped later
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BLANKS = re.compile(rb"  +")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _chain(hashes: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word; runs over the end of the array are left out."""
    n = max(0, len(hashes) - k + 1)
    out = mix64(hashes[:n] + step)
    for j in range(1, k):
        out = mix64(out * step + hashes[j : j + n])
    return out


def _parse(blob: bytes, counts: dict[bool, Counter]) -> None:
    """Count the chunks of text whose pieces are lines."""
    data = np.frombuffer(blob, np.uint8)
    line = np.cumsum(data == 10)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    if not len(starts):
        return
    piece = line[starts]
    first = np.ones(len(starts), bool)
    first[1:] = piece[1:] != piece[:-1]
    final = np.append(first[1:], True)
    # a window of OVERLAP words inside one piece, not at its end, whose hash says so, ends a chunk and begins the next
    window = _chain(word_hashes(data, starts, ends), OVERLAP)
    at = np.flatnonzero(window % np.uint64(MODULUS) == 0)
    at = at[piece[at] == piece[at + OVERLAP - 1]]
    at = at[~final[at + OVERLAP - 1]]
    begin = np.concatenate([np.flatnonzero(first), at])
    end = np.concatenate([np.flatnonzero(final), at + OVERLAP - 1])
    begin.sort()
    end.sort()
    last = final[end]
    a, b = starts[begin].tolist(), ends[end].tolist()
    for flag in (True, False):
        counts[flag].update([blob[x:y] for x, y, z in zip(a, b, last.tolist()) if z == flag])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pc.equal(langs.indices, code)).to_pylist()
            counts = {True: Counter(), False: Counter()}
            part, size = [], 0
            for text in texts:
                raw = _BLANKS.sub(b" ", text.encode().translate(_TABLE))
                while len(raw) > PART_BYTES and (cut := raw.find(b"\n", PART_BYTES)) >= 0:
                    _parse(raw[:cut], counts)
                    raw = raw[cut + 1 :]
                part.append(raw)
                size += len(raw)
                if size >= PART_BYTES:
                    _parse(b"\n".join(part), counts)
                    part, size = [], 0
            _parse(b"\n".join(part), counts)
            for last, found in counts.items():
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(list(found), pa.binary()).cast(pa.string()),
                         pa.array([last] * len(found)), pa.array(list(found.values()), pa.int64())],
                        ["lang", "chunk", "last", "n"],
                    )


class Runs:
    """Words of some rows and the hashes of their runs, each with its row's language."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        self.data, offsets = text_bytes(texts)
        self.starts, self.ends, self.row = words(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        coded = langs.dictionary_encode()
        seeds = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
        self.seed = np.array(seeds, np.uint64)[coded.indices.to_numpy()][self.row]

    def keys(self, k: int, step: np.uint64 = _STEP) -> np.ndarray:
        chain = _chain(self.hashes, k, step)
        return mix64(chain ^ self.seed[: len(chain)])


def _bits(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = Runs(batch.column("phrase"), batch.column("lang"))
        keys = runs.keys(k)[np.searchsorted(runs.row, np.arange(batch.num_rows))]
        masks: dict[int, int] = {}
        for key in keys.tolist():
            for bit in (key % bits, (key >> 32) % bits):
                masks[bit >> 6] = masks.get(bit >> 6, 0) | 1 << (bit & 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(masks), pa.int64()), pa.array(np.array(list(masks.values()), np.uint64).view(np.int64))], ["slot", "mask"]
        )


def _filter(grams: DataFrame, k: int) -> np.ndarray:
    """Bit set of phrases of ``k`` words: it holds each of them, and few others. Its size is bounded by FILTER_BITS."""
    wanted = max(FILTER_BITS[0], 16 * grams.count())
    bits = min(FILTER_BITS[1], 1 << (wanted - 1).bit_length())
    masks = grams.select("lang", "phrase").mapInArrow(partial(_bits, k=k, bits=bits), "slot long, mask long")
    found = masks.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _held(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(filter_) << 6)
    found = np.ones(len(keys), bool)
    for bit in (keys % bits, (keys >> np.uint64(32)) % bits):
        found &= (filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def _grams(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], filter_: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of ``sizes`` words of some distinct chunks with their weighted counts, equal ones added up.

    A phrase counts in the chunk in which it starts before the shared words, so that those count once. With a filter
    of phrases one word shorter than the least size, only phrases all of whose such parts pass it are counted.
    """

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, weight, last = (rows.column(c).combine_chunks() for c in ("lang", "n", "last"))
        runs = Runs(rows.column("chunk").combine_chunks(), langs)
        weight, last = weight.to_numpy(), last.to_numpy(zero_copy_only=False)
        row, n = runs.row, len(runs.row)
        stop = np.searchsorted(row, np.arange(rows.num_rows), "right")  # end of each row's words
        starts_here = last[row] | (np.arange(n) < stop[row] - OVERLAP)
        part = sizes[0] - 1
        passed = _held(filter_, runs.keys(part)) if filter_ is not None else None
        for k in sizes:
            m = max(0, n - k + 1)
            at = starts_here[:m] & (stop[row[:m]] >= np.arange(m) + k)
            if passed is not None:
                for j in range(k - part + 1):
                    at &= passed[j : j + m]
            at = np.flatnonzero(at)
            if not len(at):
                continue
            key, other = runs.keys(k)[at], runs.keys(k, _OTHER)[at]
            order = np.argsort(key)
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1])
            if (other[order][1:] != other[order][:-1])[~new[1:]].any():  # two phrases with one hash
                order = np.lexsort((other, key))
                new[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(weight[row[at[order]]], first)
            place = at[order[first]]
            data = runs.data.tobytes()
            phrases = [data[a:b] for a, b in zip(runs.starts[place].tolist(), runs.ends[place + k - 1].tolist())]
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(row[place])), pa.array(phrases, pa.binary()).cast(pa.string()),
                 pa.array(np.full(len(place), k, np.int32)), pa.array(total)],
                ["lang", "phrase", "k", "n"],
            )

    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column("chunk").nbytes
        if size >= PART_BYTES:
            yield from counted(pa.Table.from_batches(waiting))
            waiting, size = [], 0
    if waiting:
        yield from counted(pa.Table.from_batches(waiting))


def parse(docs: DataFrame) -> DataFrame:
    """lang, chunk, last, n: the dictionary of distinct chunks of each language and how often the parse uses them.

    Pieces between ``.,;:!?`` and line ends are parsed one by one; words are what blanks and tabs divide. A window of
    ``OVERLAP`` words whose hash is 0 modulo ``MODULUS`` ends a chunk and begins the next one, so that equal passages
    are cut into equal chunks wherever they stand. ``last`` tells that the chunk ends its piece.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text(docs).alias("text"))
    chunks = rows.mapInArrow(_chunks, "lang string, chunk string, last boolean, n long")
    return chunks.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def count_phrases(chunks: DataFrame, sizes: tuple[int, ...], filter_: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, k, n: occurrences of phrases of ``sizes`` words in a parse."""
    found = chunks.mapInArrow(partial(_grams, sizes=sizes, filter_=filter_), "lang string, phrase string, k int, n long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _part(first: int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", F.lit(first), n if isinstance(n, Column) else F.lit(n)), " ")


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of 2 to 4 words of each language.

    A phrase of ``min_count`` or more occurrences a is cut after each of its words but the last; l and r count the
    first and the second part, its score is floor(2,000,000 a / (l + r)), and the cut of the lowest score counts, the
    earliest of equal ones. Phrases inside a longer one with 0.8 a occurrences or more are dropped. n counts all words
    of the language. Order: score and a descending, phrase ascending in UTF-8.

    A null lang is ``und``; null and empty texts, and texts of separators alone, have no words. Each row counts, also
    repeated rows; ids and other columns are ignored; an empty table gives no rows. A very long text is parsed in
    parts that end at a separator. Arithmetic is in decimals.

    Texts are parsed once into chunks (``parse``); words, then pairs, then longer phrases are counted in distinct
    chunks, weighted by their frequency. All parts of a candidate are as frequent as it is, so the pairs need only be
    counted where both words are frequent, and the longer ones where all pairs are. Sets of frequent words and pairs
    go to the tasks as bit sets of bounded size, which let some others pass: those are counted like all and then fall
    under ``min_count``.
    """
    chunks = save(parse(docs))
    every = save(count_phrases(chunks, (1,)))
    often = F.col("n") >= min_count
    single = every.where(often)
    double = save(count_phrases(chunks, (2,), _filter(single, 1)).where(often))
    longer = save(count_phrases(chunks, tuple(range(3, LONGEST + 1)), _filter(double, 2)).where(often))
    found = single.unionByName(double).unionByName(longer)
    candidates = double.unionByName(longer).select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "k", "a", "cut", _part(1, F.col("cut")).alias("left"),
                     F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("right"))
    left = found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cut = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    spans = [(first, n) for n in range(2, LONGEST) for first in range(1, LONGEST - n + 2)]
    inner = F.array(*(F.when(F.col("k") >= F.greatest(F.lit(first + n - 1), F.lit(n + 1)), _part(first, n)) for first, n in spans))
    inside = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(F.array_compact(inner))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * 80))

    ranks = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(ranks).cast("long")).where(F.col("rank") <= top)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    return kept.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )


def op12_collocations(spark, sf_dir):
    from trailmark.llm.common import table

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30
), cuts AS (
  SELECT *, unnest(range(1, k)) AS cut FROM candidates
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.n AS l, y.n AS r,
         CAST((2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2
), kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""
