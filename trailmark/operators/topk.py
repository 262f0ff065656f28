"""Best rows per query as mergeable bounded lists, over tiles of queries and bank rows.

Both sides are dealt to tiles by how many rows of each share a key (a view, or a cell of an index): so many bank rows
and so many queries to a tile at most. A tile keeps one bounded list per query. Lists of one query are merged in two
stages, so that neither the pair table nor all lists of a query meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.vectors import NORM_EPSILON

BANK_TILE = 16_384  # bank rows a task scores against at once
QUERY_TILE = 65_536  # queries that meet one bank tile in one task; they stream through
QUERY_BLOCK = 512  # query lines scored at once, fewer when a tile is large:
BLOCK_SCORES = 1 << 21  # scores of a block
GROUP = 64  # scores whose highest value is looked at first
SCORE_DECIMALS = 9  # equal vectors tie exactly whatever tile they are in

_ENTRY = pa.struct([("s", pa.float64()), ("bank_row", pa.int64()), ("masked", pa.bool_()), ("task", pa.string())])
_ENTRY_SQL = "array<struct<s:double,bank_row:long,masked:boolean,task:string>>"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows; a missing vector is zero and scores 0."""
    flat = column.cast(pa.large_list(pa.float64()))
    present = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
    if not len(present):
        return np.zeros((len(column), 0))
    values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(present), -1)
    out = np.zeros((len(column), values.shape[1]))
    out[present] = values / (np.linalg.norm(values, axis=1, keepdims=True) + NORM_EPSILON)
    return out


class BankTile:
    """Bank rows of one tile, scored against query vectors.

    Scores in single precision say which rows can be among the best; only these are scored in double precision, with a
    margin above the error of the first pass.
    """

    def __init__(self, rows: pa.Table, width: int, min_score: float, per_task: bool) -> None:
        rows = rows.combine_chunks()
        task = [t or f"\0{r}" for t, r in zip(rows["task"].to_pylist(), rows["bank_row"].to_pylist())] if per_task else [None] * len(rows)
        codes = np.unique(np.array(task, object).astype(str), return_inverse=True)[1] if per_task else np.zeros(len(rows), np.int64)
        unit = _matrix(rows["embedding"].combine_chunks())
        order = np.argsort(codes, kind="stable")
        order = order[np.isfinite(unit[order]).all(axis=1)]  # no score of the others is a number
        self.rows, self.codes, self.unit = rows["bank_row"].to_numpy()[order], codes[order], unit[order]
        self.masked = rows["masked"].to_numpy(zero_copy_only=False)[order]
        self.task = [task[i] for i in order]
        self.coarse = np.ascontiguousarray(self.unit.T.astype(np.float32))
        self.margin = 4 * (self.unit.shape[1] + 8) * float(np.finfo(np.float32).eps) + 2 * 10.0**-SCORE_DECIMALS
        self.firsts = np.flatnonzero(np.append(True, np.diff(self.codes) > 0)) if per_task else None
        self.width, self.min_score = width, min_score
        self.block = max(1, min(QUERY_BLOCK, BLOCK_SCORES // max(1, len(order))))

    def _candidates(self, coarse: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and places of all scores that can be among the best of their line."""
        n, m = coarse.shape
        full = m // GROUP * GROUP
        if self.firsts is not None:
            top = np.maximum.reduceat(coarse, self.firsts, axis=1)
        elif full:
            top = coarse[:, :full].reshape(n, -1, GROUP).max(axis=2)
        else:
            top = coarse
        if top.shape[1] > self.width:  # so many rows, of different tasks, score as high as the lowest of these
            least = np.partition(top, top.shape[1] - self.width, axis=1)[:, top.shape[1] - self.width] - self.margin
        else:
            least = np.full(n, -np.inf) if self.firsts is None else top.min(axis=1) - self.margin
        least = np.maximum(least, np.maximum(floor, self.min_score) - self.margin)[:, None]
        if self.firsts is not None or not full:
            return np.nonzero(coarse >= least)
        line, group = np.nonzero(top >= least)
        inside = coarse[:, :full].reshape(n, -1, GROUP)[line, group] >= least[line]
        at, within = np.nonzero(inside)
        rest, place = np.nonzero(coarse[:, full:] >= least)
        return np.append(line[at], rest), np.append(group[at] * GROUP + within, place + full)

    def _entries(self, q: np.ndarray, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines, scores and places in the tile of the best rows of each line, in their order.

        Rows below the ``floor`` of a line may be left out.
        """
        if not len(self.rows) or not len(q):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if not self.unit.shape[1]:
            line, place = (x.ravel() for x in np.indices((len(q), len(self.rows))))
            score = np.zeros(len(line))
        else:
            line, place = self._candidates(q.astype(np.float32) @ self.coarse, floor)
            score = np.empty(len(line))
            for at in range(0, len(line), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[part] = np.einsum("ij,ij->i", q[line[part]], self.unit[place[part]])
            score = np.round(score, SCORE_DECIMALS)
        keep = score >= self.min_score
        line, place, score = line[keep], place[keep], score[keep]
        order = np.lexsort((self.rows[place], -score, line))
        if self.firsts is not None:  # the best row of each task, the lowest of equal ones
            key = line[order] * (len(self.firsts) + 1) + self.codes[place[order]]
            order = order[np.sort(np.unique(key, return_index=True)[1])]
        line, place, score = line[order], place[order], score[order]
        first = np.searchsorted(line, line)
        best = np.arange(len(line)) - first < self.width
        return line[best], score[best], place[best]

    def lists(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, queries.num_rows, self.block):
            block = queries.slice(at, self.block)
            unit = _matrix(block.column("embedding"))
            asks = np.flatnonzero(np.isfinite(unit).all(axis=1))
            line, scores, place = self._entries(unit[asks])
            yield block_lists(block, asks[line], scores, self.rows[place], self.masked[place], [self.task[i] for i in place.tolist()])


def block_lists(block: pa.RecordBatch, line: np.ndarray, scores: np.ndarray, rows: np.ndarray, masked: np.ndarray, task: list) -> pa.RecordBatch:
    """One row per query of a block that has entries, with its list."""
    n = np.bincount(line, minlength=block.num_rows)
    entries = pa.StructArray.from_arrays(
        [pa.array(0.0 - scores), pa.array(rows), pa.array(masked), pa.array(task, pa.string())], fields=list(_ENTRY)
    )
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), entries)
    out = pa.RecordBatch.from_arrays(
        [block.column("query_id"), block.column("view"), block.column("part"), lists], ["query_id", "view", "part", "best"]
    )
    return out.filter(pa.array(n > 0))


class TileRow:
    """Bank tiles that meet the same queries: a query has one list over all of them, merged tile by tile."""

    def __init__(self, rows: pa.Table, size: int, width: int, min_score: float, query_tile: int) -> None:
        self.tiles = [BankTile(rows.slice(at, size), width, min_score, False) for at in range(0, len(rows), size)]
        self.width, self.block = width, min(self.tiles[0].block, query_tile)

    def lists(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, queries.num_rows, self.block):
            block = queries.slice(at, self.block)
            unit = _matrix(block.column("embedding"))
            asks = np.flatnonzero(np.isfinite(unit).all(axis=1))
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))
            found, floor = [best], np.full(len(asks), -np.inf)
            for i, tile in enumerate(self.tiles):
                line, scores, place = tile._entries(unit[asks], floor)
                found.append((line, scores, tile.rows[place], tile.masked[place]))
                if i == len(self.tiles) - 1 or sum(len(f[0]) for f in found) > 3 * self.width * len(asks):
                    best, floor = self._merged(found, floor)
                    found = [best]
            line, scores, rows, masked = best
            yield block_lists(block, asks[line], scores, rows, masked, [None] * len(line))

    def _merged(self, found: list[tuple], floor: np.ndarray) -> tuple[tuple, np.ndarray]:
        """The best of several lists per line, and the lowest score of each full one."""
        line, scores, rows, masked = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rows, -scores, line))
        at = np.arange(len(order)) - np.searchsorted(line[order], line[order])
        last = order[at == self.width - 1]
        floor[line[last]] = scores[last]
        best = order[at < self.width]
        return (line[best], scores[best], rows[best], masked[best]), floor


def _scan(
    batches: Iterator[pa.RecordBatch], width: int, min_score: float, per_task: bool, bank_tile: int, query_tile: int
) -> Iterator[pa.RecordBatch]:
    """Rows come tile by tile, the bank rows of a tile before its queries."""
    tile, bank, ready = None, [], None
    for batch in batches:
        names = batch.column("tile").dictionary_encode()
        code, side = names.indices.to_numpy(), batch.column("side").to_numpy()
        ends = np.append(np.flatnonzero((np.diff(code) != 0) | (np.diff(side) != 0)) + 1, batch.num_rows).tolist()
        for first, end in zip([0, *ends], ends):
            name = names.dictionary[code[first]].as_py() if end > first else None
            if name is None:
                continue
            if name != tile:
                tile, bank, ready = name, [], None
            if side[first] == 0:
                bank.append(batch.slice(first, end - first))
            elif bank:
                if ready is None:
                    rows = pa.Table.from_batches(bank)
                    whole = per_task or len(rows) <= bank_tile
                    ready = BankTile(rows, width, min_score, per_task) if whole else TileRow(rows, bank_tile, width, min_score, query_tile)
                yield from ready.lists(batch.slice(first, end - first))


def _merged(lists: DataFrame, keys: list[str], width: int, per_task: bool) -> DataFrame:
    """One list of the best ``width`` of several; a bank row, or with ``per_task`` a task, counts once."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("best"))))
    merged = lists.groupBy(*keys).agg(every.alias("best"))
    if per_task:
        def first_of_task(best: Column, tasks: Column) -> Column:
            return F.filter(best, lambda x, i: F.array_position(tasks, x["task"]) == i + 1)

        pair = F.struct(F.col("best").alias("b"), F.transform("best", lambda x: x["task"]).alias("t"))
        merged = merged.withColumn("best", F.get(F.transform(F.array(pair), lambda p: first_of_task(p["b"], p["t"])), F.lit(0)))
    return merged.withColumn("best", F.slice("best", 1, width))


def best_rows(
    queries: DataFrame,
    bank: DataFrame,
    by: list[str],
    width: int,
    min_score: float = -math.inf,
    per_task: bool = False,
    bank_tile: int = BANK_TILE,
    query_tile: int = QUERY_TILE,
) -> DataFrame:
    """The best ``width`` bank rows per query and view: ``(query_id, view, bank_row, score, masked)``.

    ``queries`` has ``query_id, view, embedding``, ``bank`` has ``bank_row, embedding, masked`` (and ``task_id`` with
    ``per_task``), both the columns ``by``; a query meets the bank rows with equal values there, all of them
    when ``by`` is empty. Ties go to the lower
    bank row; with ``per_task`` a task gives its best row only. Both sides are read twice, once to count: hand in
    stored tables, not ones that call an encoder.

    A tile holds ``bank_tile`` bank rows and ``query_tile`` queries at most, so a task's memory and work are bounded
    for any number of either and for any share of one key. Rows that leave the tiles: one list per query and bank tile.
    Tiles smaller than the standard ones travel together: as many as make a standard tile are scored one after the
    other in one task, so that rows are not copied for each of them.
    """
    bank_deal, query_deal = (bank_tile, query_tile) if per_task else (max(bank_tile, BANK_TILE), max(query_tile, QUERY_TILE))
    if by:
        sizes = bank.groupBy(*by).agg(F.count(F.lit(1)).alias("_b")).join(queries.groupBy(*by).agg(F.count(F.lit(1)).alias("_q")), by)
        grid = sizes.select(*by, F.ceil(F.col("_b") / bank_deal).alias("_bts"), F.ceil(F.col("_q") / query_deal).alias("_qts"))
        queries, bank = queries.join(grid, by), bank.join(grid, by)
    else:
        counts = {"_bts": max(1, math.ceil(bank.count() / bank_deal)), "_qts": max(1, math.ceil(queries.count() / query_deal))}
        queries, bank = (df.withColumns({c: F.lit(n).cast("long") for c, n in counts.items()}) for df in (queries, bank))

    def tile(bank_no: Column, query_no: Column) -> Column:
        return F.concat_ws("|", *[F.col(c).cast("string") for c in by], bank_no.cast("string"), query_no.cast("string")).alias("tile")

    def dealt(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    kind = queries.schema["query_id"].dataType
    left = queries.withColumn("_bt", every("_bts")).select(
        tile(F.col("_bt"), dealt("query_id", "_qts")), F.lit(1).alias("side"), "query_id", "view", "embedding",
        F.pmod("_bt", F.ceil(F.sqrt("_bts"))).cast("int").alias("part"), F.lit(None).cast("long").alias("bank_row"),
        F.lit(False).alias("masked"), F.lit(None).cast("string").alias("task"),
    )
    right = bank.withColumn("_qt", every("_qts")).select(
        tile(dealt("bank_row", "_bts"), F.col("_qt")), F.lit(0).alias("side"), F.lit(None).cast(kind).alias("query_id"),
        F.lit(None).cast("string").alias("view"), "embedding", F.lit(0).alias("part"), "bank_row", "masked",
        (F.col("task_id") if per_task else F.lit(None).cast("string")).alias("task"),
    )
    schema = T.StructType([
        T.StructField("query_id", kind), T.StructField("view", T.StringType()), T.StructField("part", T.IntegerType()),
        T.StructField("best", T._parse_datatype_string(_ENTRY_SQL)),
    ])
    # by number: scoring is long for the few bytes it reads, tiles must not be merged into few tasks by size
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = left.unionByName(right).repartition(n, "tile").sortWithinPartitions("tile", "side")
    lists = tiles.mapInArrow(partial(_scan, width=width, min_score=min_score, per_task=per_task, bank_tile=bank_tile, query_tile=query_tile), schema)
    some = _merged(lists, ["query_id", "view", "part"], width, per_task)
    best = _merged(some.drop("part"), ["query_id", "view"], width, per_task)
    hit = F.explode("best").alias("_h")
    return best.select("query_id", "view", hit).select(
        "query_id", "view", F.col("_h.bank_row").alias("bank_row"), (F.lit(0.0) - F.col("_h.s")).alias("score"), F.col("_h.masked").alias("masked")
    )
