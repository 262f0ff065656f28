"""Large single files read by many tasks: arrays by ranges of rows, JSON lists by ranges of bytes.

Both are Python data sources that list files and headers once and read each range in a task of its own. Files are
reached through ``pyarrow.fs``: local and shared folders, and the stores it has a driver for.
"""

from __future__ import annotations

import fnmatch
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The worker that plans a read does not see files added to the session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20
JSON_BYTES = 2 << 20  # of a JSON list; outlining a range takes some hundred bytes of memory per byte
BATCH_ROWS = 10_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(pattern: str) -> list[tuple[str, int]]:
    """Files that match a pattern in their last part, with their size."""
    store, path = _store(pattern)
    folder, _, last = path.rpartition("/")
    if not any(c in last for c in "*?["):
        info = store.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(pattern)
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last))


def _bytes(pattern: str, path: str, first: int, n: int) -> bytes:
    with _store(pattern)[0].open_input_file(path) as f:
        return f.read_at(n, first)


def _stem(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


@dataclass
class Rows(InputPartition):
    path: str
    at: int  # byte of the first row
    first: int
    n: int
    width: int
    dtype: str


@dataclass
class Range(InputPartition):
    path: str
    number: int
    first: int
    n: int


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in _files(self.pattern):
            head = io.BytesIO(_bytes(self.pattern, path, 0, min(size, 1 << 16)))
            version = np.lib.format.read_magic(head)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, by_column, dtype = read(head)
            if by_column and len(shape) > 1 or dtype.hasobject or len(shape) > 2:
                raise ValueError(f"{path} is no table of numbers stored by rows")
            width = shape[1] if len(shape) == 2 else 1
            step = max(1, self.range_bytes // max(1, width * dtype.itemsize))
            for first in range(0, shape[0], step):
                at = head.tell() + first * width * dtype.itemsize
                out.append(Rows(path, at, first, min(step, shape[0] - first), width, dtype.str))
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(part.dtype)
        for at in range(0, part.n, BATCH_ROWS):
            n, row = min(BATCH_ROWS, part.n - at), part.width * dtype.itemsize
            flat = np.frombuffer(_bytes(self.pattern, part.path, part.at + at * row, n * row), dtype).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(flat))
            number = pa.array(np.arange(part.first + at, part.first + at + n))
            yield pa.RecordBatch.from_arrays([pa.array([_stem(part.path)] * n), number, rows], ["name", "bank_row", "embedding"])


class ArrayRanges(DataSource):
    """Rows of ``.npy`` files: ``name, bank_row, embedding``."""

    @classmethod
    def name(cls) -> str:
        return "array_ranges"

    def schema(self) -> str:
        return "name string, bank_row long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self.options)


class _ByteReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [
            Range(path, i, first, min(self.range_bytes, size - first))
            for path, size in _files(self.pattern) for i, first in enumerate(range(0, size, self.range_bytes))
        ]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        data = _bytes(self.pattern, part.path, part.first, part.n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.path]), pa.array([part.number], pa.int32()), pa.array([data], pa.binary())], ["file", "number", "data"]
        )


class ByteRanges(DataSource):
    """Bytes of files: ``file, number, data``, one row per range."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "file string, number int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _ByteReader(self.options)


def _ranges(spark: SparkSession, source: type[DataSource], path: str, range_bytes: int) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("rangeBytes", range_bytes).load(path)


def read_arrays(spark: SparkSession, pattern: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``name, bank_row, embedding`` of all ``.npy`` files of a pattern; a file is read by as many tasks as it has ranges."""
    return _ranges(spark, ArrayRanges, pattern, range_bytes)


def write_arrays(rows: DataFrame, folder: str, dtype: str = "<f4") -> int:
    """Write ``name, bank_row, embedding`` as ``<folder>/<name>.npy``, rows in order, and return the number of rows.

    An array file has one writer, which streams through its sorted rows. All vectors of a name have one length; rows
    without vector are not taken.
    """
    # dealt by a column of its own: rows that a join or aggregate has dealt by name already would not be dealt again, and
    # such a join may change its ways while it runs, which gives a file several writers
    kept = rows.where(F.col("embedding").isNotNull())
    shape = kept.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("embedding")).alias("_width"))
    dealt = kept.join(shape, "name").withColumn("_writer", F.xxhash64("name")).repartition("_writer").drop("_writer")
    ordered = dealt.sortWithinPartitions("name", "bank_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, out, written = None, None, 0
        for batch in batches:
            flat = batch.column("embedding").cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False)
            names, widths = batch.column("name").to_pylist(), batch.column("_width").to_pylist()
            ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]] + ([len(names)] if names else [])
            at = 0
            for first, end in zip([0, *ends], ends):
                if names[first] != name:
                    if out:
                        out.close()
                    name = names[first]
                    out = store.open_output_stream(f"{root}/{name}.npy")
                    n, width = batch.column("_n")[first].as_py(), widths[first]
                    head = io.BytesIO()
                    shape = (n,) if dtype == "|b1" else (n, width)
                    np.lib.format.write_array_header_1_0(head, {"descr": dtype, "fortran_order": False, "shape": shape})
                    out.write(head.getvalue())
                size = (end - first) * widths[first]
                out.write(flat[at : at + size].astype(dtype).tobytes())
                at, written = at + size, written + end - first
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([written])], ["n"])

    return ordered.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_json_list(rows: DataFrame, path: str) -> None:
    """Write ``position, raw`` (JSON texts) as one file with one JSON list, in order; one task streams through the rows."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = _store(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        n = 0
        with store.open_output_stream(name) as out:
            out.write(b"[")
            for batch in batches:
                for text in batch.column("raw").to_pylist():
                    out.write((",\n" if n else "").encode() + text.encode())
                    n += 1
            out.write(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.select("position", "raw").repartition(1).sortWithinPartitions("position").mapInArrow(write, "n long").count()


# ---- JSON lists -------------------------------------------------------------

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2  # where a range begins: between strings, in one, behind its backslash


def _marks(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, their kinds, depth after each, and where the range ends."""
    b = np.frombuffer(data, np.uint8).copy()
    if start == ESCAPED:
        b[0] = 32
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != 92, at, -1))  # the last byte up to here that is no backslash
    before = np.append(-1, plain[:-1])
    escaped = (at - 1 - before) % 2 == 1  # behind an odd run of backslashes
    strings = np.cumsum((b == 34) & ~escaped) + (start != OUTSIDE)
    tail = len(b) - 1 - int(plain[-1])
    end = OUTSIDE if strings[-1] % 2 == 0 else ESCAPED if tail % 2 else INSIDE
    kind = b * ((strings % 2 == 0) & np.isin(b, np.frombuffer(b"[]{},", np.uint8)))
    place = np.flatnonzero(kind)
    kind = kind[place]
    depth = np.cumsum(np.isin(kind, [91, 123]).astype(np.int64) - np.isin(kind, [93, 125]))
    return place, kind, depth, end


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range does for each way it may begin: its end, change of depth, and commas by depth."""
    for batch in batches:
        for row in batch.to_pylist():
            ways = []
            for start in (OUTSIDE, INSIDE, ESCAPED):
                _, kind, depth, end = _marks(row["data"], start)
                level, n = np.unique(depth[kind == 44], return_counts=True)
                ways.append({"end": end, "depth": int(depth[-1]) if len(depth) else 0, "commas": [{"level": x, "n": y} for x, y in zip(level.tolist(), n.tolist())]})
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "number": row["number"], "ways": ways}], _OUTLINE)


_OUTLINE = pa.schema([
    ("file", pa.string()), ("number", pa.int32()),
    ("ways", pa.list_(pa.struct([("end", pa.int32()), ("depth", pa.int64()), ("commas", pa.list_(pa.struct([("level", pa.int64()), ("n", pa.int64())])))]))),
])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of the outer list that lie in a range, whole ones and the parts at its two ends."""
    for batch in batches:
        for row in batch.to_pylist():
            data = row["data"]
            place, kind, depth, _ = _marks(data, row["start"])
            level = depth + row["depth"]
            outer = ((kind == 44) & (level == 1)) | ((kind == 91) & (level == 1)) | ((kind == 93) & (level == 0))
            place, kind = place[outer].tolist(), kind[outer].tolist()
            number, out, first, whole = row["element"], [], 0, False
            for at, what in zip([*place, len(data)], [*kind, 0]):
                if what != 91:  # what stands before the list's own bracket is no element
                    out.append((number, data[first:at], whole and what != 0))
                number += what == 44
                first, whole = at + 1, True
                if what == 93:
                    break
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["file"]] * len(out), pa.string()), pa.array([row["number"]] * len(out), pa.int32()),
                 pa.array([n for n, _, _ in out], pa.int64()), pa.array([t for _, t, _ in out], pa.binary()),
                 pa.array([w for _, _, w in out], pa.bool_())],
                ["file", "number", "position", "part", "whole"],
            )


def read_json_list(spark: SparkSession, path: str, range_bytes: int = JSON_BYTES) -> DataFrame:
    """``position, raw``: elements of a file that holds one JSON list, texts without their quotes, others as JSON.

    A byte range does not know whether it begins inside a string or how deep: a first pass outlines each range for
    every way it may begin, one row per range is chained in order, and a second pass cuts the ranges at the commas of
    the outer list. Only elements that cross a cut are put together from several tasks.
    """
    ranges = _ranges(spark, ByteRanges, path, range_bytes)
    outline = ranges.mapInArrow(_outline, "file string, number int, ways array<struct<end:int,depth:long,commas:array<struct<level:long,n:long>>>>")
    chain = outline.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", "ways"))).alias("all"))
    first = F.struct(F.lit(OUTSIDE).alias("start"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("element"))

    def onward(done, r):
        here = F.get(done, F.size(done) - 1)
        way = F.get(r["ways"], here["start"])
        outer = F.filter(way["commas"], lambda c: c["level"] + here["depth"] == 1)
        commas = F.coalesce(F.get(outer, F.lit(0))["n"], F.lit(0).cast("long"))
        return F.concat(done, F.array(F.struct(
            way["end"].alias("start"), (here["depth"] + way["depth"]).alias("depth"), (here["element"] + commas).alias("element")
        )))

    starts = chain.select("file", F.posexplode(F.aggregate("all", F.array(first), onward)).alias("number", "s"))
    begun = ranges.join(starts.select("file", "number", "s.*"), ["file", "number"])
    parts = begun.mapInArrow(_elements, "file string, number int, position long, part binary, whole boolean")
    whole = parts.where("whole").select("position", "part")
    cut = parts.where(~F.col("whole")).groupBy("position").agg(F.array_sort(F.collect_list(F.struct("number", "part"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), ""))
    text = F.decode("part", "UTF-8")
    every = whole.unionByName(cut.select("position", joined.alias("part"))).where(F.btrim(text, F.lit(" \t\r\n")) != "")
    return every.select("position", F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 0).alias("raw"))
