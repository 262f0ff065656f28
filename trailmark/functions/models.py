"""Pluggable encoders and annotators, run inside Arrow batches.

Model calls are the only Python in the hot path. A plug-in object is created
once per partition by the factory that is handed in.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ANNOTATED_ROWS = 256  # rows whose prompts are handed to an annotator together


class Encoder(Protocol):
    """Texts (and image paths per text) to float vectors."""

    def encode(self, texts: list[str], images: list[list[str]]) -> np.ndarray: ...


class Annotator(Protocol):
    """One reply text per prompt."""

    def annotate(self, prompt: str, images: list[str]) -> str: ...


class Refused(Exception):
    """Raised by an annotator for a prompt it will never answer; not retried."""


class HashEncoder:
    """Deterministic 16-number vectors from the text digest, for tests.

    With images the vector is the mean over one vector per (text, image).
    """

    dim = 16

    def encode(self, texts: list[str], images: list[list[str]]) -> np.ndarray:
        digests, n = [], np.ones(len(texts), np.int64)
        for i, (text, paths) in enumerate(zip(texts, images)):
            said = hashlib.md5(text.encode("utf-8"))
            for path in paths:  # the text is read once, whatever images follow it
                one = said.copy()
                one.update(f"|{path}".encode("utf-8"))
                digests.append(one.digest())
            if not paths:
                digests.append(said.digest())
            n[i] = max(1, len(paths))
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, self.dim)
        vectors = (raw.astype(np.float64) / 255.0 - 0.5).astype(np.float32)
        if len(vectors) == len(texts):
            return vectors
        first = np.cumsum(n) - n
        total = vectors[first]
        for j in range(1, int(n.max())):
            more = np.flatnonzero(n > j)
            total[more] += vectors[first[more] + j]
        return total / n[:, None].astype(np.float32)


def _retry(call: Callable[[], object], attempts: int, base: float, cap: float):
    for attempt in range(attempts):
        try:
            return call()
        except Refused:
            raise
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(min(base * 1.5**attempt, cap))


def embed(
    df: DataFrame,
    encoder: Callable[[], Encoder],
    text: str = "text",
    images: str | None = None,
    name: str = "embedding",
    batch_size: int = 32,
    attempts: int = 3,
    base_delay: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the vector of each row; client errors are retried with growing delay.

    Of the other columns those in ``keep`` go on, all by default: texts that nobody reads later need not leave the task.
    """
    kept = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = encoder()
        for batch in batches:
            found = [pa.array([], pa.list_(pa.float32()))]
            for at in range(0, batch.num_rows, batch_size):  # a model's batch is all that becomes Python objects
                part = batch.slice(at, batch_size)
                texts = [t or "" for t in part.column(text).to_pylist()]
                paths = _filled(part.column(images)) if images else [[] for _ in texts]
                found.append(_lists(_retry(lambda: client.encode(texts, paths), attempts, base_delay, 3.0)))
            yield _with_column(batch.select(kept), name, pa.concat_arrays(found))

    return df.mapInArrow(run, schema)


def _filled(lists: pa.Array) -> list[list[str]]:
    """The texts of each list, blanks and nulls left out."""
    ends, values = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).tolist(), lists.flatten().to_pylist()
    return [[v for v in values[a:b] if v] for a, b in zip(ends, ends[1:])]


def _lists(vectors: np.ndarray | list) -> pa.ListArray:
    if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(vectors, np.float32).ravel()))
    return pa.array([np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32()))


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def annotate(
    df: DataFrame,
    annotator: Callable[[], Annotator],
    accept: Callable[[str], bool],
    prompt: str = "prompt",
    images: str | None = None,
    name: str = "reply",
    attempts: int = 3,
    concurrency: int = 8,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the annotator's reply; rows without an acceptable reply are left out.

    Of the other columns those in ``keep`` go on, all by default.

    An error or a reply that ``accept`` turns down counts as one attempt; a
    refusal ends the row at once. A task keeps ``concurrency`` calls in flight.
    Replies are not repeatable: write them out or checkpoint before using them
    twice.
    """
    kept = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.StringType())])

    def ask(client: Annotator, text: str, paths: list[str]) -> str | None:
        for _ in range(attempts):
            try:
                reply = client.annotate(text, paths)
            except Refused:
                return None
            except Exception:
                continue
            if accept(reply):
                return reply
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = annotator()
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, ANNOTATED_ROWS):  # only prompts and paths of so many rows become Python objects
                    part = batch.slice(at, ANNOTATED_ROWS)
                    known = [ps or [] for ps in part.column(images).to_pylist()] if images else [[]] * part.num_rows
                    replies = pa.array(list(pool.map(lambda t, p: ask(client, t, p), part.column(prompt).to_pylist(), known)), pa.string())
                    yield _with_column(part.select(kept), name, replies).filter(replies.is_valid())

    return df.mapInArrow(run, schema)


def is_json_list(reply: str) -> bool:
    return reply.strip().startswith("[") and _parses(reply)


def is_json_object(reply: str) -> bool:
    return reply.strip().startswith("{") and _parses(reply)


def _parses(reply: str) -> bool:
    try:
        json.loads(reply)
    except ValueError:
        return False
    return True


def safe_udf(fn: Callable, returns: str = "string"):
    """Arrow UDF of a scalar function; a failing value gives an error text instead of an exception."""
    out = T.StructType([T.StructField("value", T._parse_datatype_string(returns)), T.StructField("error", T.StringType())])

    @F.pandas_udf(out)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((fn(v), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run
