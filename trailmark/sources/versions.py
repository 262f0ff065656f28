"""Versioned tables: every version is a folder of its own, and a pointer file that appears at once makes it current.

A version's data is written completely before its pointer is renamed into place. The rename fails when the number is
taken, so of two writers that start from the same version one gets a ``VersionConflict``. Readers see whole versions
only, and old ones stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"


class VersionConflict(RuntimeError):
    """Another writer has published this number."""


class _Files:
    """The table's file system, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = self.path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))

    def list(self, folder: str) -> list[str]:
        at = self.path(str(self.root), folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(str(self.root), name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file that appears whole; False when the name is taken."""
        draft, final = self.path(str(self.root), f"{POINTERS}/.{uuid.uuid4().hex}"), self.path(str(self.root), name)
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        flags[0] = kind.NONE
        try:
            self.context.rename(draft, final, flags)
        except Exception as e:  # py4j carries Java's exception
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of a table, oldest first; none for a folder that is no table."""
    return [int(n.removesuffix(".json")) for n in _Files(spark, path).list(POINTERS) if n.endswith(".json") and not n.startswith(".")]


def current_version(spark: SparkSession, path: str) -> int:
    """The newest version, 0 when nothing is published."""
    return max(versions(spark, path), default=0)


def publish(df: DataFrame, path: str, base: int | None = None, partition_by: tuple[str, ...] = (), note: str = "") -> int:
    """Write ``df`` as the version after ``base`` (the current one when not given) and return its number.

    ``df`` may be derived from an earlier version of the same table: that one's files are not touched.
    """
    spark = df.sparkSession
    number = (current_version(spark, path) if base is None else base) + 1
    folder = f"data/{number:06d}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path.rstrip('/')}/{folder}")
    pointer = json.dumps({"folder": folder, "note": note, "schema": df.schema.json()})
    if not _Files(spark, path).put_new(f"{POINTERS}/{number:06d}.json", pointer):
        raise VersionConflict(f"version {number} of {path} is taken")
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a table, the current one when not given. Partition columns come last, as when written."""
    from pyspark.sql.types import StructType

    number = current_version(spark, path) if version is None else version
    try:
        pointer = json.loads(_Files(spark, path).read(f"{POINTERS}/{number:06d}.json"))
    except Exception as e:
        raise ValueError(f"{path} has no version {number}") from e
    schema = StructType.fromJson(json.loads(pointer["schema"]))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{pointer['folder']}")
