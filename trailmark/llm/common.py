"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import apply_settings, checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_BYTES = 8 << 20  # text a Python worker is given at once


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches bounded in bytes as well as rows."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/trailmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_by(df: DataFrame, key: str) -> DataFrame:
    """As ``save``, in buckets of ``key``: what is joined or grouped by it later needs no shuffle of this table."""
    spark = df.sparkSession
    name = f"trailmark_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(partitions(spark), key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def whole_text(docs: DataFrame) -> Column:
    """Null text counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, other letters untouched; all-ASCII texts take the fast function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
