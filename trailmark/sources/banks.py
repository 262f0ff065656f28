"""Stored experience banks: native Parquet and imported arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.skew import row_number, running
from trailmark.schemas import BANK_VECTORS, VIEWS
from trailmark.sources.ranges import read_arrays, read_json_list, write_arrays, write_json_list


def write_state_bank(meta: DataFrame, vectors: DataFrame, path: str) -> None:
    """Meta table and vectors, one folder per view so a search reads its view only."""
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    vectors.write.mode("overwrite").partitionBy("view").parquet(f"{path}/vectors")


def read_state_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.schema(BANK_VECTORS).parquet(f"{path}/vectors")
    return spark.read.parquet(f"{path}/meta"), vectors


def write_trace_bank(bank: DataFrame, path: str) -> None:
    bank.write.mode("overwrite").parquet(path)


def read_trace_bank(spark: SparkSession, path: str) -> DataFrame:
    """Trace bank with the defaults of old entries filled in."""
    df = spark.read.parquet(path)
    return upgrade_trace_bank(df)


def upgrade_trace_bank(df: DataFrame) -> DataFrame:
    """Entries without source count as ``correct``, without task as ''."""
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    task = F.col("task_id") if "task_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("source", F.coalesce(source, F.lit("correct"))).withColumn(
        "task_id", F.coalesce(task, F.lit(""))
    )


# ---- import of dense arrays -------------------------------------------------


def _json_list(spark: SparkSession, path: str) -> DataFrame:
    return read_json_list(spark, path).withColumnRenamed("position", "bank_row")


def import_state_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bank stored as ``state_meta.json`` and ``views/<view>.npy`` (with optional ``<view>_mask.npy``).

    Rows whose mask is false are dropped; a view without mask file is whole.
    Raises when a view and the meta list differ in length.
    """
    schema = (
        "task_id string, state int, experience string, q_value int, state_text string, "
        "elements struct<question:string,task:string,images:array<string>,observations:array<string>>, "
        "available_views array<string>, source string"
    )
    meta = _json_list(spark, f"{path}/state_meta.json").select(
        F.col("bank_row").cast("long").alias("bank_row"), F.from_json("raw", schema).alias("m")
    ).select("bank_row", "m.*")
    arrays = read_arrays(spark, f"{path}/views/*.npy")
    masks = arrays.where(F.col("name").endswith("_mask")).select(
        F.regexp_replace("name", "_mask$", "").alias("view"), "bank_row", (F.get("embedding", 0) != 0).alias("_on")
    )
    views = arrays.where(F.col("name").isin(*VIEWS)).withColumnRenamed("name", "view")
    n_meta = meta.count()
    wrong = views.groupBy("view").count().where(F.col("count") != n_meta).first()
    if wrong is not None:
        raise ValueError(f"view {wrong['view']} has {wrong['count']} rows, meta has {n_meta}")
    kept = views.join(masks, ["view", "bank_row"], "left").where(F.coalesce("_on", F.lit(True)))
    return meta, kept.select("bank_row", "view", "embedding")


def export_state_bank(meta: DataFrame, vectors: DataFrame, path: str) -> None:
    """The layout ``import_state_bank`` reads: a matrix with a row per state and a mask for every view of the bank.

    ``bank_row`` counts from 0 without gaps. A state without vector in a view has a row of zeros and a false mask.
    """
    body = F.to_json(F.struct(*[c for c in meta.columns if c != "bank_row"]))
    write_json_list(meta.select(F.col("bank_row").alias("position"), body.alias("raw")), f"{path}/state_meta.json")
    width = vectors.groupBy("view").agg(F.max(F.size("embedding")).alias("_width"))
    cells = _cells(meta, width)
    full = cells.join(vectors.select("bank_row", "view", "embedding"), ["bank_row", "view"], "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.col("_width"))
    write_arrays(full.select(F.col("view").alias("name"), "bank_row", F.coalesce("embedding", zeros).alias("embedding")), f"{path}/views")
    mask = F.array(F.col("embedding").isNotNull().cast("float"))
    write_arrays(full.select(F.concat("view", F.lit("_mask")).alias("name"), "bank_row", mask.alias("embedding")), f"{path}/views", "|b1")


def _cells(meta: DataFrame, width: DataFrame) -> DataFrame:
    """``bank_row, view, _width`` of every state and every view that ``width`` lists; one row per view is joined by name."""
    every = F.explode(F.array(*[F.lit(v) for v in VIEWS])).alias("view")
    return meta.select("bank_row", every).join(width, "view")


def export_trace_bank(bank: DataFrame, path: str) -> None:
    """The layout ``import_trace_bank`` reads; ``bank_row`` counts from 0 without gaps."""
    body = F.to_json(F.struct("task_id", "experience", "source"))
    write_json_list(bank.select(F.col("bank_row").alias("position"), body.alias("raw")), f"{path}/experiences.json")
    write_arrays(bank.select(F.lit("embeddings").alias("name"), "bank_row", "embedding"), path)


def import_trace_bank(spark: SparkSession, path: str) -> DataFrame:
    """Bank stored as ``experiences.json`` (objects, or plain texts in old files) and ``embeddings.npy``."""
    rows = _json_list(spark, f"{path}/experiences.json")
    is_object = F.col("raw").startswith("{")
    parsed = F.from_json("raw", "task_id string, experience string, source string")
    items = rows.select(
        F.col("bank_row").cast("long").alias("bank_row"),
        F.when(is_object, parsed["task_id"]).alias("task_id"),
        F.when(is_object, parsed["experience"]).otherwise(F.col("raw")).alias("experience"),
        F.when(is_object, parsed["source"]).alias("source"),
    )
    vectors = read_arrays(spark, f"{path}/embeddings.npy").select("bank_row", "embedding")
    n_items, n_vectors = items.count(), vectors.count()
    if n_items != n_vectors:
        raise ValueError(f"{n_vectors} embeddings but {n_items} experiences")
    return upgrade_trace_bank(items).join(vectors, "bank_row")


def number_rows(df: DataFrame, axis: str, name: str = "bank_row") -> DataFrame:
    """0-based bank rows in the order of a numeric column."""
    out = running(df, [], {"a": F.col(axis)}, {name: row_number()})
    return out.withColumn(name, F.col(name) - 1)


