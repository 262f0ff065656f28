"""Pipeline stages: each applies an operator to documents; all but the last return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import prepare, save, table, whole_text
from trailmark.llm.line_dedup import drop_repeated_lines
from trailmark.llm.mixing import mix
from trailmark.llm.near_dedup import near_duplicates
from trailmark.llm.packing import pack
from trailmark.llm.quality import resample
from trailmark.operators.skew import row_number, running


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose doc_id and text are not in ``gone``; equal rows share their fate."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(whole_text(docs)) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; without a labels row of quality 1 all stay."""
    prepare(spark)
    return _without(docs, resample(docs, table(spark, sf_dir, "labels")).where("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the new text, other columns stay. No document goes."""
    prepare(spark)
    out = drop_repeated_lines(docs, carry=F.struct(*docs.columns))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    prepare(spark)
    return _without(docs, near_duplicates(docs, words=5).where("not kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Equal rows share their copies evenly, the first of them the rest."""
    prepare(spark)
    share = F.expr("sum(copies) div count(*)").alias("copies"), F.expr("sum(copies) % count(*)").alias("more")
    taken = mix(docs).groupBy("doc_id", "source", "text_hash").agg(*share).where("copies > 0 or more > 0")
    taken = save(taken.select(*[F.col(c).alias(f"mix_{c}") for c in taken.columns]))
    rows = docs.select("doc_id", "source", F.xxhash64(whole_text(docs)).alias("hash"), F.struct(*docs.columns).alias("row"))
    same = rows["doc_id"].eqNullSafe(taken["mix_doc_id"]) & rows["source"].eqNullSafe(taken["mix_source"])
    both = rows.join(taken, same & (rows["hash"] == taken["mix_text_hash"]))
    if not taken.where("mix_more > 0").isEmpty():
        some = save(both.where("mix_more > 0").select("row", *taken.columns).withColumn("at", F.monotonically_increasing_id()))
        key = ["mix_doc_id", "mix_source", "mix_text_hash"]
        some = running(some, key, {"at": F.col("at")}, {"nth": row_number()})
        some = some.withColumn("mix_copies", F.col("mix_copies") + (F.col("nth") <= F.col("mix_more")).cast("long"))
        both = both.where("mix_more = 0").select("row", "mix_copies").unionByName(some.select("row", "mix_copies"))
    both = both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int"))))
    return both.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, with the checksum of their token ids."""
    import public_tokenizers

    prepare(spark)
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
