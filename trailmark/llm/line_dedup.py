"""Line deduplication: explode normalised lines, count documents per line hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import BLANKS, lower_ascii, save, whole_text


def _line_hash(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key; null for keys too short to count."""
    key = lower_ascii(F.btrim(line, F.lit(BLANKS)))
    pair = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    return F.when(F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars, pair)


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: Column | None = None
) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped for each row of ``docs``, and ``carried`` if asked for.

    A line's key has blanks at both ends stripped and A-Z lower-cased. A key of ``min_chars`` code points or more
    in ``min_docs`` documents or more stays only in the largest doc_id that holds it, there with all its lines.

    Null text is one empty line. Every row counts as a document, also repeated rows; rows that share the largest
    doc_id all keep the line. A null doc_id is smaller than any other. An empty table gives an empty result. Other
    columns are ignored. One long document stays in one row; positions are looked up by hashing, in linear time.

    Documents are counted per hash on distinct hashes of each row, combined before the shuffle. The table of
    repeated lines is written out, so that the join back is between two fresh shuffles, which Spark can split
    where one line is in a large share of all documents.
    """
    extra = [] if carry is None else [carry.alias("carried")]
    rows = docs.select("doc_id", whole_text(docs).alias("text"), *extra)
    hashes = F.transform(F.split("text", "\n", -1), lambda line: _line_hash(line, min_chars))
    per_doc = rows.select("doc_id", F.explode(F.array_distinct(hashes)).alias("h")).where("h is not null")
    repeated = save(
        per_doc.groupBy("h.a", "h.b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("a", "b", "last")
    )
    lines = rows.select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(hashes).alias("pos", "h"))
    drops = (
        lines.where("h is not null").select("doc_id", "of", "pos", "h.a", "h.b")
        .join(repeated, ["a", "b"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id", "of").agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("drop_id"), F.col("of").alias("drop_of"), "drop")
    )
    keyed = rows.withColumn("of", F.xxhash64("text"))
    found = keyed.join(drops, keyed["doc_id"].eqNullSafe(drops["drop_id"]) & (keyed["of"] == drops["drop_of"]), "left")
    split = F.split("text", "\n", -1)
    n_lines = F.size(split)
    rest = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("drop"))
    kept = F.transform(F.array(split), lambda all_: F.array_join(F.transform(rest, lambda i: F.get(all_, i)), "\n"))[0]
    return found.select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        *(["carried"] if extra else []),
    )


def op2_line_dedup(spark, sf_dir):
    from trailmark.llm.common import table

    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, coalesce(r.last <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
