"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, cut at each budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import WORD, save, whole_text

ROWS_PER_RANGE = 4_000


def random_key(doc_id: Column) -> Column:
    """60-bit number of the id's MD5 digest; any engine can repeat it."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share_percent: int, max_epochs: int) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``max_epochs`` times its source.

    Giving the excess again and again to the sources below their limit ends where every open source gets the same
    amount per weight. Sorted by limit per weight, the full sources are a prefix; the first source that needn't be
    full sets the amount. ``sizes`` has one row per source, so the two windows order sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    limit, weight = F.col("limit"), F.col("weight")
    named = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights))))
    named = named.withColumn("limit", F.col("source_size") * max_epochs)
    filling = Window.orderBy(limit / weight, F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = named.withColumns({
        "full": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(every),
    })
    budget = F.col("total") * share_percent - F.col("full") * 100
    # whole numbers up to the last division, so that every engine gets the same double
    sums = sums.withColumn("enough", budget * weight <= limit * 100 * F.col("open"))
    at = F.when(F.col("enough"), F.struct((-F.col("full")).alias("k"), budget.alias("budget"), F.col("open").alias("open")))
    sums = sums.withColumn("level", F.max(at).over(every))
    level = F.col("level")
    target = F.when(
        F.col("enough"), (level["budget"] * weight).cast("double") / (level["open"] * 100).cast("double")
    ).otherwise(limit.cast("double"))
    return sums.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share_percent: int = 150, max_epochs: int = 2
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), text_hash.

    ``size`` counts the words of the text. Sources get weights in code point order, null last, and share
    ``share_percent`` of all words (see ``source_targets``). Within a source, documents are sorted by a hash of
    doc_id; the mix takes the whole source as often as its target allows, then documents of the sorted order as long
    as less than half of one lies behind the budget, so that a source misses its target by half a document at most.

    Null text has size 0. Rows with equal doc_id have equal keys and are told apart by their text; equal rows are
    interchangeable. Null doc_ids share one key. Documents of size 0 are taken where their place in the order is.
    A source of size 0 has target 0 and takes its documents once. Empty tables give empty results; other columns
    are ignored.

    Ranges of hash keys spread a hot source over tasks; sums per range carry the totals across.
    """
    text = whole_text(docs)
    rows = save(docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        random_key(docs["doc_id"]).alias("key"), F.xxhash64(text).alias("text_hash"),
    ))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = save(source_targets(by_source, weights, share_percent, max_epochs))
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    width = -(-(1 << 60) // ranges)
    rows = rows.withColumn("range", F.expr(f"key div {width}"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash", "size")
    running = rows.withColumn("through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
        .select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    t = targets.withColumnRenamed("source", "t")
    placed = (
        running.join(starts, running["source"].eqNullSafe(starts["s"]) & (running["range"] == starts["r"]))
        .join(t, running["source"].eqNullSafe(t["t"]))
        .withColumn("before", F.col("start") + F.col("through") - F.col("size"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("source_size") > 0) & (F.col("before") * 2 + F.col("size") <= rest * 2) & (rest > 0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs + more.cast("long")).cast("long").alias("copies"), "text_hash",
    )


def op7_mixing(spark, sf_dir):
    from trailmark.llm.common import table

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER w, 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
         sum(source_size) OVER () AS total
  FROM src
  WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, total * 150 - filled * 100 AS budget, (total * 150 - filled * 100) * weight <= cap * 100 * open AS enough
  FROM filling
), level AS (
  SELECT budget, open FROM marked WHERE enough ORDER BY filled LIMIT 1
), targets AS (
  SELECT m.source, m.source_size,
         CASE WHEN enough THEN CAST(l.budget * m.weight AS DOUBLE) / CAST(l.open * 100 AS DOUBLE)
              ELSE CAST(cap AS DOUBLE) END AS target
  FROM marked m CROSS JOIN level l
), placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target / t.source_size) AS epochs,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size)
                                   AND target - epochs * source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
