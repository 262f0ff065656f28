"""Document fingerprints: order MinHash over occurrence-numbered word pairs, by array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import whole_text

ROWS_PER_BLOCK = 2_000
QUANTILES = 64
_PLACE = (1 << 24) - 1  # low bits of an item: its place in the text
_BIN = 58  # the high six bits of an item name one of 64 bins


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the order MinHash of a text column: an array of at most 64 tuple hashes, at most one per bin.

    The k-mers are pairs of neighbouring words; equal pairs are numbered by occurrence. A hash of pair and number
    deals them to 64 bins; the two smallest of each bin, put back in text order, are hashed together, so a tuple
    survives an edit only if both pairs and their order do. A text of one word, or of blanks, has one k-mer, the
    whole text; an empty text has none. Every step is a column of its own so that arrays are built once; places
    count modulo 2^24 words.
    """
    w, s, z = f"{name}_w", f"{name}_s", f"{name}_z"
    df = df.withColumn(w, F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+"))
    pairs = f"zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> xxhash64(a, b))"
    hashes = f"CASE WHEN {text} = '' THEN cast(array() AS array<bigint>) WHEN size({w}) < 2 THEN array(xxhash64({text})) ELSE {pairs} END"
    df = df.withColumn(s, F.expr(f"transform({hashes}, (x, i) -> (x & ~{_PLACE}L) | (i & {_PLACE}))")).drop(w)
    df = df.withColumn(s, F.sort_array(s))
    starts = f"filter(sequence(0, size({s}) - 1), i -> i = 0 OR shiftright(get({s}, i), 24) <> shiftright(get({s}, i - 1), 24))"
    df = df.withColumn(z, F.expr(f"CASE WHEN size({s}) = 0 THEN cast(array() AS array<int>) ELSE {starts} END"))
    number = f"(xxhash64(shiftright(get({s}, p), 24), p - a) & ~{_PLACE}L) | (get({s}, p) & {_PLACE}L)"
    run = f"transform(sequence(a, e - 1), p -> coalesce({number}, 0L))"
    ends = f"concat(slice({z}, 2, size({z})), array(size({s})))"
    items = f"flatten(zip_with({z}, {ends}, (a, e) -> {run}))"
    df = df.withColumn(z, F.expr(f"CASE WHEN size({s}) = 0 THEN cast(array() AS array<bigint>) ELSE {items} END")).drop(s)
    df = df.withColumn(z, F.sort_array(z))
    same = f"shiftright(get({z}, j - {{}}), {_BIN}) = shiftright(x, {_BIN})"
    df = df.withColumn(z, F.expr(f"filter({z}, (x, j) -> j < 2 OR NOT ({same.format(2)}))"))
    y, x_hash, y_hash = f"get({z}, j + 1)", f"(x & ~{_PLACE}L)", f"(get({z}, j + 1) & ~{_PLACE}L)"
    joined = f"if((x & {_PLACE}L) < ({y} & {_PLACE}L), xxhash64({x_hash}, {y_hash}), xxhash64({y_hash}, {x_hash}))"
    alone = f"coalesce(shiftright({y}, {_BIN}) <> shiftright(x, {_BIN}), true)"
    value = f"shiftleft(shiftright(x, {_BIN}), {_BIN}) | (if({alone}, xxhash64({x_hash}), {joined}) & {(1 << _BIN) - 1}L)"
    made = f"transform({z}, (x, j) -> if(j > 0 AND {same.format(1)}, NULL, {value}))"
    return df.withColumn(name, F.expr(f"filter({made}, v -> v IS NOT NULL)")).drop(z)


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among the bins that either fingerprint fills; 1 for two empty ones."""
    bins = [F.transform(x, lambda v: F.shiftright(v, _BIN)) for x in (a, b)]
    filled = F.size(F.array_union(*bins))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_string(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 16, "0")), "")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column>: the value in the row with the next smaller doc_id, after the smallest in the largest.

    ``rows`` has doc_id and ``of``, which orders rows of one doc_id. Ranges of doc_id are ordered apart from each
    other; the first row of each range is also put behind the range before it, so one shuffle is enough. Ranges
    are equal parts between quantiles. Null ids come last.
    """
    total = rows.count()
    bounds = rows.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()[0]
    if not bounds:
        cell = F.lit(-1).cast("long")
    else:
        # double arithmetic is monotone in doc_id, which is all that ranges need
        share = max(1, -(-total // (QUANTILES * ROWS_PER_BLOCK)))
        edges = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))])
        q = F.size(F.filter(edges, lambda e: e <= F.col("doc_id")))
        low, high = F.get(edges, q - 1), F.coalesce(F.get(edges, q), F.get(edges, q - 1) + 1)
        inside = F.floor((F.col("doc_id") - low).cast("double") / (high - low).cast("double") * share)
        inside = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(share - 1), inside)), F.lit(0))
        cell = F.when(F.col("doc_id").isNull(), -1).otherwise(q * share + inside).cast("long")
    rows = rows.withColumn("cell", cell)
    heads = rows.groupBy("cell").agg(F.max(F.struct("doc_id", F.bitwise_not("of").alias("not_of"))).alias("h"))
    down = Window.orderBy(F.desc("cell"))
    last = F.min("cell").over(Window.partitionBy())
    heads = heads.select(
        F.col("h.doc_id").alias("h_id"), F.bitwise_not("h.not_of").alias("h_of"), F.coalesce(F.lag("cell").over(down), last).alias("h_cell")
    )
    again = rows.join(heads, rows["doc_id"].eqNullSafe(heads["h_id"]) & (rows["of"] == heads["h_of"]))
    again = again.withColumn("cell", F.col("h_cell")).drop("h_id", "h_of", "h_cell")
    both = rows.withColumn("behind", F.lit(False)).unionByName(again.withColumn("behind", F.lit(True)))
    order = Window.partitionBy("cell").orderBy("behind", F.desc_nulls_last("doc_id"), "of")
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return both.where("not behind").drop("cell", "behind")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint (array) for each row; null text is empty, repeated rows repeat, other columns go."""
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    return with_fingerprint(rows, "text", "fp")


def op10_fingerprints(spark, sf_dir):
    from trailmark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", whole_text(docs).alias("text")).withColumn("of", F.xxhash64("text"))
    rows = with_next(rows, ["text"])
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next_text, 1, int(n_chars div 2)))")
    )
    for text, name in (("text", "fp"), ("edited", "edited_fp"), ("next_text", "next_fp")):
        rows = with_fingerprint(rows, text, name)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("fp").alias("fingerprint"),
        as_string("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
