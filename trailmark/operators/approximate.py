"""Approximate filtered cosine search: candidates from a hash index on unit vectors, exact scores for them.

The index is Spark ML's random projection hashing. A cell of the index is one of ``tables`` groups of ``bits``
projections, each cut into buckets; near vectors share a cell of at least one table with high probability. Filters are
applied before the index is asked, and the rows of a shared cell are scored exactly, tile by tile, as in the exact
search; so every score is right and only rows without a shared cell can be missed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.vectors import l2_normalize
from trailmark.operators.search import _best_states, exclude_pairs
from trailmark.operators.topk import best_rows


@dataclass(frozen=True)
class CellIndex:
    """Random projections of unit vectors; the same for every table it hashes."""

    model: BucketedRandomProjectionLSHModel
    tables: int
    bits: int

    def cells(self, df: DataFrame) -> DataFrame:
        """``df`` once per table, with its ``cell`` there. Rows without vector are in no cell."""
        have = df.where(F.col("embedding").isNotNull())
        hashed = self.model.transform(have.withColumn("_v", array_to_vector(l2_normalize("embedding"))))
        flat = [vector_to_array(F.get("_h", F.lit(i)))[0].cast("long") for i in range(self.tables * self.bits)]
        groups = [flat[t * self.bits : (t + 1) * self.bits] for t in range(self.tables)]
        cells = F.array(*(F.concat_ws("_", F.lit(t), *[h.cast("string") for h in g]) for t, g in enumerate(groups)))
        return hashed.withColumn("cell", F.explode(cells)).drop("_v", "_h")


def fit_cells(vectors: DataFrame, tables: int = 20, bits: int = 4, bucket_length: float = 0.5, seed: int = 17) -> CellIndex:
    """An index for vectors of this dimension.

    More tables find more neighbours, more bits or shorter buckets leave fewer rows in a cell. The projections depend
    on the dimension and the seed only, so a rerun has the same cells.
    """
    units = vectors.where(F.col("embedding").isNotNull()).select(array_to_vector(l2_normalize("embedding")).alias("_v"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_h", bucketLength=bucket_length, numHashTables=tables * bits, seed=seed
    )
    return CellIndex(lsh.fit(units.limit(1)), tables, bits)


def search_states_approximate(
    queries: DataFrame,
    meta: DataFrame,
    vectors: DataFrame,
    index: CellIndex,
    k: int = 5,
    min_score: float = -math.inf,
    min_q: int = 0,
    exclude: DataFrame | None = None,
    **tiles: int,
) -> DataFrame:
    """``search_states`` with ``overfetch=None`` among the rows that share a cell with the query."""
    allowed = meta.select("bank_row", "task_id", "state", "q_value", "experience", "source")
    allowed = allowed.where(F.coalesce("q_value", F.lit(0)) >= min_q)
    if exclude is not None:
        allowed = exclude_pairs(allowed, exclude)
    usable = vectors.join(allowed.select("bank_row", "task_id"), "bank_row").withColumn("masked", F.lit(False))
    asked = index.cells(queries.select("query_id", "view", "embedding"))
    found = best_rows(asked, index.cells(usable), ["view", "cell"], k, min_score, per_task=True, **tiles)
    return _best_states(found.drop("masked").join(allowed, "bank_row"), k)
