"""Slices of a sample table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.skew import TARGET_ROWS, first_rows, hash_axis, row_number, running, small_side


def shuffle_key(seed: int, idx: str = "idx") -> Column:
    """Repeatable random order: digest of seed and row id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")))


def group_name(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit("unknown"))


def limit_samples(df: DataFrame, n: int, position: str = "src_pos") -> DataFrame:
    """First ``n`` rows in source order; among rows of one position those of the smallest row hash."""
    return first_rows(df, n, [F.col(position), F.xxhash64(*_hashable(df))])


def _hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed; maps as their entries."""
    return [F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema.fields]


def sample_random(df: DataFrame, n: int, seed: int = 42, idx: str = "idx") -> DataFrame:
    """Exactly min(n, rows) rows in a repeatable random choice."""
    digest = shuffle_key(seed, idx)
    parts = [F.conv(F.substring(digest, at, width), 16, 10) for at, width in ((1, 12), (13, 15), (28, 5))]
    return first_rows(df, n, [*parts, F.xxhash64(*_hashable(df))])


def sample_balanced(
    df: DataFrame,
    n: int,
    key: str = "sub_task",
    seed: int = 42,
    idx: str = "idx",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Equal shares per group.

    The remainder goes to the first groups in sorted order; what a small group
    cannot fill is not given to others. At most n groups get a share, so the
    quota table never has more than n rows.
    """
    groups = df.groupBy(group_name(key).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    n_groups = groups.count()
    if n_groups == 0:
        return df
    share, extra = divmod(n, n_groups)
    first = groups.select("_group").orderBy("_group").limit(min(n, n_groups))
    quota = running_groups(first).select(
        "_group", (F.lit(share) + (F.col("_i") < extra).cast("int")).alias("_quota")
    )
    keyed = df.withColumn("_group", group_name(key)).withColumn("_h", shuffle_key(seed, idx))
    eligible = keyed.join(small_side(quota), "_group")
    ranked = running(
        eligible, ["_group"], {"h": hash_axis(F.col("_h"))}, {"_rn": row_number()}, ["_h"], target_rows
    )
    return ranked.where(F.col("_rn") <= F.col("_quota")).drop("_group", "_h", "_rn", "_quota")


def running_groups(groups: DataFrame) -> DataFrame:
    """0-based position of each group name in sorted order (at most n rows)."""
    from pyspark.sql import Window

    return groups.withColumn("_i", F.row_number().over(Window.orderBy("_group")) - 1)


def slice_samples(df: DataFrame, n: int, seed: int = 42, key: str = "sub_task", idx: str = "idx") -> DataFrame:
    """Balanced slice when any row has a non-empty group, else a random one."""
    has_groups = df.where(F.coalesce(F.col(key), F.lit("")) != "").limit(1).count() > 0
    return sample_balanced(df, n, key, seed, idx) if has_groups else sample_random(df, n, seed, idx)


def group_counts(df: DataFrame, key: str = "sub_task") -> DataFrame:
    return df.groupBy(group_name(key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
