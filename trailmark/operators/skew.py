"""Ordered computations that stay even when one key holds most of the rows.

A window over ``partitionBy(key)`` sends a whole key to one task. ``running``
first looks at the row count per key (one map-side combined aggregate). When no
key is larger than ``target_rows`` it uses the plain window. Otherwise the large
keys are cut into ranges of the order columns, the window runs per range, and a
small per-range summary carries totals and last values across the cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000  # rows one task may order
BROADCAST_ROWS = 200_000  # rows of a side that may be broadcast


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when a counted side is small; the plain side (shuffled join) otherwise."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def same_keys(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on columns both sides share."""
    terms = [left[n].eqNullSafe(right[n]) for n in names]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def cut_hot_keys(
    df: DataFrame, keys: list[str], axes: list[str], target_rows: int = TARGET_ROWS
) -> tuple[DataFrame, list[str]]:
    """Cut keys larger than ``target_rows`` into ranges of the numeric ``axes``.

    Returns the input with the cut columns it needed, often none. Ranges follow
    the axes' order, so sorting by the cut columns and then by the axes equals
    sorting by the axes. The bounds are exact aggregates, so a recomputed task
    cuts at the same places. Ranges that stay too large are cut again; an axis
    that is constant in a range gives way to the next one. Every cut parts the lowest
    from the highest value, so the cutting ends.
    """
    cuts: list[str] = []
    for level in count():
        group = keys + cuts
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, a in enumerate(axes):
            aggs += [F.min(a).alias(f"_lo{i}"), F.max(a).alias(f"_hi{i}")]
        wide = [F.col(f"_lo{i}") < F.col(f"_hi{i}") for i in range(len(axes))]
        hot = (
            df.groupBy(*group).agg(*aggs)
            .where((F.col("_n") > target_rows) & reduce(lambda a, b: a | b, wide))
        )
        name = f"_cut{level}"
        if not group:
            bounds = hot.first()  # one row: the whole table's count and bounds
            if bounds is None:
                break
            df = df.withColumn(name, _cut(axes, target_rows, lambda c: F.lit(bounds[c])))
            cuts.append(name)
            continue
        n_hot = hot.limit(BROADCAST_ROWS + 1).count()
        if n_hot == 0:
            break
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        right = side.withColumnsRenamed({g: f"_k_{g}" for g in group})
        on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in group])
        drop = [f"_k_{g}" for g in group] + ["_n"]
        drop += [f"_{b}{i}" for i in range(len(axes)) for b in ("lo", "hi")]
        cut = F.coalesce(_cut(axes, target_rows, F.col), F.lit(0).cast("long"))
        df = df.join(right, on, "left").withColumn(name, cut).drop(*drop)
        cuts.append(name)
    return df, cuts


def _cut(axes: list[str], target_rows: int, bound: Callable[[str], Column]) -> Column:
    """Range number of a row between the bounds of its group; null for a group without bounds."""
    slots = F.ceil(bound("_n") * 2 / F.lit(target_rows))
    cut = F.when(bound("_n").isNotNull(), F.lit(0).cast("long"))
    for i in reversed(range(len(axes))):
        low, high = bound(f"_lo{i}"), bound(f"_hi{i}")
        share = (F.col(axes[i]) - low).cast("double") / (high - low + 1).cast("double")
        cut = F.when(low < high, F.floor(share * slots)).otherwise(cut)
    return cut


@dataclass(frozen=True)
class Running:
    """One running column: ``sum_before``, ``sum_through`` or ``previous`` of ``value``."""

    kind: str
    value: Column


def row_number() -> Running:
    """1-based position in the order."""
    return Running("sum_through", F.lit(1))


def running(
    df: DataFrame,
    keys: list[str],
    axes: dict[str, Column],
    columns: dict[str, Running],
    tie_breakers: list[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add running columns per key, ordered by the numeric ``axes`` then the tie breakers."""
    for name, expr in axes.items():
        df = df.withColumn(f"_ax_{name}", expr.cast("long"))
    axis_names = [f"_ax_{n}" for n in axes]
    df, cuts = cut_hot_keys(df, keys, axis_names, target_rows)
    order = axis_names + list(tie_breakers)
    local = Window.partitionBy(*(keys + cuts)).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    through = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    out = df
    for name, c in columns.items():
        if c.kind == "previous":
            out = out.withColumn(name, F.lag(F.struct(c.value.alias("v"))).over(local))
        elif c.kind == "sum_before":
            out = out.withColumn(name, F.coalesce(F.sum(c.value).over(before), F.lit(0)))
        elif c.kind == "sum_through":
            out = out.withColumn(name, F.coalesce(F.sum(c.value).over(through), F.lit(0)))
        else:
            raise ValueError(f"unknown running column {c.kind!r}")

    if cuts:
        position = F.struct(*[F.col(o) for o in order])
        totals = df.groupBy(*(keys + cuts)).agg(
            *[
                F.max_by(F.struct(c.value.alias("v")), position).alias(f"_t_{n}")
                if c.kind == "previous"
                else F.sum(c.value).alias(f"_t_{n}")
                for n, c in columns.items()
            ]
        )
        over_cuts = Window.partitionBy(*keys).orderBy(*cuts)
        earlier = over_cuts.rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys + cuts],
            *[
                (
                    F.lag(f"_t_{n}").over(over_cuts)
                    if c.kind == "previous"
                    else F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0))
                ).alias(f"_c_{n}")
                for n, c in columns.items()
            ],
        )
        on = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys + cuts]
        )
        out = out.join(carried, on, "left")
        for name, c in columns.items():
            if c.kind == "previous":
                out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_c_{name}")))
            else:
                out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
        out = out.drop(*[f"_k_{k}" for k in keys + cuts], *[f"_c_{n}" for n in columns])

    for name, c in columns.items():
        if c.kind == "previous":
            out = out.withColumn(name, F.col(name)["v"])
    return out.drop(*cuts, *axis_names)


def number_ranges(
    df: DataFrame, order: list[str], name: str, save: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add the 0-based position in the order of columns of any type.

    Range partitions are sorted apart and stored by ``save``, because their bounds come from a sample and must not
    be drawn again; the sizes of the partitions before give the offset. The window runs over one row per partition.
    """
    placed = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # fixed values: an id is the partition number and 33 bits of position
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    joined = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return joined.withColumn(name, position).drop("_at", "_part", "_before")


SELECT_SLOTS = 4_096  # ranges that one round of ``first_rows`` counts


def first_rows(df: DataFrame, n: int, axes: list[Column]) -> DataFrame:
    """The first ``n`` rows in the order of whole-number ``axes``, nulls first; rows equal on all axes are interchangeable.

    A distributed selection: a round counts the rows of some thousand equal ranges between the bounds of the first
    axis and goes on in the range that holds the n-th row, until one value is left; ties on it are decided by the next
    axis. Then the rows below the cut are a filter on the input. The rounds read narrow columns, and their number
    depends on the width of the axes, not on ``n`` or the table. No row is ordered, whatever share of them is equal.
    """
    named = [F.coalesce(a.cast("long"), F.lit(-(1 << 63))) for a in axes]
    names = [f"_axis{i}" for i in range(len(axes))]
    wide = df.withColumns(dict(zip(names, named)))
    narrow, left, below = wide.select(*names), n, F.lit(False)
    tied = F.lit(True)
    for name in names:
        cut, before, at = _nth_value(narrow.where(tied), name, left)
        if cut is None:
            return df  # not more than n rows
        below, left = below | (tied & (F.col(name) < cut)), left - before
        tied = tied & (F.col(name) == cut)
        if at == left:  # the rows of the cut value are all wanted
            return wide.where(below | tied).drop(*names)
    return wide.where(below).unionByName(wide.where(tied).limit(left)).drop(*names)


def _nth_value(df: DataFrame, axis: str, n: int) -> tuple[int | None, int, int]:
    """The value of the n-th row, how many rows are below it, and how many have it; None with n rows or fewer."""
    first = df.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if first["n"] <= n:
        return None, 0, 0
    lo, hi, before = first["lo"], first["hi"], 0
    while True:
        width = max(1, -(-(hi - lo + 1) // SELECT_SLOTS))
        slot = F.expr(f"(cast({axis} as decimal(20,0)) - cast({lo} as decimal(20,0))) div cast({width} as decimal(20,0))")
        counts = df.where(F.col(axis).between(lo, hi)).groupBy(slot.alias("slot")).count().collect()  # SELECT_SLOTS at most
        for slot_no, count in sorted((r["slot"], r["count"]) for r in counts):
            if before + count >= n:
                break
            before += count
        lo, hi = lo + slot_no * width, min(hi, lo + (slot_no + 1) * width - 1)
        if width == 1:
            return lo, before, count


def hash_axis(digest: Column) -> Column:
    """Order-keeping number of a hex digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def latest(df: DataFrame, keys: list[str], order: Column, keep: str = "last") -> DataFrame:
    """One row per key, the last or first by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*[F.col(c) for c in rest]), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
