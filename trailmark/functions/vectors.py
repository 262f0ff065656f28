"""Vector expressions on ``ARRAY<FLOAT>``, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import col

NORM_EPSILON = 1e-8  # fixed value added to every norm


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column | str) -> Column:
    length = norm(a) + F.lit(NORM_EPSILON)
    return F.transform(col(a), lambda x: x.cast("double") / length)


def plain_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine without the epsilon; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
