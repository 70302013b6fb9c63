"""Vector and colour similarity as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declara.functions.base import let, rounded

MAX_COLOR_DISTANCE = (255.0 ** 2 * 3.0) ** 0.5


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one of them has no length."""
    parts = F.struct(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"))
    return let(parts, lambda p: F.when((p["aa"] > 0) & (p["bb"] > 0), p["ab"] / (F.sqrt(p["aa"]) * F.sqrt(p["bb"])))
               .otherwise(0.0))


def _mean_nearest(colors: Column, others: Column) -> Column:
    def distance(x: Column, y: Column) -> Column:
        return F.sqrt(F.aggregate(
            F.zip_with(x, y, lambda i, j: (i.cast("double") - j.cast("double")) * (i.cast("double") - j.cast("double"))),
            F.lit(0.0), lambda acc, v: acc + v))

    nearest = F.transform(colors, lambda x: F.array_min(F.transform(others, lambda y: distance(x, y))))
    return F.aggregate(nearest, F.lit(0.0), lambda acc, v: acc + v) / F.size(colors)


def palette_similarity(a: Column, b: Column) -> Column:
    """1 minus the mean both-way distance to the nearest colour, as a share of the largest distance."""
    mean = (_mean_nearest(a, b) + _mean_nearest(b, a)) / 2.0
    value = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - mean / F.lit(MAX_COLOR_DISTANCE))), 4)
    return F.when(F.coalesce((F.size(a) > 0) & (F.size(b) > 0), F.lit(False)), value).otherwise(0.0)
