"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as set them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often and however deep they are used later.

    A generator of one element keeps the optimizer from copying the expressions into every use.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def running_starts(lengths: Column, step: int = 256) -> Column:
    """Sums of the elements before each element of an array of longs, and after the last one the sum of all.

    Elements are folded in slices, so that no array grows element by element over its whole length.
    """
    zero = F.lit(0).cast("long")

    def grow(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    size = F.size(lengths)
    firsts = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    sums = F.transform(firsts, lambda at: F.aggregate(F.slice(lengths, at, F.lit(step)), zero, lambda a, x: a + x))
    offsets = grow(sums, zero)
    inner = F.transform(firsts, lambda at, i: F.slice(
        grow(F.slice(lengths, at, F.lit(step)), F.get(offsets, i)), 1, F.least(F.lit(step), size - at + 1)))
    return F.concat(F.flatten(inner), F.array(F.element_at(offsets, -1)))
