"""Order-dependent operators without a single-task window.

A running sum over a group that may hold most of the rows is taken in two steps: rows are ranged by
(group, order), each range sums its own part, and the totals of the ranges before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group before this one, in ``order``, which must be total."""
    return running_sums(df, group, order, {name: value})


def running_sums(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """The same for several values in one pass."""
    ranged = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    ranged = ranged.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "running")
    totals = ranged.groupBy(*group, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values])
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(totals, [*group, "__part"])
    out = out.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) + F.col(f"__b_{n}") for n in values})
    return out.drop("__part", *[f"__{k}_{n}" for k in "vb" for n in values])


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``is_first``: whether the row is the first of its key.

    ``df`` is narrow; it is written once, as both sides of the join read it.  The least row of each key is
    combined before the shuffle, and it is found again by its key and order together, which spread evenly however
    many rows a key has.  A row without a key is a duplicate of nothing; rows that are equal in key and order are
    all first.
    """
    df = materialize(df, "keyed")
    first = F.min(F.struct(*order))
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("__first"))
    least = least.select(F.col(key).alias("__key"), *[F.col("__first")[c].alias(f"__{c}") for c in order], F.lit(True).alias("__hit"))
    same = F.col(key) == F.col("__key")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = df.join(least, same, "left").withColumn("is_first", F.col(key).isNull() | F.coalesce("__hit", F.lit(False)))
    return out.drop("__key", "__hit", *[f"__{c}" for c in order])
