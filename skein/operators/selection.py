"""Order, paging and limits: each is one sort or a top-k, never a walk of the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column | str], offset: int, count: int) -> DataFrame:
    """``count`` rows behind the first ``offset`` in a total order."""
    return rows.orderBy(*order).offset(offset).limit(count)


def first_successes(rows: DataFrame, ok: Column, order: list[Column | str], most: int) -> DataFrame:
    """The first rows that succeed; failures don't count."""
    return rows.where(ok).orderBy(*order).limit(most)


def shuffled(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """``most`` rows in the order of a hash of seed and key."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(most)


def sorted_paths(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def frequencies(rows: DataFrame, by: str, amount: str) -> DataFrame:
    """value, total: by falling total, equal ones by value."""
    return rows.groupBy(F.col(by).alias("value")).agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("total")).orderBy(F.col("total").desc(), "value")
