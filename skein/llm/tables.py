"""Reading of the tables, and small expressions that the operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import spread


#: Tables whose rows are costly.
TEXTUAL = ("documents", "sft_examples")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name in TEXTUAL else df


def folded(column: Column) -> Column:
    """Without blanks around it, in lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


#: Members of a class that meet in one piece.
SPLIT = 1000


def expand(links: DataFrame, left: DataFrame, right: DataFrame, split: int = SPLIT) -> DataFrame:
    """links: a, b; left: a, x; right: b, y. Returns a, b, x, y: all members of linked classes.

    A class of more than ``split`` members is dealt to blocks by a hash, and every pair of blocks meets on its own, so a
    class that holds a third of all rows is no single task.
    """

    def dealt(members: DataFrame, key: str, member: str, block: str) -> tuple[DataFrame, DataFrame]:
        large = members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select(key, F.ceil(F.col("n") / split).cast("bigint").alias("blocks"))
        rows = members.join(large, key, "left").select(key, member, F.coalesce(F.pmod(F.xxhash64(F.col(member)), F.col("blocks")), F.lit(0)).alias(block))
        return large, rows

    for members, key, member, block in ((left, "a", "x", "i"), (right, "b", "y", "j")):
        large, rows = dealt(members, key, member, block)
        links = links.join(large, key, "left").withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        links = links.join(rows, [key, block]).drop(block)
    return links.select("a", "b", "x", "y")


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """slots: slot BIGINT. The bitmap of all slots, of fixed size, put together from parts of 32,768 bits."""
    parts = slots.groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, data in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(data, np.uint8)[:4096]
    return out
