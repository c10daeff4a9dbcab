"""Problem 9: items of varying length in containers of fixed capacity, by first-fit decreasing.

Items are documents with their numbers of tokens.  An item over the capacity is split: all its whole
pieces fill a container each, and only its rest is packed.  Nothing else is split.  The others are
dealt to groups of about GROUP items by a hash of their id, and every group is packed on its own: in
order of falling size each item goes to the first container that has room, found by descending a
tournament tree of the containers' free space.  With groups of this size the last, half-filled
containers of the groups cost well under a thousandth of the space, and no task grows with the corpus.

Defined cases: a null or empty text has size 0 and takes its place in the first container of its
group; a document delivered twice counts once, with the larger size; null ids are dropped; capacities
that are null or below 1 are dropped; a model listed with several capacities is packed once for each; equal sizes are taken by rising id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.p08_encode import token_counts
from skein.llm.tables import table
from skein.session import materialize, ship

GROUP = 4096


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; the items are in order of falling size and none is over the capacity."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out.append(node - leaves)
        free[node] -= size
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return out


def pack_group(group: pa.Table) -> pa.Table:
    """model, capacity, grp, doc_id, piece, start, size -> the same with the container, without grp."""
    size, doc = group["size"].to_numpy(), group["doc_id"].to_numpy()
    order = np.lexsort((doc, -size))
    group = group.take(pa.array(order))
    grp = group["grp"][0].as_py()
    containers = [f"g{grp}-{k}" for k in first_fit(size[order].tolist(), group["capacity"][0].as_py())]
    return group.drop_columns(["grp"]).append_column("container", pa.array(containers, pa.string()))


def pack(sizes: DataFrame, capacities: DataFrame, group: int = GROUP) -> DataFrame:
    """sizes: doc_id BIGINT, n_tokens BIGINT; capacities: model STRING, capacity BIGINT, a small table.

    Returns model, capacity, doc_id, piece, start, size, container: tokens start .. start + size of the
    document lie in the container.
    """
    spark = sizes.sparkSession
    ship(spark)
    sizes = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = materialize(sizes, "p9-sizes")
    groups = max(1, -(-sizes.count() // group))
    models = [(r["model"], r["capacity"]) for r in capacities.where("capacity > 0").select("model", F.col("capacity").cast("bigint")).distinct().collect()]
    schema = "model string, capacity bigint, doc_id bigint, piece bigint, start bigint, size bigint, container string"
    if not models:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).cast("bigint").alias("capacity")) for m, c in models]))
    items = sizes.select("doc_id", "n_tokens", each.alias("m")).select("doc_id", "n_tokens", "m.model", "m.capacity").withColumn("whole", F.expr("n_tokens div capacity"))
    full = items.where("whole > 0").select("model", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
    full = full.select("*", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"), F.format_string("d%d-%d", "doc_id", "piece").alias("container"))
    rest = items.where("n_tokens = 0 or n_tokens % capacity > 0").select(
        "model", "capacity", F.pmod(F.xxhash64(F.lit("p9"), F.col("doc_id")), F.lit(groups)).alias("grp"), "doc_id", F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity")).alias("start"), (F.col("n_tokens") % F.col("capacity")).alias("size")
    )
    return rest.groupBy("model", "capacity", "grp").applyInArrow(pack_group, schema).unionByName(full)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pack(sizes, table(spark, sf_dir, "model_configs").select(F.col("name").alias("model"), F.col("context_length").alias("capacity")))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model: containers, the fewest that could do, tokens, and the share of space that is used."""
    used = p9_containers(spark, sf_dir).groupBy("model", "capacity", "container").agg(F.sum("size").alias("used"))
    out = used.groupBy("model", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"))
    return out.withColumn("n_least", F.expr("(n_tokens + capacity - 1) div capacity")).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
