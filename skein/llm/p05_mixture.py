"""Problem 5: records of several buckets combined so that each bucket makes up its share of the total size.

Every record of bucket b gets the expected number of copies c = T * fraction / size(b), at most
max_repeats.  Each record has floor(c) copies for certain; the fractions are rounded by the pivotal
method: two records with fractions p and q meet, and one of them passes so much to the other, by a
random choice that keeps both expectations, that it becomes 0 or the other 1.  The number of copies of
a bucket is then fixed up to one, and as records meet in order of size, so is their total size up to
about one record.

Records are dealt to blocks of about BLOCK by a hash of their id.  Each block of a bucket is rounded on
its own and leaves at most one fractional record; FAN blocks' residuals are combined in the next
level, up to one per bucket, which is drawn at last.  No task sees more than one block.  The random
numbers come from hashes of the ids and a seed, so a rerun gives the same copies and another seed others.

The total T is a parameter; by default it is the largest at which all buckets with records reach their
share.  Fractions are taken as given and need not sum to 1.

Defined cases: of a record scored or retrieved again the latest row counts (status ok first); a size
that is missing or 0 is estimated from char_count (a quarter, at least 1), and a record without either
gets no copy; buckets are trimmed and lower-cased; records of buckets without target, and null ids, are
left out; a bucket without records can't reach its share and is reported with size 0; a null
max_repeats means 1, a negative one 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import folded, table
from skein.session import materialize, ship

BLOCK, FAN = 8192, 64
NEAR = 1e-9


def draw(doc: str, level: int, seed: int) -> float:
    return xxhash.xxh3_64_intdigest(doc, seed=(seed << 8) + level) / 2.0**64


def pivotal(docs: list[str], p: list[float], level: int, seed: int = 0) -> list[float]:
    """The fractions after the records met one after another; at most one is neither 0 nor 1."""
    out = list(p)
    held = -1
    for i in range(len(out)):
        if out[i] <= NEAR or out[i] >= 1 - NEAR:
            out[i] = float(round(out[i]))
            continue
        if held < 0:
            held = i
            continue
        a, b, u = out[held], out[i], draw(docs[i], level, seed)
        if a + b < 1 - NEAR:  # one falls to 0
            keep, lose = (held, i) if u < a / (a + b) else (i, held)
            out[keep], out[lose], held = a + b, 0.0, keep
        else:  # one rises to 1
            full, left = (held, i) if u < (1 - b) / (2 - a - b) else (i, held)
            out[full], out[left] = 1.0, a + b - 1
            held = left if out[left] > NEAR else -1
            if held < 0:
                out[left] = 0.0
    return out


def round_block(level: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        docs, size = group["doc_id"].to_pylist(), group["size"].to_numpy()
        order = sorted(range(len(docs)), key=lambda i: (size[i], docs[i]))
        rounded = np.empty(len(docs))
        rounded[order] = pivotal([docs[i] for i in order], [group["p"][i].as_py() for i in order] if len(order) < 32 else group["p"].to_numpy()[order].tolist(), level, seed)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(rounded))

    return run


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """records: doc_id STRING, bucket STRING, size BIGINT, one row per doc_id; targets: bucket, target_fraction, max_repeats, a small table with one row per bucket.

    Returns doc_id, bucket, size, copies BIGINT.
    """
    spark = records.sparkSession
    ship(spark)
    out_schema = "doc_id string, bucket string, size bigint, copies bigint"
    goal = {r["bucket"]: (r["target_fraction"] or 0.0, 1 if r["max_repeats"] is None else max(0, r["max_repeats"])) for r in targets.collect() if r["bucket"] is not None}
    if not goal:
        return spark.createDataFrame([], out_schema)
    named = spark.createDataFrame([(b,) for b in goal], "bucket string")
    records = materialize(records.where("doc_id is not null").join(F.broadcast(named), "bucket").select("doc_id", "bucket", "size"), "p5-records")
    have = {r["bucket"]: (int(r["n"]), int(r["s"])) for r in records.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).collect()}
    if total is None:
        reach = [goal[b][1] * s / goal[b][0] for b, (n, s) in have.items() if s > 0 and goal[b][0] > 0 and goal[b][1] > 0]
        total = int(min(reach, default=0))
    plan = [(b, min(float(goal[b][1]), total * goal[b][0] / s) if s > 0 else 0.0, -(-n // BLOCK)) for b, (n, s) in have.items()]
    rates = spark.createDataFrame(plan, "bucket string, rate double, blocks bigint") if plan else spark.createDataFrame([], "bucket string, rate double, blocks bigint")
    level = 0
    rows = records.join(F.broadcast(rates), "bucket").select(
        "doc_id", "bucket", F.coalesce("size", F.lit(0)).alias("size"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"),
        F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("bigint").alias("base"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p"),
    )
    schema = "doc_id string, bucket string, size bigint, block bigint, base bigint, p double"
    settled = []
    blocks = max([k for _, _, k in plan], default=0)
    while True:
        rows = materialize(rows.groupBy("bucket", "block").applyInArrow(round_block(level, seed), schema), f"p5-level{level}")
        settled.append(rows.where("p = 0 or p = 1"))
        rows = rows.where("p > 0 and p < 1").withColumn("block", F.expr(f"block div {FAN}"))
        if blocks <= 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
    last = rows.withColumn("p", F.when(F.pmod(F.xxhash64("doc_id", F.lit(level), F.lit(seed)), F.lit(1 << 30)) / (1 << 30) < F.col("p"), 1.0).otherwise(0.0))
    done = last
    for part in settled:
        done = done.unionByName(part)
    return done.select("doc_id", "bucket", "size", (F.col("base") + F.col("p").cast("bigint")).alias("copies"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    features = table(spark, sf_dir, "document_features", "doc_id", "mixture_bucket", "scored_at").where("doc_id is not null")
    bucket = folded(F.col("mixture_bucket")).alias("bucket")
    newest = features.groupBy("doc_id").agg(F.max(F.struct("scored_at", bucket)).getField("bucket").alias("bucket"))
    catalog = table(spark, sf_dir, "doc_catalog", "doc_id", "token_estimate", "char_count", "status", "retrieved_at").where("doc_id is not null")
    size = F.expr("case when token_estimate > 0 then token_estimate when char_count > 0 then greatest(1, char_count div 4) end").cast("bigint").alias("size")
    sizes = catalog.groupBy("doc_id").agg(F.max(F.struct(F.coalesce(F.col("status") == "ok", F.lit(False)).alias("ok"), "retrieved_at", size)).getField("size").alias("size"))
    spec = table(spark, sf_dir, "mixture_spec", "ord", "bucket", "target_fraction", "max_repeats")
    targets = spec.groupBy(folded(F.col("bucket")).alias("bucket")).agg(F.min(F.struct("ord", "target_fraction", "max_repeats")).alias("r")).select("bucket", "r.target_fraction", "r.max_repeats")
    return newest.join(sizes, "doc_id", "left"), targets


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*inputs(spark, sf_dir))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each bucket: wanted and actual share of the total, records, used records, most copies of one."""
    records, targets = inputs(spark, sf_dir)
    copies = mix(records, targets)
    out = copies.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum((F.col("copies") > 0).cast("bigint")).alias("n_used"), F.max("copies").alias("most_copies"), F.sum(F.col("size") * F.col("copies")).alias("actual_size")
    )
    out = materialize(out, "p5-report")  # a row for each bucket of the targets
    whole = out.agg(F.coalesce(F.sum("actual_size"), F.lit(0))).first()[0]
    out = targets.join(F.broadcast(out), "bucket", "left")
    return out.select(
        "bucket", "target_fraction", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("actual_size", F.lit(0)).alias("actual_size"), (F.coalesce("actual_size", F.lit(0)) / F.lit(float(max(1, whole)))).alias("actual_share"),
    )
