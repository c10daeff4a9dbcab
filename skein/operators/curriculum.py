"""Generators of verified exercises as tables: exhaustive pools, worked traces, tiling to targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordered import running_sum

#: Wordings and names of the places, from the units on (fixed values).
PREFIXES = ["Compute", "Find", "Evaluate", "Calculate", "Work out"]
PROOF_PREFIXES = ["Prove that", "Show that", "Explain why"]
PLACES = ["units", "tens", "hundreds", "thousands", "ten-thousands", "hundred-thousands", "millions", "ten-millions", "hundred-millions", "billions", "ten-billions", "hundred-billions"]


def dimension(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def fact_pool(spark: SparkSession) -> DataFrame:
    """All basic facts of one digit, in every wording: sums, products, quotients, differences."""
    x, y = spark.range(2, 10).toDF("x"), spark.range(2, 10).toDF("y")
    grid = x.join(y).join(dimension(spark, "prefix", PREFIXES))
    t = F.format_string
    facts = grid.select(
        F.explode(
            F.array(
                F.struct(t("%s %d + %d.", "prefix", "x", "y").alias("prompt"), (F.col("x") + F.col("y")).alias("answer")),
                F.struct(t("%s %d * %d.", "prefix", "x", "y").alias("prompt"), (F.col("x") * F.col("y")).alias("answer")),
                F.struct(t("%s %d / %d.", F.col("prefix"), F.col("x") * F.col("y"), F.col("y")).alias("prompt"), F.col("x").alias("answer")),
            )
        ).alias("r")
    ).select("r.*")
    a = spark.range(11, 19).toDF("a")
    less = a.join(y, F.expr("a - y between 1 and 9")).join(dimension(spark, "prefix", PREFIXES)).select(t("%s %d - %d.", "prefix", "a", "y").alias("prompt"), (F.col("a") - F.col("y")).alias("answer"))
    return facts.unionByName(less)


def digit_drills(spark: SparkSession, low: int = 10, high: int = 1000) -> DataFrame:
    n = spark.range(low, high).toDF("n")
    listing = F.array_join(F.reverse(F.split(F.col("n").cast("string"), "")), ", ")
    asked = F.array(*[F.format_string(form, "n") for form in ("List the digits of %d from the units place.", "What are the digits of %d, starting from the units?", "Read off the digits of %d from the units upward.")])
    return n.select(F.explode(asked).alias("prompt"), listing.alias("answer"))


def percent_pool(spark: SparkSession) -> DataFrame:
    p = spark.createDataFrame([(v,) for v in (5, 10, 20, 25, 50, 75)], "p bigint")
    return p.join(spark.range(1, 201).toDF("k")).select(F.format_string("What is %d%% of %d?", F.col("p"), F.col("k") * 20).alias("prompt"), F.expr("p * k * 20 div 100").alias("answer"))


def sum_pools(spark: SparkSession) -> DataFrame:
    n = spark.range(2, 100).toDF("n")
    odd = F.array(*[F.format_string(f, "n") for f in ("Find the sum of the first %d odd positive integers.", "What is 1 + 3 + 5 + ... through the first %d odd positive integers?", "Compute the sum of the first %d odd positive integers.")])
    tri = F.array(*[F.format_string(f, "n") for f in ("Find 1 + 2 + ... + %d.", "Find the sum of the first %d positive integers.", "Compute 1 + 2 + ... + %d.")])
    one = n.select(F.explode(odd).alias("prompt"), (F.col("n") * F.col("n")).alias("answer"))
    return one.unionByName(n.select(F.explode(tri).alias("prompt"), F.expr("n * (n + 1) div 2").alias("answer")))


def parity_proofs(spark: SparkSession, variables: list[str]) -> DataFrame:
    """Statements about the square of an even or odd number, in every wording and variable."""
    grid = dimension(spark, "prefix", PROOF_PREFIXES).join(dimension(spark, "v", variables)).join(dimension(spark, "parity", ["even", "odd"]))
    return grid.select(F.format_string("%s if %s is %s, then %s^2 is %s.", "prefix", "v", "parity", "v", "parity").alias("prompt"), F.format_string("%s^2 is %s", "v", "parity").alias("answer"))


def place(i: Column) -> Column:
    """Name of a place; beyond the named ones the power of ten."""
    return F.coalesce(F.get(F.array(*[F.lit(p) for p in PLACES]), i), F.concat(F.lit("10^"), i.cast("string")))


def digits_reversed(n: Column) -> Column:
    return F.transform(F.reverse(F.split(n.cast("string"), "")), lambda c: c.cast("int"))


def add_trace(a: Column, b: Column) -> Column:
    """Addition column by column with carries, for numbers from 0 on."""
    da, db = digits_reversed(a), digits_reversed(b)
    many = F.greatest(F.size(da), F.size(db))
    start = F.struct(F.lit(0).alias("carry"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, i: Column) -> Column:
        x, y = F.coalesce(F.get(da, i), F.lit(0)), F.coalesce(F.get(db, i), F.lit(0))
        total = x + y + s["carry"]
        carry = F.floor(total / 10).cast("int")
        carried = F.when(s["carry"] > 0, F.concat(F.lit(" + "), s["carry"].cast("string"), F.lit(" carried"))).otherwise("")
        on = F.when(carry > 0, F.concat(F.lit(", carry "), carry.cast("string"))).otherwise("")
        text = F.concat(place(i), F.lit(": "), x.cast("string"), F.lit(" + "), y.cast("string"), carried, F.lit(" = "), total.cast("string"), F.lit(", write "), (total % 10).cast("string"), on)
        return F.struct(carry.alias("carry"), F.concat(s["parts"], F.array(text)).alias("parts"))

    def finish(s: Column) -> Column:
        last = F.when(s["carry"] > 0, F.array(F.concat(F.lit("write the final carry "), s["carry"].cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array_join(F.concat(s["parts"], last), "; "), F.lit("; the digits give "), (a + b).cast("string"))

    return F.aggregate(F.sequence(F.lit(0), many - 1), start, step, finish)


def subtract_trace(a: Column, b: Column) -> Column:
    """Subtraction column by column with borrows, for a >= b >= 0."""
    da, db = digits_reversed(a), digits_reversed(b)
    start = F.struct(F.lit(0).alias("borrow"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, i: Column) -> Column:
        x, y = F.get(da, i), F.coalesce(F.get(db, i), F.lit(0)) + s["borrow"]
        shown = lambda v: v.cast("string")
        need = F.concat(place(i), F.lit(": "), shown(x), F.lit(" - "), shown(y), F.lit(" needs a borrow, so "), shown(x + 10), F.lit(" - "), shown(y), F.lit(" = "), shown(x + 10 - y))
        free = F.concat(place(i), F.lit(": "), shown(x), F.lit(" - "), shown(y), F.lit(" = "), shown(x - y))
        return F.struct(F.when(x < y, 1).otherwise(0).alias("borrow"), F.concat(s["parts"], F.array(F.when(x < y, need).otherwise(free))).alias("parts"))

    return F.aggregate(F.sequence(F.lit(0), F.size(da) - 1), start, step, lambda s: F.concat(F.array_join(s["parts"], "; "), F.lit("; the digits give "), (a - b).cast("string")))


def divide_trace(a: Column, b: Column) -> Column:
    """Long division digit by digit, for a >= 0 and b > 0."""
    start = F.struct(F.lit(0).cast("bigint").alias("r"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, ch: Column) -> Column:
        now = (s["r"] * 10 + ch.cast("bigint")).cast("bigint")
        digit = F.call_function("div", now, b.cast("bigint"))
        rest = (now - digit * b).cast("bigint")
        text = F.concat(F.lit("bring down "), ch, F.lit(" making "), now.cast("string"), F.lit("; "), b.cast("string"), F.lit(" * "), digit.cast("string"), F.lit(" = "), (digit * b).cast("string"), F.lit(", remainder "), rest.cast("string"))
        return F.struct(rest.alias("r"), F.concat(s["parts"], F.array(text)).alias("parts"))

    done = lambda s: F.concat(F.array_join(s["parts"], "; "), F.lit("; the quotient digits give "), F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast("string"))
    return F.aggregate(F.split(a.cast("string"), ""), start, step, done)


def partial_products(a: Column, b: Column) -> Column:
    """The place-value products of two numbers, as text in the order of the digits from the units."""
    da, db = digits_reversed(a), digits_reversed(b)
    zeros = lambda n, i: F.concat(n.cast("string"), F.repeat(F.lit("0"), i))
    pairs = F.flatten(F.transform(da, lambda x, i: F.transform(db, lambda y, j: F.struct(x.alias("x"), y.alias("y"), i.alias("i"), j.alias("j")))))
    pairs = F.filter(pairs, lambda p: (p["x"] > 0) & (p["y"] > 0))
    text = lambda p: F.concat(zeros(p["x"], p["i"]), F.lit(" * "), zeros(p["y"], p["j"]), F.lit(" = "), zeros(p["x"] * p["y"], p["i"] + p["j"]))
    return F.array_join(F.transform(pairs, text), "; ")


def tile(pool: DataFrame, count: int, order: str) -> DataFrame:
    """``count`` rows: row i is row i % n of the pool in the total order of ``order``."""
    base = running_sum(pool.withColumn("__g", F.lit(0)), ["__g"], [F.col(order)], F.lit(1), "__k").drop("__g")
    n = base.count()
    rows = pool.sparkSession.range(count).toDF("i")
    return rows.join(base, F.col("i") % n == F.col("__k")).drop("__k")


def targets(weights: dict[str, int], count: int, spark: SparkSession) -> DataFrame:
    """name, target: the count shared out by weight, rounded down."""
    total = sum(weights.values())
    return spark.createDataFrame([(k, w) for k, w in weights.items()], "name string, weight bigint").select("name", "weight", F.expr(f"{count} * weight div {total}").alias("target"))


def without_holdout(rows: DataFrame, holdout: DataFrame) -> DataFrame:
    """Rows whose prompt is none of the held-out ones, character for character."""
    return rows.join(holdout.select("prompt").distinct(), "prompt", "left_anti")


def learning_rate(step: Column, most_steps: int, warm: int, high: float, low: float) -> Column:
    """Linear warm-up, then half a cosine from high to low."""
    share = F.least(F.lit(1.0), (step - warm) / F.lit(float(max(1, most_steps - warm))))
    return F.when(step < warm, F.lit(high) * (step + 1) / F.lit(float(max(1, warm)))).otherwise(F.lit(low) + F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * share)) * (F.lit(high) - F.lit(low)))


def parameter_count(configs: DataFrame) -> DataFrame:
    """name, n_parameters: embeddings, per layer attention with grouped keys, gated feed-forward and two norms, the last norm, and the output unless it is tied."""
    h = F.col("hidden_size").cast("bigint")
    kv = F.expr("cast(n_kv_heads as bigint) * (hidden_size div n_heads)")
    layer = 2 * h * h + 2 * h * kv + 3 * h * F.col("intermediate_size") + 2 * h
    out = F.when(F.col("tie_embeddings"), F.lit(0).cast("bigint")).otherwise(h * F.col("vocab_size"))
    return configs.select("name", (h * F.col("vocab_size") + F.col("n_layers") * layer + h + out).cast("bigint").alias("n_parameters"))
