"""Problem 7: a score cutoff per source that keeps a target share of the source's records.

The cutoff of a source with N records, of which k are to be kept, is its k-th highest score, that is
the j-th smallest with j = N - k + 1.  It minimises the convex pinball loss

    f(c) = (j - 1/2) * sum(x - c for x > c) + (N - j + 1/2) * sum(c - x for x < c)

whose only minimiser is the j-th smallest score.  Every round evaluates f and a subgradient of all
open sources in one aggregation; the next point of a source is where the tangents at the two ends of
its bracket meet (Kelley's cutting plane in one dimension).  As soon as a bracket holds at most
``SNAP`` distinct scores they are fetched and the exact neighbouring score is taken.  The driver holds
one small record per source of the target table, and at most ``SNAP`` scores of each open source.

Scores are first counted per (source, score), so that a source with a third of all rows is combined
before the shuffle and no task ever holds the scores of a source.

Defined cases: null or NaN scores and null sources are dropped; a source with no record left has no
row; a source without target, or with a null one, has no row; ties at the cutoff are all kept; a
target of 0 or less keeps nothing and has a null cutoff, one of 100 or more keeps everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import folded, table
from skein.session import materialize

#: Distinct scores of a bracket that are few enough to be fetched.
SNAP = 256
#: Rounds after which the bracket is halved every other time, for scores of extreme spread.
PATIENCE = 8


@dataclass
class Bracket:
    """Where the cutoff of a source lies: lo <= cutoff <= hi, both of them scores of the source."""

    n: int
    k: int
    lo: float
    hi: float
    f_lo: float
    f_hi: float
    g_lo: float
    g_hi: float
    above: int = 0  # records with a score over hi
    inside: int = 1 << 62  # distinct scores strictly between lo and hi
    cutoff: float | None = None
    done: bool = False

    def weights(self) -> tuple[float, float]:
        j = self.n - self.k + 1
        return j - 0.5, self.n - j + 0.5

    def next_point(self, turn: int) -> float:
        middle = self.lo + (self.hi - self.lo) / 2
        if turn > PATIENCE and turn % 2:
            return middle
        slope = self.g_lo - self.g_hi
        if not slope:
            return middle
        point = (self.f_hi - self.f_lo + self.g_lo * self.lo - self.g_hi * self.hi) / slope
        return point if self.lo < point < self.hi else middle


def score_cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """records: source STRING, score DOUBLE; targets: source STRING, keep_percent INT, one row per source.

    Returns source, keep_percent, n_records, n_wanted BIGINT, cutoff DOUBLE, n_kept BIGINT.
    """
    spark = records.sparkSession
    wanted = {r["source"]: r["keep_percent"] for r in targets.where("source is not null and keep_percent is not null").select("source", "keep_percent").collect()}
    schema = "source string, keep_percent int, n_records bigint, n_wanted bigint, cutoff double, n_kept bigint"
    known = spark.createDataFrame([(s,) for s in wanted], "source string")
    valid = records.where(F.col("score").isNotNull() & ~F.isnan("score")).join(F.broadcast(known), "source")
    counts = materialize(valid.groupBy("source", "score").agg(F.count(F.lit(1)).alias("n")), "p7-counts")

    open_: dict[str, Bracket] = {}
    first = counts.groupBy("source").agg(F.sum("n").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum(F.col("score") * F.col("n")).alias("s"))
    for r in first.collect():
        n, percent = r["n"], wanted[r["source"]]
        k = min(n, max(0, (percent * n + 99) // 100))
        b = Bracket(n, k, r["lo"], r["hi"], 0, 0, 0, 0)
        up, down = b.weights()
        b.f_lo, b.g_lo = up * (r["s"] - n * b.lo), -up * n
        b.f_hi, b.g_hi = down * (n * b.hi - r["s"]), down * n
        if k == 0:
            b.done = True
        elif b.lo == b.hi:
            b.cutoff, b.done = b.lo, True
        open_[r["source"]] = b

    turn = 0
    while any(not b.done and b.inside > SNAP for b in open_.values()):
        points = [(s, b.lo, b.hi, b.next_point(turn)) for s, b in open_.items() if not b.done and b.inside > SNAP]
        at = spark.createDataFrame(points, "source string, lo double, hi double, c double")
        x, c, n = F.col("score"), F.col("c"), F.col("n")
        total = lambda condition, value: F.sum(F.when(condition, value).otherwise(0))
        found = counts.join(F.broadcast(at), "source").groupBy("source", "c").agg(
            total(x < c, n).alias("n_lt"), total(x == c, n).alias("n_eq"), total(x > c, n).alias("n_gt"),
            total(x < c, (c - x) * n).alias("s_lt"), total(x > c, (x - c) * n).alias("s_gt"),
            total((x < c) & (x > F.col("lo")), F.lit(1)).alias("m_lt"), total((x > c) & (x < F.col("hi")), F.lit(1)).alias("m_gt"),
            F.max(F.when(x < c, x)).alias("below"), F.min(F.when(x > c, x)).alias("over"),
        )
        for r in found.collect():
            b = open_[r["source"]]
            up, down = b.weights()
            loss = up * r["s_gt"] + down * r["s_lt"]
            if r["n_gt"] < b.k <= r["n_gt"] + r["n_eq"]:
                b.cutoff, b.done = r["c"], True
            elif r["n_gt"] >= b.k:  # the minimum is to the right; the least score there is the new end
                b.f_lo, b.g_lo, b.lo = loss, down * r["n_lt"] + down * r["n_eq"] - up * r["n_gt"], r["c"]
                b.inside = r["m_gt"]
                if b.inside == 0:
                    b.cutoff, b.done = b.hi, True
            else:
                b.f_hi, b.g_hi, b.hi = loss, down * r["n_lt"] - up * (r["n_eq"] + r["n_gt"]), r["c"]
                b.inside, b.above = r["m_lt"], r["n_gt"] + r["n_eq"]
                if b.inside == 0:
                    b.cutoff, b.done = b.lo, True
        turn += 1

    last = [(s, b.lo, b.hi) for s, b in open_.items() if not b.done]
    if last:  # snap: at most SNAP + 2 distinct scores of each source are left
        at = spark.createDataFrame(last, "source string, lo double, hi double")
        near = counts.join(F.broadcast(at), "source").where("score >= lo and score <= hi").select("source", "score", "n")
        above = {s: open_[s].above for s, _, _ in last}
        for r in sorted(near.collect(), key=lambda r: -r["score"]):
            b = open_[r["source"]]
            if b.done or (b.above and r["score"] >= b.hi):  # records at hi are in above already
                continue
            above[r["source"]] += r["n"]
            if above[r["source"]] >= b.k:
                b.cutoff, b.done = r["score"], True
    rows = spark.createDataFrame([(s, int(wanted[s]), b.n, b.k, b.cutoff) for s, b in open_.items()], "source string, keep_percent int, n_records bigint, n_wanted bigint, cutoff double")
    kept = counts.join(F.broadcast(rows), "source").groupBy("source").agg(F.sum(F.when(F.col("score") >= F.col("cutoff"), F.col("n")).otherwise(0)).alias("n_kept"))
    return rows.join(F.broadcast(kept), "source", "left").select(*[c.split()[0] for c in schema.split(", ")])


def latest_scores(features: DataFrame) -> DataFrame:
    """doc_id, bucket, score: of each document the row latest by scored_at (then the greater score and bucket)."""
    newest = features.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("scored_at", "quality_score", folded(F.col("mixture_bucket")).alias("bucket"))).alias("r"))
    return newest.select("doc_id", F.col("r.bucket").alias("bucket"), F.col("r.quality_score").alias("score"))


def targets_of(spec: DataFrame) -> DataFrame:
    """source, keep_percent: of buckets named twice the first by ord."""
    first = spec.groupBy(folded(F.col("bucket")).alias("source")).agg(F.min(F.struct("ord", "keep_percent")).alias("r"))
    return first.select("source", F.col("r.keep_percent").alias("keep_percent"))


def valid_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    features = table(spark, sf_dir, "document_features", "doc_id", "mixture_bucket", "quality_score", "scored_at")
    targets = targets_of(table(spark, sf_dir, "mixture_spec", "ord", "bucket", "keep_percent"))
    records = latest_scores(features).where("score is not null and not isnan(score) and score >= 0 and score <= 1")
    return records, targets


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, targets = valid_records(spark, sf_dir)
    cutoffs = score_cutoffs(records.select(F.col("bucket").alias("source"), "score"), targets)
    return records.join(F.broadcast(cutoffs.select("source", "cutoff")), F.col("bucket") == F.col("source")).where("score >= cutoff").select("doc_id").distinct()


def p7_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, targets = valid_records(spark, sf_dir)
    return score_cutoffs(records.select(F.col("bucket").alias("source"), "score"), targets)
