"""Problems 5, 7 and 9: mixtures, cutoffs, containers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.llm import p05_mixture as P5
from skein.llm import p07_cutoff as P7
from skein.llm import p09_pack as P9


def kth(scores, percent):
    k = min(len(scores), max(0, math.ceil(percent * len(scores) / 100)))
    return sorted(scores, reverse=True)[k - 1] if k else None


@pytest.mark.parametrize("snap", [0, 4, 256])
def test_cutoffs_are_the_exact_order_statistics(spark, monkeypatch, snap):
    monkeypatch.setattr(P7, "SNAP", snap)
    r = random.Random(snap)
    scores = {"ties": [r.choice([0.1, 0.5, 0.9]) for _ in range(200)], "one": [0.25] * 50, "wide": [10.0 ** r.uniform(-12, 12) for _ in range(400)], "single": [3.5], "fine": [r.random() for _ in range(700)], "signed": [r.gauss(0, 1) for _ in range(300)]}
    rows = [(s, x) for s, xs in scores.items() for x in xs] + [("ties", None), ("ties", float("nan")), (None, 0.5), ("other", 0.5)]
    for percent in (0, 1, 37, 50, 99, 100):
        targets = spark.createDataFrame([(s, percent) for s in scores] + [("none", 5), ("nothing", None)], "source string, keep_percent int")
        out = {r["source"]: r for r in P7.score_cutoffs(spark.createDataFrame(rows, "source string, score double"), targets).collect()}
        assert set(out) == set(scores)
        for s, xs in scores.items():
            want = kth(xs, percent)
            assert out[s]["cutoff"] == want and out[s]["n_kept"] == (sum(x >= want for x in xs) if want is not None else 0), (s, percent)


def test_cutoffs_of_nothing(spark):
    none = spark.createDataFrame([], "source string, score double")
    assert P7.score_cutoffs(none, spark.createDataFrame([("a", 5)], "source string, keep_percent int")).count() == 0


def test_pivotal_keeps_the_sum():
    r = random.Random(2)
    for n in (0, 1, 2, 50, 999):
        p = [r.random() for _ in range(n)]
        out = P5.pivotal([str(i) for i in range(n)], p, 0)
        assert abs(sum(out) - sum(p)) < 1e-6 and sum(0 < x < 1 for x in out) <= 1


def test_pivotal_keeps_the_chances():
    p = [0.2, 0.7, 0.5, 0.6]
    hits = [0] * 4
    for t in range(4000):
        for i, x in enumerate(P5.pivotal([f"{t}-{k}" for k in range(4)], p, 1)):
            hits[i] += x
    assert all(abs(h / 4000 - q) < 0.04 for h, q in zip(hits, p))


def test_mixture_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(P5, "BLOCK", 50)
    monkeypatch.setattr(P5, "FAN", 3)
    r = random.Random(1)
    rows = [(f"d{i}", "big" if i % 3 else "small", r.randint(1, 100)) for i in range(3000)] + [("x", "small", None), ("y", "small", 0), (None, "small", 5), ("z", "unknown", 5)]
    records = spark.createDataFrame(rows, "doc_id string, bucket string, size bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("empty", 0.1, 1)], "bucket string, target_fraction double, max_repeats int")
    for total in (None, 20_000, 100_000):
        out = P5.mix(records, targets, total).collect()
        assert len(out) == 3002 and len({r["doc_id"] for r in out}) == 3002
        assert max(r["copies"] for r in out if r["bucket"] == "small") <= 3 and max(r["copies"] for r in out if r["bucket"] == "big") <= 1
        assert all(r["copies"] == 0 for r in out if r["doc_id"] in ("x", "y"))
        got = {b: sum(r["size"] * r["copies"] for r in out if r["bucket"] == b) for b in ("big", "small")}
        if total:
            assert abs(got["big"] - 0.4 * total) <= 200 and abs(got["small"] - 0.6 * total) <= 200
        else:
            assert abs(got["big"] / got["small"] - 4 / 6) < 0.01
        assert out and sorted(map(tuple, out)) == sorted(map(tuple, P5.mix(records, targets, total).collect()))
    assert P5.mix(records.limit(0), targets).count() == 0


def test_first_fit_is_first_fit():
    r = random.Random(4)
    for _ in range(50):
        sizes = sorted((r.randint(0, 100) for _ in range(r.randint(1, 60))), reverse=True)
        bins, want = [], []
        for s in sizes:
            k = next((k for k, used in enumerate(bins) if used + s <= 100), len(bins))
            if k == len(bins):
                bins.append(0)
            bins[k] += s
            want.append(k)
        assert P9.first_fit(sizes, 100) == want


def test_containers(spark):
    r = random.Random(9)
    rows = [(i, r.choice([0, 5, 60, 100, 101, 350, r.randint(1, 99)])) for i in range(900)] + [(3, 1), (None, 7)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    models = spark.createDataFrame([("m", 100), ("n", 64), ("bad", 0), ("null", None)], "model string, capacity int")
    out = P9.pack(sizes, models, group=128)
    used = out.groupBy("model", "capacity", "container").agg(F.sum("size").alias("used"))
    assert used.where("used > capacity").count() == 0
    want = {}
    for i, n in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), n)
    for model, cap in (("m", 100), ("n", 64)):
        mine = [x for x in out.collect() if x["model"] == model]
        total = {}
        for x in mine:
            total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["size"]
        assert total == want
        assert all(len([x for x in mine if x["doc_id"] == d]) == max(1, -(-n // cap)) for d, n in list(want.items())[:100])
    assert P9.pack(sizes.limit(0), models).count() == 0


def test_mixture_report(spark, tmp_path):
    spark.createDataFrame([(f"d{i}", " Big " if i % 2 else "small", None, float("nan")) for i in range(400)], "doc_id string, mixture_bucket string, scored_at timestamp, quality_score double").write.parquet(f"{tmp_path}/document_features.parquet")
    spark.createDataFrame([(f"d{i}", 10 if i % 5 else None, 40, "ok", 1) for i in range(400)], "doc_id string, token_estimate bigint, char_count bigint, status string, retrieved_at bigint").write.parquet(f"{tmp_path}/doc_catalog.parquet")
    spark.createDataFrame([(1, "big", 0.75, 1), (2, "small", 0.25, 2), (3, "none", 0.1, 1)], "ord int, bucket string, target_fraction double, max_repeats int").write.parquet(f"{tmp_path}/mixture_spec.parquet")
    out = {r["bucket"]: r for r in P5.p5_report(spark, str(tmp_path)).collect()}
    assert abs(out["big"]["actual_share"] - 0.75) < 0.02 and abs(out["small"]["actual_share"] - 0.25) < 0.02 and out["none"]["actual_size"] == 0
