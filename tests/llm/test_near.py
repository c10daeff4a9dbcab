"""Problem 3 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from skein.llm import p03_near as P3
from skein.llm.textwork import sliding_min


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def corpus(n=400):
    r = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.5:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.randint(15, 150))))
    return texts


def found(members, links):
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    near = {(r["a"], r["b"]) for r in links.collect()}
    out = set()
    for a in rep:
        for b in rep:
            if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in near):
                out.add((a, b))
    return out


def test_all_pairs_are_found(spark):
    texts = [*corpus(), None, "", "too short", *corpus(5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[7], (None, texts[0])], "doc_id bigint, text string")
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    got = found(*P3.near_classes(df))
    assert got == want and len(want) > 100
    assert found(*P3.near_classes(df, hot=3)) == want  # nearly all shared shingles are dealt to blocks


def test_near_copies_of_a_third_of_all_rows(spark):
    r = random.Random(11)
    base = [f"base{i}" for i in range(100)]
    texts = []
    for i in range(300):
        w = list(base) if i % 3 == 0 else [f"own{i}x{k}" for k in range(100)]
        for k in range(3):
            w[r.randrange(100)] = f"edit{i}x{k}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    got = found(*P3.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert got == want and len(want) > 4000


def test_empty_and_hot_class(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    members, links = P3.near_classes(none)
    assert members.count() == 0 and links.count() == 0
    same = spark.createDataFrame([(i, "the same long text " * 10) for i in range(500)], "doc_id bigint, text string")
    members, links = P3.near_classes(same)
    assert members.select("rep").distinct().count() == 1 and links.count() == 0


def test_samples_agree_as_often_as_weighted_jaccard():
    r = np.random.default_rng(1)
    table = P3.sample_tables(1)
    a, b = r.integers(0, 1 << 62, 300, dtype=np.uint64), r.integers(0, 1 << 62, 300, dtype=np.uint64)
    both = np.concatenate([a[:150], b])
    level = lambda x: (x % np.uint64(P3.LEVELS)).astype(np.int64)
    weight = lambda x: 2.0 ** ((level(x) + P3.LOWEST) / 2)
    true = weight(a[:150]).sum() / (weight(a).sum() + weight(b).sum())
    hits = 0
    for s in range(2000):
        odd = np.uint64((2 * s + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
        least = lambda x: (table[level(x), (x * odd) >> np.uint64(48)] | (x & np.uint64((1 << 40) - 1))).min()
        hits += least(a) == least(both)
    assert abs(hits / 2000 - true) < 0.05


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for width in range(1, 8):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width].tolist()) for i in range(len(x) - width + 1)]


def test_counters_do_not_hang_on_the_partitions(spark):
    texts = corpus(200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    one, n = P3.frequencies(df.coalesce(1))
    many, m = P3.frequencies(df.repartition(7))
    assert n == m == 200 and (one == many).all()
    counts = {}
    for t in texts:
        for s in shingle_set(t):
            counts[s] = counts.get(s, 0) + 1
    assert one.astype(bool).sum() > 0.99 * len(counts)


def test_rounded_counts():
    counts = np.array([0, 1, 15, 16, 17, 100, 10**6, 10**12])
    assert (np.diff(P3.rounded(np.arange(10**5)).astype(int)) >= 0).all()
    meant = P3.MEANT[P3.rounded(counts)]
    assert (abs(meant[1:7] - counts[1:7]) <= 0.06 * counts[1:7]).all()


def test_parities_bound_the_difference():
    r = np.random.default_rng(5)
    for _ in range(50):
        n, m = r.integers(20, 400, 2)
        x, y = (np.unique(r.integers(0, 1 << 62, k, dtype=np.uint64)) for k in (n, m))
        y[: min(n, m) // 2] = x[: min(n, m) // 2]
        y = np.unique(y)
        bits = [P3.parities(np.zeros(len(v), np.int64), v, np.array([len(v)]))[0] for v in (x, y)]
        differ = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([len(x)]), pa.array(bits[:1]), pa.array([len(y)]), pa.array(bits[1:])], list("abmxny"))
        kept = sum(b.num_rows for b in P3.close(iter([batch])))
        assert kept or 4 * differ > len(x) + len(y)


def test_a_crowded_key_meets_in_parts():
    n = 300
    rows = [np.repeat([5, 9], [n, 40]), np.arange(n + 40), np.append(np.full(n, 100 << 32), np.full(40, -1))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 37]) for c in rows], ["key", "d", "place"]) for k in range(0, n + 40, 37)]
    got = [p for b in P3.meetings(iter(batches)) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    assert len(got) == len(set(got))
    assert {p for p in got if p[0] < n} == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert {p for p in got if p[0] >= n} == {(i, j) for i in range(n, n + 40) for j in range(i + 1, min(i + 1 + P3.NEIGHBOURS, n + 40))}


def test_unrelated_holders_of_common_shingles_are_not_written(spark, monkeypatch):
    """As in a large collection every shingle has many holders: hardly any of their pairs reach the disk, and every turn holds its share only."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(words) for _ in range(120)) for _ in range(500)]
    for _ in range(20):
        w = r.choice(texts[:500]).split()
        w[r.randrange(120)] = r.choice(words)
        texts.append(" ".join(w))
    written = []
    kept = P3.materialize

    def counted(df, name):
        out = kept(df, name)
        if name == "p3-pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(P3, "materialize", counted)
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i in range(520) for j in range(i + 1, 520) if 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert found(*P3.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))) == want and len(want) >= 20
    assert sum(written) < 1000 and len(written) > 1  # of 134,940 pairs
