import os
import sys
from types import SimpleNamespace
from urllib.parse import urldefrag, urljoin

import pytest
import __spark_entry__
from pyspark.sql import functions as F

from skein.operators import catalog as K
from skein.operators import curate as U
from skein.operators import curriculum as G
from skein.operators import orchestrate as O
from skein.operators import scoring as S
from skein.operators import shards as H
from skein.operators import web as W
from skein.operators.ordered import first_of, running_sum, running_sums
from skein.session import materialize, release, shared_dir


def test_running_sum_over_one_large_group(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).alias("v")).repartition(5)
    got = {r["id"]: r["s"] for r in running_sum(df, ["g"], [F.col("id").desc()], F.col("v"), "s").collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1, 500)) for i in range(500)}


@pytest.mark.parametrize("sizes,target,want", [([40, 70, 10, 90, 5], 100, [1, 1, 2, 2, 3]), ([90, 90, 20, 90], 100, [1, 1, 2, 2]), ([100, 0], 100, [1, 2])])
def test_text_shards(spark, sizes, target, want):
    df = spark.createDataFrame([(i, i, n) for i, n in enumerate(sizes)], "doc_id bigint, ord bigint, n_chars bigint").repartition(3)
    assert [r["shard_idx"] for r in H.text_shards(df, target).orderBy("ord").collect()] == want


def test_token_shards(spark):
    df = spark.createDataFrame([(i, 3) for i in range(3)], "doc_id bigint, n_tokens bigint")
    rows = H.token_shards(df, 4, [F.col("doc_id")])
    assert [r[1] for r in rows.groupBy("shard_idx").agg(F.sum("n")).orderBy("shard_idx").collect()] == [4, 4, 1]


def test_masked_labels(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], 3), ([1], 1), ([], 0)], "ids array<int>, p int")
    assert [r[0] for r in df.select(H.masked_labels(F.col("ids"), F.col("p"), 64)).collect()] == [[-100, -100, 4, 5, 6], [], []]
    assert spark.range(1).select(H.padded(F.array(F.lit(1)), F.lit(3), 0)).first()[0] == [1, 0, 0]


def test_budget_takes_the_crossing_document(spark):
    pool = spark.createDataFrame([(1, "b", 0.9, 60), (2, "b", 0.8, 60), (3, "b", 0.7, 10)], "doc_id bigint, bucket string, quality double, n_tokens bigint")
    mixture = spark.createDataFrame([("b", 1.0)], "bucket string, target_fraction double")
    assert sorted(r["doc_id"] for r in U.budgeted_sample(pool, mixture, 100).collect()) == [1, 2]


def test_split_has_one_row_at_least(spark):
    out = U.split_off(spark.range(10).toDF("doc_id"), 0.005)
    assert {r[0]: r[1] for r in out.groupBy("split").count().collect()} == {"val": 1, "train": 9}


def test_order_of_checks(spark):
    long = "def f():\n    return 1\n" * 40
    docs = spark.createDataFrame([(1, "a", "short"), (2, "b", "short"), (3, "a", long), (4, "b", long), (5, "c", "word " * 100), (6, "d", "word " * 100), (7, "e", None)], "doc_id bigint, source string, text string")
    assert {r["doc_id"]: r["reason"] for r in U.reasons_science(docs).collect()} == {1: "too_short", 2: "too_short", 3: "kept", 4: "duplicate", 5: "kept", 6: "duplicate", 7: "unreadable"}
    assert {r["doc_id"]: r["reason"] for r in U.reasons_code(docs).collect()} == {1: "too_short", 2: "too_short", 3: "kept", 4: "duplicate", 5: "low_structure", 6: "duplicate", 7: "unreadable"}


def test_copy_of_an_excluded_document_is_a_duplicate(spark):
    text = "Theorem. " * 200
    docs = spark.createDataFrame([(1, "a_excluded", "MIT", "text", text), (2, "textbook_b", "MIT", "text", text)], "doc_id bigint, source string, license string, source_type string, text string")
    mixture = spark.createDataFrame([(1, "textbook_notes", 0.5, 0.1, [])], "ord int, bucket string, target_fraction double, min_quality double, sources array<string>")
    got = {r["doc_id"]: r["reason"] for r in U.reasons_v2(U.features(docs), mixture, ["a_excluded"]).collect()}
    assert got == {1: "excluded_source", 2: "near_duplicate"}


def test_upsert_and_resume(spark):
    rows = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("b", 1, "error")], "doc_id string, retrieved_at bigint, status string")
    assert sorted(map(tuple, K.upsert(rows).collect())) == [("a", 2, "ok"), ("b", 1, "error")]
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert [r[0] for r in K.resume(todo, rows).collect()] == ["c"]
    assert sorted(r[0] for r in K.resume(todo, rows, any_status=False).collect()) == ["b", "c"]


def test_links_and_crawl(spark):
    page = '<a href="/b">x</a> <A class=q href=\'c#f\'>y</A> <a href="mailto:z">m</a> <a href="//h.org/d">d</a> <a href="#t">t</a>'
    pages = spark.createDataFrame([("https://x.org/p/a", page), ("https://x.org/b", '<a href="https://x.org/e">e</a>'), ("https://x.org/e", ""), ("https://h.org/d", "")], "url string, html string")
    assert [tuple(r) for r in W.links(pages).where("url = 'https://x.org/p/a'").orderBy("pos").collect()] == [("https://x.org/p/a", 0, "https://x.org/b"), ("https://x.org/p/a", 1, "https://x.org/p/c"), ("https://x.org/p/a", 3, "https://h.org/d")]
    seeds = spark.createDataFrame([("https://x.org/p/a",)], "url string")
    assert {tuple(r) for r in W.crawl(pages, seeds, 3, ["x.org"]).collect()} == {("https://x.org/p/a", 0), ("https://x.org/b", 1), ("https://x.org/e", 2)}


def test_traces(spark):
    df = spark.createDataFrame([(57, 68, 7)], "a bigint, b bigint, c bigint")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert df.select(G.add_trace(a, b)).first()[0] == "units: 7 + 8 = 15, write 5, carry 1; tens: 5 + 6 + 1 carried = 12, write 2, carry 1; write the final carry 1; the digits give 125"
    assert df.select(G.subtract_trace(b, a)).first()[0] == "units: 8 - 7 = 1; tens: 6 - 5 = 1; the digits give 11"
    assert df.select(G.divide_trace(a, c)).first()[0] == "bring down 5 making 5; 7 * 0 = 0, remainder 5; bring down 7 making 57; 7 * 8 = 56, remainder 1; the quotient digits give 8"
    assert df.select(G.partial_products(a, c)).first()[0] == "7 * 7 = 49; 50 * 7 = 350"


def test_pools(spark):
    assert G.fact_pool(spark).count() == (64 * 3 + 36) * 5
    assert G.digit_drills(spark).count() == 990 * 3
    held = spark.createDataFrame([("Find 1 + 2 + ... + 25.",)], "prompt string")
    assert G.without_holdout(G.sum_pools(spark), held).count() == 98 * 6 - 1
    assert G.tile(G.percent_pool(spark).limit(3), 7, "prompt").count() == 7


def test_plans(spark):
    rows = [("A car travels at 3 m/s and accelerates at 4 m/s^2 for 5 s. Find its final velocity.", 23), ("An engine does 84 J of work in 7 s. Find its power output.", 12), ("A 2 kg object is lifted to a height of 3 m. Find its potential energy. Use g = 10 m/s^2.", 60), ("Hello", None)]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string").withColumn("r", O.execute(O.decompose(F.col("p"))))
    assert [r["r"]["answer"] if r["r"] else None for r in df.collect()] == [a for _, a in rows]
    mute = spark.createDataFrame([(rows[0][0],)], "p string").select(O.execute(O.decompose(F.col("p")), lambda op, a, b: F.lit("no idea")).alias("r")).first()["r"]
    assert (mute["answer"], mute["ok"]) == (None, False)


def test_reports(spark):
    df = spark.createDataFrame([(i, "add" if i < 6 else "sub", "m1" if i % 2 else "m2", i % 3 == 0) for i in range(10)], "i bigint, family string, model string, hit boolean")
    assert {r["family"]: (r["n_hits"], r["n"]) for r in S.accuracy(df).collect()} == {"add": (2, 6), "sub": (2, 4), None: (4, 10)}
    assert [tuple(r) for r in S.running_accuracy(df, "i", 5).orderBy("n").collect()] == [(5, 2), (10, 4)]
    table = {r["family"]: (r["m1"], r["m2"]) for r in S.pivot(df, ["m1", "m2"]).collect()}
    assert table == {"add": ("1/3", "1/3"), "sub": ("1/2", "1/2"), "**overall**": ("2/5", "2/5")}
    logits = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([5, 4, 1, 0])], "step bigint, token bigint, logit double")
    assert sorted(r["token"] for r in S.top_p(logits, 3, 0.9).collect()) == [0, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, license string, source_type string, text string")
    assert U.features(none).count() == 0 and U.reasons_science(none).count() == 0
    assert H.token_shards(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 4, [F.col("doc_id")]).count() == 0


def test_references_resolve_as_in_the_standard(spark):
    bases = ["https://x.org/p/a?z=1", "https://x.org", "https://x.org/", "http://h.org/a/b/c/d;p?q#f", "https://x.org/a//b/"]
    refs = ["?q=2", "../b", "./d", "b", "/b/../c", "//h.org/x?y", "https://o.org/a#f", "../../../g", "g/./h/../i", ".", "..", "g?y#s", "/", "a b", "x//y", "b/"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    for row in df.select("base", "ref", W.resolved(F.col("base"), F.col("ref")).alias("got")).collect():
        assert row["got"] == urldefrag(urljoin(row["base"], row["ref"]))[0], row
    page = spark.createDataFrame([("https://x.org/p/", "<a href=' q?a=1&amp;b=2 '>x</a> <a class=c href=\"&#47;r\">y</a>")], "url string, html string")
    assert [r["link"] for r in W.links(page).orderBy("pos").collect()] == ["https://x.org/p/q?a=1&b=2", "https://x.org/r"]


def test_first_of_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a", "k"), (3, "b", None), (4, None, "k"), (5, None, "m")], "doc_id bigint, source string, k string")
    got = {r["doc_id"]: r["is_first"] for r in first_of(df, "k", ["source", "doc_id"]).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}  # nulls order first


def test_several_running_sums(spark):
    df = spark.range(50).select("id", F.lit("g").alias("g"))
    rows = running_sums(df, ["g"], [F.col("id")], {"n": F.lit(1), "s": F.col("id")}).collect()
    assert {(r["id"], r["n"], r["s"]) for r in rows} == {(i, i, i * (i - 1) // 2) for i in range(50)}


def test_traces_of_long_numbers(spark):
    a, b = 999_999_999_999_999, 2
    row = spark.range(1).select(G.add_trace(F.lit(a), F.lit(b)).alias("t"), G.partial_products(F.lit(900_000_000_000_000_003), F.lit(9_000_000_000_000_000_007)).alias("p")).first()
    assert row["t"].endswith("; the digits give 1000000000000001") and "10^14: 9 + 0 + 1 carried = 10" in row["t"]
    assert "900000000000000000 * 9000000000000000000 = 8100000000000000000000000000000000000" in row["p"]


@pytest.mark.parametrize("e,o,want", [
    ("3.14159265", "3.141592650", True), ("1234567890123456789", "1,234,567,890,123,456,789", True), ("12345678901234567891", "12345678901234567890", False), ("0.12345678", "12345678/100000000", True),
    ("1/3", "0.333333333333333333333", False), ("2", "x = 2.", True), ("-0", "0", True), ("007", "7", True), ("1/0", "1/0", True), ("1/0", "2/0", False), ("10", "1e1", True), ("1", "1e99999999", False), ("12345678901234.5", "12345678901234.50", True), ("\\frac{3}{6}", "1/2", True), ("5", None, False),
])
def test_exact_hits(spark, e, o, want):
    df = spark.createDataFrame([(e, o)], "e string, o string")
    assert df.select(S.is_hit(F.col("e"), F.col("o"))).first()[0] is want


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "skein.llm.queries", None)
    assert "mixture_sample" in __spark_entry__.queries() and not any(k.startswith("p1_") for k in __spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_intermediate_tables_are_removed(spark, tmp_path):
    df = materialize(spark.range(3).toDF("x"), "t")
    assert df.count() == 3
    path = df._skein_path.removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    release(spark, df)
    assert not os.path.exists(path)


def test_no_local_folder_on_a_cluster():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)
