"""Working files, retrieval, payloads and token ids."""

import json
import os
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import tokens as N
from skein.sources import fetch as FE
from skein.sources import working as R

TOKENIZER = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


def lines(folder):
    return [line for p in sorted(folder.rglob("*.json")) for line in p.read_text().splitlines()]


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d2", "ö中", None), ("d1", "x", 0.5)], "doc_id string, topic string, quality_score double")
    R.write_jsonl(rows, f"file://{tmp_path}/m")
    text = lines(tmp_path / "m")
    assert '{"doc_id":"d2","quality_score":null,"topic":"ö中"}' in text
    back = R.read_jsonl(spark, f"file://{tmp_path}/m")
    assert {(r["doc_id"], r["topic"], r["quality_score"], r["level"]) for r in back.collect()} == {("d2", "ö中", None, None), ("d1", "x", 0.5, None)}
    R.write_split(rows.withColumn("split", F.when(F.col("doc_id") == "d1", "val").otherwise("train")), f"file://{tmp_path}/s")
    assert [json.loads(x)["doc_id"] for x in lines(tmp_path / "s" / "split=val")] == ["d1"]


def test_results_and_reports(spark, tmp_path):
    for model, hits in (("a", [True, False, None]), ("b", [True])):
        (tmp_path / f"{model}.jsonl").write_text("".join(json.dumps({"family": "add" if k < 2 else "sub", "hit": h}) + "\n" for k, h in enumerate(hits)))
    results = R.read_results(spark, {m: f"file://{tmp_path}/{m}.jsonl" for m in "ab"})
    table = [r["line"] for r in R.markdown_report(results, ["a", "b"]).orderBy("ord", "family").collect()]
    assert table == ["| family | a | b |", "|---|---|---|", "| add | 50% (1/2) | 100% (1/1) |", "| sub | 0% (0/1) | - |", "| **overall** | **33%** (1/3) | **100%** (1/1) |"]
    chosen = spark.createDataFrame([("b1", "t", "f", 5), ("b2", "t", "f", 9)], "bucket string, topic string, format string, n_tokens bigint")
    report = json.loads(R.report_document(chosen, spark.createDataFrame([("ok", 2)], "reason string, n bigint")).first()[0])
    assert report == {"classification_counts": {"ok": 2}, "selected_docs": 2, "selected_estimated_tokens": 14, "tokens_by_bucket": {"b2": 9, "b1": 5}, "tokens_by_format": {"f": 14}, "tokens_by_topic": {"t": 14}}
    assert list(report["tokens_by_bucket"]) == ["b2", "b1"]


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"bucket": "x", "target_fraction": 0.5}, {"bucket": "y"}], indent=2))
    assert [tuple(r) for r in R.read_config(spark, f"file://{tmp_path}/c.json", "bucket string, target_fraction double").orderBy("bucket").collect()] == [("x", 0.5), ("y", None)]


def test_files_and_their_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.txt", "one"), ("b/2.txt", "zwei"), (None, "x")], "relpath string, content string")
    assert {tuple(r) for r in R.export_files(rows, f"file://{tmp_path}/out").collect()} == {("a/1.txt", 4), ("b/2.txt", 5)}
    assert (tmp_path / "out/a/1.txt").read_text() == "one\n"
    named = spark.createDataFrame([(1, f"{tmp_path}/out/a/1.txt"), (2, f"{tmp_path}/out/none.txt"), (3, None)], "id bigint, cleaned_path string")
    assert {(r["id"], r["text"]) for r in R.dereference(named, f"file://{tmp_path}/out").collect()} == {(1, "one\n"), (2, None), (3, None)}


def test_text_shard_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, 1, "d1", "s", 0.5, " one "), (1, 2, "d2", "s", 0.25, "two"), (2, 3, "d3", "s", None, "three"), (2, 4, "d4", "s", 0.1, " "), (2, 5, "d5", "s", 0.1, None)], "shard_idx int, ord int, doc_id string, source_name string, quality_score double, text string")
    assert {tuple(r) for r in R.write_text_shards(docs.repartition(3), f"file://{tmp_path}/t", "train").collect()} == {(1, 2, 6), (2, 1, 5)}
    assert (tmp_path / "t/train-00001.txt").read_text() == "<|doc|>d1 source=s quality=0.5\none\n<|endofdoc|>\n<|doc|>d2 source=s quality=0.25\ntwo\n<|endofdoc|>\n"
    assert sorted(os.listdir(tmp_path / "t")) == ["train-00001.txt", "train-00002.txt"]


def answer(url):
    if url.endswith("404"):
        raise urllib.error.HTTPError(url, 404, "gone", {}, None)
    if url.endswith("bin"):
        return b"\x00", "image/png"
    return (b"<p>" + b"word " * 200 + b"</p>", "text/html")


def test_fetch(spark):
    jobs = spark.createDataFrame([("u/1",), ("u/404",), ("u/bin",), ("u/1",), (None,)], "url string")
    got = {r["url"]: (r["content"] is not None, r["error"]) for r in FE.fetch(jobs, answer, gate=("html", "text")).collect()}
    assert got["u/1"] == (True, None) and got["u/bin"] == (False, "content type image/png") and got["u/404"][1].startswith("HTTPError") and len(got) == 3
    rows = {r["source_url"]: r for r in FE.page_rows(FE.fetch(jobs, answer, gate=("html", "text")), "s", "d", "l").collect()}
    assert rows["u/1"]["status"] == "ok" and rows["u/1"]["char_count"] == 999 and rows["u/404"]["status"] == "error"
    assert FE.page_rows(FE.fetch(jobs, answer), "s", "d", "l", least=2000).where("status = 'ok'").count() == 0


def test_retries(monkeypatch):
    waits, left = [], [urllib.error.HTTPError("u", 429, "", {}, None), urllib.error.URLError("x")]
    monkeypatch.setattr(FE.time, "sleep", waits.append)

    def once(url):
        if left:
            raise left.pop(0)
        return b"x", ""

    assert FE.tried("u", once, 2, 1.5) == (b"x", "") and waits == [1.5, 3.0]
    with pytest.raises(urllib.error.HTTPError):
        FE.tried("u/404", answer, 5, 1)
    assert waits == [1.5, 3.0]


def test_payloads(spark):
    data = ["plain ö".encode(), "wide ö".encode("utf-16"), b"\xff\xfe\xfd", b"caf\xe9s", b"", None]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, c binary")
    got = {r[0]: r[1] for r in df.select("i", T.decode_payload(F.col("c"))).collect()}
    want = {0: "plain ö", 1: "wide ö", 2: b"\xff\xfe\xfd".decode("latin-1"), 3: "cafés", 4: "", 5: None}
    assert got == want or got == want | {3: b"caf\xe9s".decode("latin-1")}
    kinds = spark.createDataFrame([("<b>a</b> &amp; b", "html", None), ("<x>a</x>", "text", "f.XML"), ("a<b", None, None), ("a", "pdf", None), ("a", "text", "x.pdf"), (" a \r\n", "text", "t.txt")], "t string, s string, p string")
    assert [r[0] for r in kinds.select(T.extracted(F.col("t"), F.col("s"), F.col("p"))).collect()] == ["a & b", "a", "a<b", None, None, "a"]


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="the public vocabulary isn't here")
def test_token_ids(spark):
    docs = spark.createDataFrame([(1, "in 1234"), (2, ""), (3, None)], "doc_id bigint, text string")
    plain = {r[0]: r[1] for r in N.encode(docs, TOKENIZER, end=7).collect()}
    apart = {r[0]: r[1] for r in N.encode(docs, TOKENIZER, end=7, single_digits=True).collect()}
    assert plain[1][-1] == 7 and plain[2] == plain[3] == [] and len(apart[1]) > len(plain[1]) and len(apart[1]) >= 6
    assert spark.range(1).select(N.framed(F.array(F.lit(5)), 1, 2)).first()[0] == [1, 5, 2]


def test_window_batches(spark):
    shards = spark.createDataFrame([(1, list(range(100, 140))), (2, list(range(200, 212)))], "shard_idx int, tokens array<int>")
    rows = N.window_batch(shards, 8, 60, 3).collect()
    assert len(rows) == 60 and {r["shard_idx"] for r in rows} == {1, 2}
    for r in rows:
        assert len(r["x"]) == len(r["y"]) == 8 and r["y"][:-1] == r["x"][1:] and r["x"][0] % 100 == r["start"]
    assert np.ptp([r["start"] for r in rows if r["shard_idx"] == 1]) > 10
    with pytest.raises(Exception, match="more than"):
        N.window_batch(shards, 11, 4, 3).collect()
