import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.shards import write_u32
from skein.sources import files
from skein.streaming.ingest import ingest, latest_version

MANIFEST = """# sources
sources:
  - name: one   # comment
    domain: math
    license: MIT
    source_type: html
    urls:
      - https://x.org/a
      - https://x.org/b
  - name: two
    domain: math
    license: "CC-BY"
    source_type: text
    urls:
      - https://y.org/c
"""


def test_manifest(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    rows = files.read_sources(spark, str(tmp_path / "m.yaml")).orderBy("name").collect()
    assert [(r["name"], len(r["urls"]), r["license"]) for r in rows] == [("one", 2, "MIT"), ("two", 1, "CC-BY")]
    with pytest.raises(ValueError, match="no known form"):
        files.parse_sources("- name: x\n  what is this")
    with pytest.raises(ValueError, match="lacks"):
        files.parse_sources("- name: x\n  domain: y")


def test_papers(spark, tmp_path):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/1.2v1</id><title> A
      title </title><link href="http://x/abs" type="text/html"/><link href="http://x/pdf" type="application/pdf"/><category term="math.AG"/><category term=""/><arxiv:primary_category term="math.AG"/></entry>
      <entry><id>http://arxiv.org/abs/3</id><title>No PDF</title><link href="http://x/abs" type="text/html"/></entry></feed>"""
    (tmp_path / "f.xml").write_text(feed)
    rows = files.read_papers(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["arxiv_id"], r["title"], r["pdf_url"], r["categories"], r["primary_category"]) for r in rows] == [("1.2v1", "A title", "http://x/pdf", ["math.AG"], "math.AG")]
    pool = spark.createDataFrame([("a", "later", 2, "f", 0), ("a", "first", 1, "f", 5)], "arxiv_id string, title string, src_ord int, file string, pos int")
    assert files.paper_pool(pool).first()["title"] == "first"


def test_tree(spark, tmp_path):
    for name in ("a.py", "d/b.py", "d/c.txt", "d/skip/e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.read_tree(spark, str(tmp_path), ["*.py"], ["d/skip/*"]).orderBy("relpath").collect()
    assert [r["relpath"] for r in got] == ["a.py", "d/b.py"]


def test_shards_there_and_back(spark, tmp_path):
    tokens = spark.createDataFrame([(1, [1, 2, 70000]), (2, [4])], "shard_idx int, tokens array<int>")
    write_u32(tokens, str(tmp_path), "train")
    assert np.fromfile(tmp_path / "train-00001.u32", np.uint32).tolist() == [1, 2, 70000]
    files.register(spark)
    back = spark.read.format("token_shards").option("split", "train").load(str(tmp_path)).orderBy("shard_idx").collect()
    assert [(r["split"], r["shard_idx"], r["tokens"]) for r in back] == [("train", 1, [1, 2, 70000]), ("train", 2, [4])]


def test_incremental_catalog(spark, tmp_path):
    def arrive(rows):
        columns = [c.split()[0] for c in files.CATALOG_SCHEMA.split(", ")]
        df = spark.createDataFrame(rows, "doc_id string, retrieved_at bigint, status string")
        kinds = dict(x.split() for x in files.CATALOG_SCHEMA.split(", "))
        df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]).write.mode("append").parquet(str(tmp_path / "in"))

    for rows in ([("a", 1, "error"), ("b", 1, "ok")], [("a", 2, "ok"), ("a", 0, "late")]):
        arrive(rows)
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    table = spark.read.parquet(latest_version(spark, str(tmp_path / "table")))
    assert sorted((r["doc_id"], r["status"]) for r in table.collect()) == [("a", "ok"), ("b", "ok")]
