"""Working files of a corpus: JSON Lines manifests and results, configurations, text shards, reports, cleaned files.

All paths may lie on any file system that Spark (tables) or Arrow (files written by tasks) can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.scoring import pivot
from skein.sources.files import open_folder
from skein.session import ship

MANIFEST_SCHEMA = (
    "doc_id string, source_name string, source_url string, license string, cleaned_path string, token_estimate bigint, source_family string, format string, level string, topic string,"
    " mixture_bucket string, quality_score double"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """One object a line, by a given schema, so nothing is read twice; unknown keys are left out, missing ones are null."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with its keys in order; nulls are written, other scripts stay as they are."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A configuration: one JSON document, of one object or a list of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_split(df: DataFrame, path: str) -> None:
    """JSON Lines folders ``split=train`` and ``split=val`` of rows with a column split."""
    rest = sorted(c for c in df.columns if c != "split")
    df.select(*rest, "split").write.mode("overwrite").option("ignoreNullFields", False).partitionBy("split").json(path)


def read_results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """model, family, hit of the result files of several models, one row a problem; a missing hit is a miss."""
    out = None
    for model, path in paths.items():
        part = spark.read.schema("family string, hit boolean").json(path).select(F.lit(model).alias("model"), "family", F.coalesce("hit", F.lit(False)).alias("hit"))
        out = part if out is None else out.unionByName(part)
    return out


def dereference(rows: DataFrame, root: str, path: str = "cleaned_path") -> DataFrame:
    """``rows`` with text: the content of the file each path names below root, null where it can't be read.

    The files are scanned once and joined by their path from the root on; no list of files comes to the driver.
    """
    spark = rows.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = r"^[a-z0-9]+:/+"
    stem = lambda c: F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(c, base, "/"), "^/+", ""))
    texts = files.select(stem(F.col("path")).alias("__path"), F.decode("content", "UTF-8").alias("text"))
    return rows.join(texts, stem(F.col(path)) == F.col("__path"), "left").drop("__path")


def export_files(rows: DataFrame, root: str) -> DataFrame:
    """rows: relpath STRING, content BINARY or text. Writes every row to its own file below root; a text gets a line end. Returns relpath, n_bytes.

    A file is written under a name of its own and then moved, so a repeated task leaves no half file.
    """
    ship(rows.sparkSession)
    content = F.encode(F.concat("content", F.lit("\n")), "UTF-8") if dict(rows.dtypes)["content"] == "string" else F.col("content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(root)
        for batch in batches:
            sizes = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                put(system, f"{base}/{name}", data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["relpath", "n_bytes"])

    return rows.where("relpath is not null and content is not null").select("relpath", content.alias("content")).mapInArrow(write, "relpath string, n_bytes bigint")


def put(system: fs.FileSystem, target: str, data: bytes) -> None:
    import uuid

    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    own = f"{target}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, target)


#: Lines that open and close a document in a text shard (fixed values).
SHARD_HEAD, SHARD_END = "<|doc|>%s source=%s quality=%s\n", "\n<|endofdoc|>\n"


def write_text_shards(docs: DataFrame, path: str, split: str) -> DataFrame:
    """docs: shard_idx, ord, doc_id, source_name, quality_score, text. Writes ``split-00001.txt`` and so on, one file a shard; returns shard_idx, n_documents, n_chars.

    Each shard is one sorted group of bounded size: the shards were cut at a number of characters.  Documents without text leave no mark.
    """
    ship(docs.sparkSession)
    body = F.concat(F.format_string(SHARD_HEAD, "doc_id", "source_name", F.col("quality_score").cast("string")), F.col("__t"), F.lit(SHARD_END))
    rows = docs.withColumn("__t", F.trim("text")).where("__t <> ''").select(F.col("shard_idx").cast("bigint").alias("shard_idx"), "ord", body.alias("body"), F.length("__t").cast("bigint").alias("n"))
    ordered = rows.repartition("shard_idx").sortWithinPartitions("shard_idx", "ord").select("shard_idx", "body", "n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = open_folder(path)
        system.create_dir(base, recursive=True)
        now, out, own, counts = None, None, "", [0, 0]

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                system.move(own, f"{base}/{split}-{now:05d}.txt")
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (now, *counts)], ["shard_idx", "n_documents", "n_chars"])

        for batch in batches:
            for shard, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    yield from close()
                    now, counts = shard, [0, 0]
                    own = f"{base}/.{split}-{shard:05d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                out.write(text.encode())
                counts = [counts[0] + 1, counts[1] + n]
        yield from close()

    return ordered.mapInArrow(write, "shard_idx bigint, n_documents bigint, n_chars bigint")


def report_document(selected: DataFrame, counts: DataFrame) -> DataFrame:
    """selected: bucket, topic, format, n_tokens; counts: reason, n. One row with the report as JSON, keys in order, parts by falling tokens."""

    def ranked(column: str, name: str) -> DataFrame:
        sums = selected.groupBy(column).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("n"))  # as many as there are labels
        return sums.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.coalesce(column, F.lit("")).alias("k"), "n"))), lambda r: F.struct(r["k"], r["n"]))).alias(name))

    whole = selected.agg(F.count(F.lit(1)).alias("selected_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("selected_estimated_tokens"))
    reasons = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("classification_counts"))
    out = reasons
    for part in (whole, *(ranked(c, f"tokens_by_{c}") for c in ("bucket", "topic", "format"))):
        out = out.join(part)  # one row each
    return out.select(F.to_json(F.struct(*sorted(out.columns))).alias("report"))


def markdown_report(results: DataFrame, models: list[str]) -> DataFrame:
    """results: model, family, hit. ord, line of a Markdown table: families by models, and all families together."""
    cells = pivot(results, models)

    def cell(model: str, bold: bool) -> F.Column:
        hits, n = F.split_part(model, F.lit("/"), F.lit(1)).cast("bigint"), F.split_part(model, F.lit("/"), F.lit(2)).cast("bigint")
        mark = "**" if bold else ""
        shown = F.concat(F.lit(mark), F.format_number(F.bround(100.0 * hits / n, 0), 0), F.lit(f"%{mark} ("), F.col(model), F.lit(")"))
        return F.when(F.col(model) == "-", F.lit("-")).otherwise(shown)

    line = lambda bold: F.concat(F.lit("| "), F.array_join(F.array("family", *[cell(m, bold) for m in models]), " | "), F.lit(" |"))
    last = F.col("family") == "**overall**"
    spark = results.sparkSession
    head = spark.createDataFrame([("", 0, "| family | " + " | ".join(models) + " |"), ("", 1, "|" + "---|" * (len(models) + 1))], "family string, ord int, line string")
    body = cells.select("family", F.when(last, 3).otherwise(2).alias("ord"), F.when(last, line(True)).otherwise(line(False)).alias("line"))
    return head.unionByName(body).select("ord", "family", "line")
