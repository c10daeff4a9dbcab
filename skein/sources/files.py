"""Sources that Spark has no reader for: source manifests, paper feeds, local trees, token shards."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions.text import unescape_html

SOURCE_SCHEMA = "name string, domain string, license string, source_type string, urls array<string>"
CATALOG_SCHEMA = (
    "doc_id string, source_name string, source_url string, domain string, license string, source_type string, raw_path string, cleaned_path string, "
    "sha256 string, byte_count bigint, char_count bigint, token_estimate bigint, status string, error string, retrieved_at bigint"
)
_FIELD = re.compile(r"^(?P<dash>-\s+)?(?P<key>[A-Za-z_]\w*)\s*:\s*(?P<value>.*)$")


def parse_sources(text: str) -> list[dict]:
    """Records of a manifest: ``- name: x`` opens one, ``key: value`` sets a field, ``- x`` adds to the list opened last; ``#`` begins a comment.

    A line of any other form is an error, as is a record that lacks a field or has it empty.
    """
    records: list[dict] = []
    open_list: str | None = None
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.partition("#")[0].strip()
        if not line or line == "sources:":
            continue
        field = _FIELD.match(line)
        if field and (field["dash"] is None or field["key"] == "name"):
            if field["dash"]:
                records.append({})
            if not records:
                raise ValueError(f"line {number} comes before any record: {raw!r}")
            value = field["value"].strip().strip("\"'")
            open_list = None if value else field["key"]
            records[-1][field["key"]] = value if value else []
        elif line.startswith("- ") and open_list:
            records[-1][open_list].append(line[2:].strip().strip("\"'"))
        else:
            raise ValueError(f"line {number} has no known form: {raw!r}")
    for record in records:
        for key in ("name", "domain", "license", "source_type", "urls"):
            if not record.get(key):
                raise ValueError(f"{record.get('name', 'a record')} lacks {key}")
    return records


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source manifest as a table; a manifest is a small file that people write."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    rows = [tuple(r[k] for k in ("name", "domain", "license", "source_type", "urls")) for r in parse_sources(text)]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """arxiv_id, title, pdf_url, categories, primary_category of the entries of Atom feeds; those without id or PDF are left out."""
    schema = "id string, title string, link array<struct<_href:string,_type:string>>, category array<struct<_term:string>>, `arxiv:primary_category` struct<_term:string>"
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    pdf = F.filter("link", lambda x: x["_type"] == "application/pdf")
    title = F.trim(unescape_html(F.regexp_replace("title", r"\s+", " ")))  # feeds escape titles twice
    out = entries.select(
        F.regexp_extract("id", r"([^/]*)$", 1).alias("arxiv_id"), title.alias("title"), F.try_element_at(pdf, F.lit(1))["_href"].alias("pdf_url"),
        F.filter(F.transform("category", lambda x: x["_term"]), lambda t: t.isNotNull() & (t != "")).alias("categories"), F.col("`arxiv:primary_category`._term").alias("primary_category"),
    )
    return out.where("arxiv_id <> '' and pdf_url is not null")


def paper_pool(papers: DataFrame) -> DataFrame:
    """papers with src_ord, file, pos: of each arxiv_id the first occurrence."""
    rest = [c for c in papers.columns if c not in ("arxiv_id", "src_ord", "file", "pos")]
    first = papers.groupBy("arxiv_id").agg(F.min_by(F.struct(*rest), F.struct("src_ord", "file", "pos")).alias("r"))
    return first.select("arxiv_id", "r.*")


def _as_regex(globs: list[str]) -> str:
    return "|".join(fnmatch.translate(g).replace("\\Z", "$").replace("\\z", "$").replace("(?>", "(?:") for g in globs)


def read_tree(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """path, relpath, content of all files below root whose name or relative path matches include and not exclude; ``*`` crosses folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base), "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = files.withColumn("relpath", relative).where(name.rlike(_as_regex(include)) | F.col("relpath").rlike(_as_regex(include)))
    if exclude:
        out = out.where(~(name.rlike(_as_regex(exclude)) | F.col("relpath").rlike(_as_regex(exclude))))
    return out.select("path", "relpath", "content")


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class ShardPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, split: str):
        self.folder, self.split = folder, split

    def partitions(self) -> list[ShardPartition]:
        system, folder = open_folder(self.folder)
        names = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, f"{self.split}-*.u32")]
        if not names:
            raise FileNotFoundError(f"no shard of {self.split} in {self.folder}")
        return [ShardPartition(p) for p in sorted(names)]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        name = partition.path.rsplit("/", 1)[1]
        split, _, number = name[: -len(".u32")].rpartition("-")
        with open_folder(self.folder)[0].open_input_stream(partition.path) as data:
            ids = np.frombuffer(data.read(), dtype=np.uint32).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([pa.array([split]), pa.array([int(number)], pa.int32()), tokens], ["split", "shard_idx", "tokens"])


class TokenShards(DataSource):
    """``spark.read.format("token_shards").option("split", "train").load(folder)``: one row per shard file, in parallel."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "split string, shard_idx int, tokens array<int>"

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("split", "train"))


def register(spark: SparkSession) -> None:
    from skein.session import ship

    ship(spark)
    spark.dataSource.register(TokenShards)
