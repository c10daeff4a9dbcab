"""The catalog of retrieved documents: upsert, resume, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import short_hash


def upsert(catalog: DataFrame, key: str = "doc_id", batch: str = "retrieved_at") -> DataFrame:
    """One row per key, the latest: whole rows replace each other.  Equal batches fall to the greater row."""
    rest = [c for c in catalog.columns if c not in (key, batch)]
    latest = catalog.groupBy(key).agg(F.max(F.struct(batch, *rest)).alias("r"))
    return latest.select(key, "r.*").select(*catalog.columns)


def totals(catalog: DataFrame) -> DataFrame:
    ok = catalog.where("status = 'ok'")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return ok.agg(F.count(F.lit(1)).alias("n_documents"), whole("byte_count").alias("n_bytes"), whole("char_count").alias("n_chars"), whole("token_estimate").alias("n_tokens"))


def by_source(catalog: DataFrame) -> DataFrame:
    return catalog.where("status = 'ok'").groupBy("source_name").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("bigint").alias("n_tokens"))


def errors(catalog: DataFrame) -> DataFrame:
    return catalog.where("status <> 'ok'").groupBy("source_name", "status").agg(F.count(F.lit(1)).alias("n_documents"))


def jobs(sources: DataFrame) -> DataFrame:
    """One row per URL of the source manifest, in order."""
    return sources.select("name", F.posexplode("urls").alias("ord", "url")).withColumn("doc_id", short_hash(F.col("url")))


def resume(todo: DataFrame, catalog: DataFrame, any_status: bool = True) -> DataFrame:
    """The jobs that have no row yet, or no row with status ok."""
    done = catalog if any_status else catalog.where("status = 'ok'")
    return todo.join(done.select("doc_id"), "doc_id", "left_anti")


def failed(error_text: str):
    """Columns of the row that stands for a failure."""
    return {"sha256": F.lit(""), "byte_count": F.lit(0), "char_count": F.lit(0), "token_estimate": F.lit(0), "status": F.lit("error"), "error": F.lit(error_text)}
