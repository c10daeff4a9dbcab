"""Retrieval over HTTP as a distributed step, with retries and the gates of a crawl."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import decode_bytes, html_to_text, short_hash, token_estimate
from skein.session import ship

AGENT = "skein/1.0"
FETCHED = "url string, content binary, content_type string, error string"


def get(url: str, timeout: float) -> tuple[bytes, str]:
    """Content and content type of an address."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read(), response.headers.get("Content-Type", "")


def passing(error: Exception) -> bool:
    """Whether another try may help: too many requests, no connection, no answer in time; other answers of a server are final."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429
    return isinstance(error, (urllib.error.URLError, TimeoutError))


def tried(url: str, once: Callable[[str], tuple[bytes, str]], retries: int, pause: float) -> tuple[bytes, str]:
    """The first answer; passing errors are tried again after pause, 2 * pause and so on."""
    for attempt in range(retries + 1):
        try:
            return once(url)
        except Exception as error:
            if attempt == retries or not passing(error):
                raise
            time.sleep(pause * (attempt + 1))
    raise AssertionError("unreachable")


def fetch(jobs: DataFrame, once: Callable[[str], tuple[bytes, str]] | None = None, retries: int = 2, pause: float = 2.0, timeout: float = 60.0, gate: tuple[str, ...] = ()) -> DataFrame:
    """jobs: url. Returns url, content, content_type, error: one row per distinct address, an error instead of a content where it failed.

    ``gate``: only content types that hold one of these words are let through.  ``once`` gets an address, by default over HTTP.
    """
    ship(jobs.sparkSession)
    ask = once or (lambda url: get(url, timeout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                content, kind, error = None, None, None
                try:
                    content, kind = tried(url, ask, retries, pause)
                    if gate and not any(word in kind for word in gate):
                        content, error = None, f"content type {kind}"
                except Exception as problem:  # noqa: BLE001 - it becomes the row's error
                    error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([content], pa.binary()), pa.array([kind], pa.string()), pa.array([error], pa.string())], ["url", "content", "content_type", "error"])

    return jobs.select("url").where("url is not null").distinct().mapInArrow(run, FETCHED)


def page_rows(fetched: DataFrame, source: str, domain: str, licence: str, least: int = 500, most: int | None = None) -> DataFrame:
    """Catalog rows of fetched pages: errors as such, and pages of at least ``least`` characters of clean text, of which the first ``most`` by address."""
    text = html_to_text(decode_bytes(F.col("content")))
    good = fetched.where("error is null").withColumn("text", text).where(F.length("text") >= least)
    if most is not None:
        good = good.orderBy("url").limit(most)
    fixed = {"source_name": F.lit(source), "domain": F.lit(domain), "license": F.lit(licence), "source_type": F.lit("html")}
    ok = good.withColumns(
        fixed | {"sha256": F.sha2("content", 256), "byte_count": F.length("content").cast("bigint"), "char_count": F.length("text").cast("bigint"), "token_estimate": token_estimate(F.col("text")), "status": F.lit("ok")}
    )
    bad = fetched.where("error is not null").withColumns(
        fixed | {"text": F.lit(None).cast("string"), "sha256": F.lit(""), "byte_count": F.lit(0).cast("bigint"), "char_count": F.lit(0).cast("bigint"), "token_estimate": F.lit(0).cast("bigint"), "status": F.lit("error")}
    )
    rows = ok.unionByName(bad)
    return rows.select(short_hash(F.col("url")).alias("doc_id"), F.col("url").alias("source_url"), *fixed, "sha256", "byte_count", "char_count", "token_estimate", "status", "error", "text")
