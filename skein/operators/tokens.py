"""Token ids by a tokenizer file: digits apart, begin and end marks, end of document, batches of windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import ship


@lru_cache(maxsize=2)
def tokenizer_of(path: str, single_digits: bool):
    """A tokenizer file, once for each worker; ``single_digits``: every digit is a word of its own before the bytes are looked at."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    if single_digits:
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), out.pre_tokenizer])
    return out


def encode(docs: DataFrame, path: str, end: int | None = None, single_digits: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids ARRAY<INT> with the end-of-document id behind them; null and empty texts have none.

    The file is public and lies at the same path on every machine.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path, single_digits)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [e.ids + ([end] if end is not None and e.ids else []) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def framed(ids: Column, begin: int, end: int) -> Column:
    """The ids between the begin and the end mark."""
    return F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end)))


def window_batch(shards: DataFrame, length: int, batch: int, seed: int) -> DataFrame:
    """shards: shard_idx, tokens. Returns row, shard_idx, start, x, y: windows of a shard drawn evenly among all, at a start drawn evenly, and the same moved by one.

    Shards of length + 1 tokens and fewer are an error.
    """
    sizes = shards.select("shard_idx", F.size("tokens").alias("n"))
    short = F.raise_error(F.concat(F.lit(f"a shard needs more than {length + 1} tokens: "), F.col("shard_idx").cast("string")))
    sizes = sizes.select("shard_idx", F.when(F.col("n") > length + 1, F.col("n")).otherwise(short.cast("int")).alias("n"))
    listed = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("shard_idx", "n"))).alias("all"))  # two numbers a shard file
    number = lambda name, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("row")), most)
    rows = shards.sparkSession.range(batch).toDF("row").join(F.broadcast(listed)).select("row", F.get("all", number("shard", F.size("all")).cast("int")).alias("s"))
    rows = rows.select("row", F.col("s.shard_idx").alias("shard_idx"), number("start", (F.col("s.n") - length).cast("bigint")).cast("int").alias("start"))
    return rows.join(shards, "shard_idx").select("row", "shard_idx", "start", F.slice("tokens", F.col("start") + 1, length).alias("x"), F.slice("tokens", F.col("start") + 2, length).alias("y"))
