"""Text and token shards, training windows, prompt masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ordered import running_sum


def text_shards(docs: DataFrame, target: int) -> DataFrame:
    """docs: doc_id, ord (total order), n_chars. Adds shard_idx (from 1).

    A shard is closed when a document finds it at ``target`` or more, and the count starts again at 0;
    a document without text can open a shard.  The fold is sequential by definition: it streams the
    narrow rows (never the texts) through one task that holds a single counter.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = 0, 0
        for batch in batches:
            sizes = batch.column("n_chars").to_pylist()
            out = np.empty(len(sizes), np.int64)
            for i, size in enumerate(sizes):
                if shard == 0 or held >= target:
                    shard, held = shard + 1, 0
                held += size
                out[i] = shard
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "shard_idx"])

    narrow = docs.select("doc_id", "ord", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"))
    ordered = narrow.repartitionByRange("ord").sortWithinPartitions("ord").coalesce(1)
    types = {name: kind for name, kind in narrow.dtypes}
    return ordered.mapInArrow(fold, f"doc_id {types['doc_id']}, ord {types['ord']}, n_chars bigint, shard_idx bigint")


def token_shards(docs: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """docs: doc_id, n_tokens (with the end mark). The stream of all tokens, cut every ``size`` tokens.

    Returns doc_id, shard_idx (from 1), doc_from, shard_from, n: which part of a document lies where.
    A document is as many rows as it has shards; no token is moved before the final write.
    """
    placed = running_sum(docs.withColumn("__g", F.lit(0)), ["__g"], order, F.col("n_tokens"), "at").drop("__g").where("n_tokens > 0")
    first, last = F.expr(f"at div {size}"), F.expr(f"(at + n_tokens - 1) div {size}")
    parts = placed.select("*", F.explode(F.sequence(first, last)).alias("k"))
    begin, end = F.greatest("at", F.col("k") * size), F.least(F.col("at") + F.col("n_tokens"), (F.col("k") + 1) * size)
    return parts.select("doc_id", (F.col("k") + 1).alias("shard_idx"), (begin - F.col("at")).alias("doc_from"), (begin - F.col("k") * size).alias("shard_from"), (end - begin).alias("n"))


def windows(tokens: Column, start: Column, length: int) -> tuple[Column, Column]:
    """A training pair of a token array: ``length`` tokens from start (from 0), and the same moved by one."""
    return F.slice(tokens, start + 1, length), F.slice(tokens, start + 2, length)


def masked_labels(ids: Column, n_prompt: Column, context: int) -> Column:
    """The ids moved by one, cut to the context, with the prompt's places at -100."""
    n = F.greatest(F.least(F.size(ids), F.lit(context)) - 1, F.lit(0))
    hidden = F.least(F.greatest(n_prompt - 1, F.lit(0)), n)
    return F.concat(F.array_repeat(F.lit(-100), hidden), F.slice(ids, hidden + 2, n - hidden))


def padded(array: Column, length: Column, filler: int) -> Column:
    return F.concat(array, F.array_repeat(F.lit(filler), F.greatest(length - F.size(array), F.lit(0))))


def write_u32(tokens: DataFrame, path: str, split: str) -> None:
    """tokens: shard_idx, tokens ARRAY<INT>. Writes headerless uint32 files ``split-00001.u32``, one per shard, to a path all executors share, on any file system that Arrow knows."""

    from skein.sources.working import open_folder, put

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(path)
        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                put(system, f"{folder}/{split}-{shard:05d}.u32", np.asarray(ids.values, dtype=np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["done"])

    tokens.select(F.col("shard_idx").cast("bigint"), "tokens").mapInArrow(write, "done bigint").count()
