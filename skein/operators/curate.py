"""Curation: features, reason-coded eligibility, budgeted mixture, split, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import classify as C
from skein.functions import quality as Q
from skein.functions.text import duplicate_key, token_estimate, words_of
from skein.operators.ordered import first_of, running_sum
from skein.session import materialize


def with_buckets(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """Adds bucket (the first that names the source, else by family) and min_quality (default 0.5)."""
    named = mixture.select("ord", "bucket", F.explode("sources").alias("source")).groupBy("source").agg(F.min(F.struct("ord", "bucket")).getField("bucket").alias("named"))
    least = mixture.groupBy("bucket").agg(F.first("min_quality").alias("min_quality"))
    out = docs.join(named, "source", "left").withColumn("bucket", F.coalesce("named", C.bucket_by_family(F.col("family")))).drop("named")
    return out.join(least, "bucket", "left").withColumn("min_quality", F.coalesce("min_quality", F.lit(0.5)))


def features(docs: DataFrame, kinds: bool = False) -> DataFrame:
    """docs: doc_id, source, license, source_type, text. The features of the readable documents, written once: all later steps read these narrow rows.

    ``kinds``: with format, level and topic, which only reports need.
    """
    text, source = F.col("text"), F.col("source")
    docs = docs.where("text is not null").withColumn("own", words_of(text))
    out = docs.withColumns(
        {
            "family": C.math_family(source), "confidence": C.license_confidence(F.coalesce("license", F.lit(""))), "math_density": Q.math_density(text, F.col("own")), "symbol_density": Q.symbol_density(text),
            "extraction": Q.extraction_score(text), "repeated": Q.repetition(text), "dkey": duplicate_key(text), "n_tokens": token_estimate(text),
        }
    )
    extra = []
    if kinds:
        counts = C.topic_counts("math", text, F.col("own"))
        out = out.withColumns({f"__{n}": c for n, c in counts.items()} | {"format": C.format_of(source, F.col("source_type")), "level": C.level_of(source, text)})
        out = out.withColumn("topic", C.topic_of("math", {n: F.col(f"__{n}") for n in counts}))
        extra = [f"__{n}" for n in counts]
    score = Q.quality_v2(source, F.col("family"), text, F.col("math_density"), F.col("symbol_density"), F.col("extraction"), F.col("repeated"), F.col("confidence"))
    return materialize(out.withColumn("quality", score).drop("text", "own", *extra), "features")


def reasons_v2(featured: DataFrame, mixture: DataFrame, excluded: list[str]) -> DataFrame:
    """Adds reason: every readable document registers its key before any other check."""
    out = first_of(with_buckets(featured, mixture), "dkey", ["source", "doc_id"])
    reason = F.when(F.col("source").isin(excluded), "excluded_source").when(~F.col("is_first"), "near_duplicate").when(F.col("bucket") == "unassigned", "unassigned_bucket")
    return out.withColumn("reason", reason.when(F.col("quality") < F.col("min_quality"), "below_quality_threshold").otherwise("ok"))


def reasons_science(docs: DataFrame, min_chars: int = 400) -> DataFrame:
    """doc_id, source, reason: short documents leave before their key is registered."""
    keyed = docs.select("doc_id", "source", F.length("text").alias("n"), F.when(F.length("text") >= min_chars, duplicate_key(F.col("text"))).alias("dkey"))
    long = first_of(keyed.where("dkey is not null"), "dkey", ["source", "doc_id"]).select("doc_id", "source", F.when(F.col("is_first"), "kept").otherwise("duplicate").alias("reason"))
    rest = keyed.where("dkey is null").select("doc_id", "source", F.when(F.col("n").isNull(), "unreadable").otherwise("too_short").alias("reason"))
    return long.unionByName(rest)


def reasons_code(docs: DataFrame, min_chars: int = 200, least: float = 0.02) -> DataFrame:
    """doc_id, source, reason: documents without structure register their key before they leave."""
    keyed = docs.select("doc_id", "source", F.length("text").alias("n"), (Q.structure_density(F.col("text")) < least).alias("low"), F.when(F.length("text") >= min_chars, duplicate_key(F.col("text"))).alias("dkey"))
    long = first_of(keyed.where("dkey is not null"), "dkey", ["source", "doc_id"])
    long = long.select("doc_id", "source", F.when(~F.col("is_first"), "duplicate").when(F.col("low"), "low_structure").otherwise("kept").alias("reason"))
    rest = keyed.where("dkey is null").select("doc_id", "source", F.when(F.col("n").isNull(), "unreadable").otherwise("too_short").alias("reason"))
    return long.unionByName(rest)


def budgeted_sample(eligible: DataFrame, mixture: DataFrame, total: int, seed: int = 7) -> DataFrame:
    """Per bucket, by falling quality, documents while the tokens before them are under the bucket's share of ``total``.

    Equal qualities are ordered by a hash of seed and id.  eligible: doc_id, bucket, quality, n_tokens.
    """
    goals = mixture.groupBy("bucket").agg(F.first("target_fraction").alias("f")).select("bucket", F.floor(F.lit(total) * F.col("f")).cast("bigint").alias("bucket_target"))
    pool = eligible.join(goals, "bucket").where("bucket_target > 0")
    pool = pool.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")), 256))
    pool = running_sum(pool, ["bucket"], [F.col("quality").desc(), F.col("__h"), F.col("doc_id")], F.col("n_tokens"), "tokens_before")
    return pool.where("tokens_before < bucket_target").drop("__h")


def split_off(df: DataFrame, share: float, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Adds split: the first max(1, int(n * share)) rows in the order of a hash are val, the others train."""
    df = materialize(df, "to-split")
    n = df.count()
    k = max(1, int(n * share))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    ranked = running_sum(df.withColumn("__h", order).withColumn("__g", F.lit(0)), ["__g"], [F.col("__h"), F.col(key)], F.lit(1), "__rank")
    return ranked.withColumn("split", F.when(F.col("__rank") < k, "val").otherwise("train")).drop("__h", "__g", "__rank")


def domain_rows(catalog: DataFrame, docs: DataFrame, sources: list[str]) -> DataFrame:
    """Catalog rows with status ok of the given sources, with their text where it can be read. catalog: doc_id, source_name, status; docs: doc_id, catalog_id, text; of several texts of a catalog row the one with the greatest doc_id counts."""
    rows = catalog.where((F.col("status") == "ok") & F.col("source_name").isin(*sources))
    texts = docs.where("catalog_id is not null").groupBy(F.col("catalog_id").alias("doc_id")).agg(F.max_by("text", F.col("doc_id")).alias("text"))
    return rows.join(texts, "doc_id", "left")


def domain_judged(rows: DataFrame, domain: str) -> DataFrame:
    """rows: doc_id, source (its name), text, token_estimate. doc_id, source, reason, family, topic, token_estimate of a domain's documents."""
    judge = reasons_code if domain == "code" else reasons_science
    reasons = judge(rows.select("doc_id", "source", "text")).select("doc_id", "reason")
    text = F.col("text")
    counts = C.topic_counts(domain, text, F.col("own"))
    kinds = rows.where("text is not null").withColumn("own", words_of(text)).select("doc_id", *[c.alias(f"__{n}") for n, c in counts.items()])
    kinds = kinds.select("doc_id", C.topic_of(domain, {n: F.col(f"__{n}") for n in counts}).alias("topic"))
    family = C.code_family(F.col("source")) if domain == "code" else C.science_family(F.col("source"), domain == "chemistry")
    return rows.select("doc_id", "source", "token_estimate").join(reasons, "doc_id").join(kinds, "doc_id", "left").withColumn("family", family)


def domain_report(judged: DataFrame) -> DataFrame:
    """dimension, value, n_documents, n_tokens: documents by reason, and of the kept ones documents and tokens by family and topic."""
    count, tokens = F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("bigint").alias("n_tokens")
    reasons = judged.groupBy(F.col("reason").alias("value")).agg(count, tokens).select(F.lit("reason").alias("dimension"), "value", "n_documents", "n_tokens")
    kept = judged.where("reason = 'kept'")
    out = reasons
    for by in ("family", "topic"):
        out = out.unionByName(kept.groupBy(F.col(by).alias("value")).agg(count, tokens).select(F.lit(by).alias("dimension"), "value", "n_documents", "n_tokens"))
    return out


def report(selected: DataFrame) -> DataFrame:
    """Documents and tokens by bucket, topic and format, as grouping sets in one pass."""
    sets = selected.groupingSets([["bucket"], ["topic"], ["format"]], "bucket", "topic", "format").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))
    return sets.select(F.when(F.col("bucket").isNotNull(), "bucket").when(F.col("topic").isNotNull(), "topic").otherwise("format").alias("dimension"), F.coalesce("bucket", "topic", "format").alias("value"), "n_documents", "n_tokens")
