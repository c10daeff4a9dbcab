"""The queries of the core operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import classify as C
from skein.functions import quality as Q
from skein.functions import text as T
from skein.operators import catalog as K
from skein.operators import curate as U
from skein.operators import curriculum as G
from skein.operators import orchestrate as O
from skein.operators import scoring as S
from skein.operators import shards as H
from skein.operators import web as W
from skein.operators.ordered import first_of
from skein.session import materialize, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Sources that the curation queries leave out (one that the test tables have).
EXCLUDED = ["math_webnotes_extra"]
TEXT_SHARD, TOKEN_SHARD, CONTEXT = 200_000, 10_000, 64


#: Tables whose rows are costly.
TEXTUAL = ("documents", "sft_examples")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXTUAL else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a text, with the licence of their source."""
    names = table(spark, sf, "source_manifest").select(F.col("name").alias("source"), "license")
    return table(spark, sf, "documents").select("doc_id", "source", "source_type", "text").join(names, "source", "left")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "source_type", "text").where("text is not null")


def worded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their words, which are found once for all counts."""
    return texts(spark, sf).withColumn("own", T.words_of(F.col("text")))


@query
def catalog_totals(spark, sf):
    return K.totals(K.upsert(table(spark, sf, "doc_catalog")))


@query
def catalog_by_source(spark, sf):
    return K.by_source(K.upsert(table(spark, sf, "doc_catalog")))


@query
def catalog_errors(spark, sf):
    return K.errors(K.upsert(table(spark, sf, "doc_catalog")))


@query
def upsert_latest(spark, sf):
    return K.upsert(table(spark, sf, "doc_catalog")).select("doc_id", "source_name", "status", "token_estimate", "retrieved_at")


@query
def job_explode(spark, sf):
    return K.jobs(table(spark, sf, "source_manifest"))


def retrieval_jobs(spark, sf):
    """What a second retrieval would ask for: every URL of the catalog and of the manifest."""
    again = table(spark, sf, "doc_catalog").select(F.col("source_url").alias("url"), "doc_id")
    return again.unionByName(K.jobs(table(spark, sf, "source_manifest")).select("url", "doc_id")).distinct()


@query
def resume_any_status(spark, sf):
    return K.resume(retrieval_jobs(spark, sf), table(spark, sf, "doc_catalog"))


@query
def resume_ok_only(spark, sf):
    return K.resume(retrieval_jobs(spark, sf), table(spark, sf, "doc_catalog"), any_status=False)


@query
def doc_id_hash(spark, sf):
    return table(spark, sf, "doc_catalog").select("source_url", T.short_hash(F.col("source_url")).alias("hash")).distinct()


@query
def raw_extension(spark, sf):
    return table(spark, sf, "doc_catalog").select("source_url", "source_type", T.raw_extension(F.col("source_type"), F.col("source_url")).alias("extension")).distinct()


@query
def token_estimate(spark, sf):
    return texts(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


def digest(df: DataFrame, column) -> DataFrame:
    return df.select("doc_id", column.alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query
def normalize_text(spark, sf):
    return digest(texts(spark, sf), T.normalize(F.col("text")))


@query
def normalize_local(spark, sf):
    return digest(texts(spark, sf), T.normalize_local(F.col("text")))


@query
def html_strip(spark, sf):
    return digest(texts(spark, sf).where("source_type = 'html'"), T.normalize(T.strip_html(F.col("text"))))


@query
def html_to_text(spark, sf):
    return digest(texts(spark, sf).where("source_type = 'html'"), T.html_to_text(F.col("text")))


@query
def xml_to_text(spark, sf):
    return digest(texts(spark, sf), T.xml_to_text(F.col("text")))


def page_table(spark, sf):
    urls = K.upsert(table(spark, sf, "doc_catalog")).select(F.col("doc_id").alias("catalog_id"), F.col("source_url").alias("url"))
    return table(spark, sf, "documents").where("source_type = 'html' and text is not null").select("catalog_id", F.col("text").alias("html")).join(urls, "catalog_id").select("url", "html")


@query
def page_links(spark, sf):
    return W.links(page_table(spark, sf))


@query
def allowed_links(spark, sf):
    return W.links(page_table(spark, sf)).where(W.allowed(F.col("link"), ["notes.example"], ["https://notes.example/q"])).groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query
def crawl_depth(spark, sf):
    pages = page_table(spark, sf)
    # the test pages lead to no other page of the table, so a page for each target closes the graph
    targets = W.links(pages).select(F.col("link").alias("url")).distinct().withColumn("html", F.lit('<a href="https://notes.example/end">on</a>'))
    end = spark.createDataFrame([("https://notes.example/end", "")], "url string, html string")
    graph = pages.unionByName(targets).unionByName(end)
    hosts = [r[0] for r in table(spark, sf, "source_manifest").select(F.regexp_extract(F.element_at("urls", 1), r"^https?://([^/]*)", 1)).distinct().collect()]
    return W.crawl(graph, pages.select("url"), 2, [*hosts, "notes.example"])


@query
def source_families(spark, sf):
    s = F.col("source_name")
    names = table(spark, sf, "doc_catalog").select("source_name").distinct()
    fixed = spark.createDataFrame([(n,) for d in C.DOMAIN_SOURCES.values() for n in d], "source_name string")
    return names.unionByName(fixed).distinct().select("source_name", C.math_family(s).alias("math"), C.science_family(s).alias("physics"), C.science_family(s, True).alias("chemistry"), C.code_family(s).alias("code"))


@query
def format_level(spark, sf):
    s = F.col("source")
    return texts(spark, sf).select("doc_id", C.format_of(s, F.col("source_type")).alias("format"), C.level_of(s, F.col("text")).alias("level"))


def topics(domain):
    def run(spark, sf):
        counts = C.topic_counts(domain, F.col("text"), F.col("own"))
        counted = worded(spark, sf).select("doc_id", *[c.cast("bigint").alias(n) for n, c in counts.items()])
        return counted.select("*", C.topic_of(domain, {n: F.col(n) for n in counts}).alias("topic"))

    return run


for _domain in C.TOPICS:
    QUERIES[f"topics_{_domain}"] = topics(_domain)


@query
def license_confidence(spark, sf):
    return table(spark, sf, "doc_catalog").select("license", C.license_confidence(F.col("license")).alias("confidence")).distinct()


@query
def buckets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", C.math_family(F.col("source")).alias("family"))
    return U.with_buckets(docs, table(spark, sf, "mixture_spec")).select("doc_id", "bucket", "min_quality")


@query
def quality_v1(spark, sf):
    return worded(spark, sf).select("doc_id", Q.quality_v1(F.col("source"), F.col("text"), F.col("own")).alias("score"))


@query
def gate_v1(spark, sf):
    kept = worded(spark, sf).where(~F.col("source").isin(C.EXCLUDED_V1)).select("doc_id", "source", Q.quality_v1(F.col("source"), F.col("text"), F.col("own")).alias("score"), T.token_estimate(F.col("text")).alias("n_tokens"))
    return kept.where("score >= 0.45").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


@query
def densities(spark, sf):
    t = F.col("text")
    return worded(spark, sf).select("doc_id", Q.math_density(t, F.col("own")).alias("math_density"), Q.symbol_density(t).alias("symbol_density"), Q.extraction_score(t).alias("extraction"))


@query
def repetition(spark, sf):
    return texts(spark, sf).select("doc_id", Q.repetition(F.col("text")).alias("repeated"))


@query
def science_densities(spark, sf):
    t = F.col("text")
    own = F.col("own")
    return worded(spark, sf).select("doc_id", Q.term_density(t, own, Q.PHYSICS_WORDS).alias("physics"), Q.term_density(t, own, Q.CHEMISTRY_WORDS).alias("chemistry"), Q.structure_density(t).alias("structure"), Q.code_extraction(t).alias("code_extraction"))


def featured(spark, sf, kinds=False):
    return U.features(documents(spark, sf), kinds)


@query
def quality_v2(spark, sf):
    return featured(spark, sf).select("doc_id", "family", "quality")


@query
def dup_key(spark, sf):
    return texts(spark, sf).select("doc_id", T.duplicate_key(F.col("text")).alias("dkey"))


@query
def first_wins(spark, sf):
    keyed = texts(spark, sf).select("doc_id", "source", T.duplicate_key(F.col("text")).alias("dkey"))
    return first_of(keyed, "dkey", ["source", "doc_id"]).select("doc_id", "is_first")


def judged(spark, sf, kinds=False):
    return U.reasons_v2(featured(spark, sf, kinds), table(spark, sf, "mixture_spec"), EXCLUDED)


@query
def reasons_v2(spark, sf):
    return judged(spark, sf).select("doc_id", "bucket", "reason")


@query
def reason_counts(spark, sf):
    return judged(spark, sf).groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def reasons_science(spark, sf):
    return U.reasons_science(table(spark, sf, "documents"))


@query
def reasons_code(spark, sf):
    return U.reasons_code(table(spark, sf, "documents"))


@query
def eligible_join(spark, sf):
    catalog = K.upsert(table(spark, sf, "doc_catalog")).where("status = 'ok'")
    features = table(spark, sf, "document_features").where("doc_id is not null and eligible = 1").groupBy("doc_id").agg(F.max(F.struct("scored_at", "topic", "format")).alias("r"))
    return catalog.join(features, "doc_id").select("doc_id", "source_name", "token_estimate", F.col("r.topic").alias("topic"), F.col("r.format").alias("format"))


def selected(spark, sf, kinds=False):
    ok = judged(spark, sf, kinds).where("reason = 'ok'").select("doc_id", "source", "bucket", "quality", "n_tokens", *(["topic", "format"] if kinds else []))
    ok = materialize(ok, "eligible")  # the total and the ranging of the sample read it again
    total = ok.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] // 2
    return U.budgeted_sample(ok, table(spark, sf, "mixture_spec"), int(total))


@query
def mixture_sample(spark, sf):
    """Half of all eligible tokens, shared out by target fraction, best documents first."""
    return selected(spark, sf).select("doc_id", "bucket", "quality", "n_tokens", F.col("tokens_before").cast("bigint").alias("tokens_before"), "bucket_target")


@query
def train_val_split(spark, sf):
    return U.split_off(selected(spark, sf), 0.02).groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


@query
def curation_report(spark, sf):
    return U.report(selected(spark, sf, kinds=True))


@query
def text_shards(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ord"), "n_chars")
    return H.text_shards(docs, TEXT_SHARD).groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").cast("bigint").alias("n_chars"), F.min("doc_id").alias("first_id"))


@query
def token_shards(spark, sf):
    docs = texts(spark, sf).select("doc_id", (T.token_estimate(F.col("text")) + 1).alias("n_tokens"))
    return H.token_shards(docs, TOKEN_SHARD, [F.col("doc_id")])


@query
def token_windows(spark, sf):
    """Of every document with enough words: a window at a hashed place, as word lengths, and the one after it."""
    ids = F.transform(F.split(F.regexp_replace("text", r"[^A-Za-z]+", " "), " "), F.length)
    docs = texts(spark, sf).select("doc_id", ids.alias("ids")).where(F.size("ids") > CONTEXT + 1)
    at = F.expr(f"cast(conv(substring(sha2(cast(doc_id as string), 256), 1, 8), 16, 10) as bigint) % (size(ids) - {CONTEXT})").cast("int")
    x, y = H.windows(F.col("ids"), F.col("at"), CONTEXT)
    return docs.withColumn("at", at).select("doc_id", F.col("at").cast("bigint").alias("at"), F.array_join(x.cast("array<string>"), ",").alias("x"), F.array_join(y.cast("array<string>"), ",").alias("y"))


@query
def sft_rows(spark, sf):
    """Prompt and completion as character codes, with the prompt masked."""
    rows = table(spark, sf, "sft_examples").where("trim(coalesce(prompt, '')) <> '' and trim(coalesce(completion, '')) <> ''").groupBy("example_id").agg(F.max(F.struct("built_at", "prompt", "completion")).alias("r"))
    prompt = F.concat(F.lit("Problem: "), F.trim("r.prompt"), F.lit("\nSolution:"))
    whole = F.concat(prompt, F.lit(" "), F.trim("r.completion"))
    ids = F.transform(F.split(whole, ""), F.ascii)
    labels = H.masked_labels(ids, F.length(prompt), 256)
    out = rows.select("example_id", F.explode(F.array(labels)).alias("labels"))
    hidden = F.size(F.filter("labels", lambda x: x == -100))
    return out.select("example_id", F.size("labels").cast("bigint").alias("n_labels"), hidden.cast("bigint").alias("n_hidden")).where("n_labels > n_hidden")


@query
def holdout_filter(spark, sf):
    rows = table(spark, sf, "sft_examples").where("prompt is not null").select("example_id", "family", "prompt")
    return G.without_holdout(rows, table(spark, sf, "heldout_examples").where("prompt is not null")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_rows(spark, sf):
    rows = table(spark, sf, "sft_examples").where("prompt is not null and completion is not null")
    return rows.select("family", F.concat("prompt", F.lit("\n"), "completion").alias("key")).distinct().groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query
def fact_pool(spark, sf):
    return G.fact_pool(spark)


@query
def digit_drills(spark, sf):
    return G.digit_drills(spark)


@query
def percent_pool(spark, sf):
    return G.percent_pool(spark)


@query
def sum_pools(spark, sf):
    return G.sum_pools(spark)


@query
def parity_proofs(spark, sf):
    return G.parity_proofs(spark, ["n", "m", "r", "t"])


def orders(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 100000).alias("a"), (F.col("o_custkey") % 997).alias("b")).distinct()


@query
def add_trace(spark, sf):
    return orders(spark, sf).select("a", "b", G.add_trace(F.col("a"), F.col("b")).alias("trace"))


@query
def sub_trace(spark, sf):
    return orders(spark, sf).where("a >= b").select("a", "b", G.subtract_trace(F.col("a"), F.col("b")).alias("trace"))


@query
def longdiv_trace(spark, sf):
    return orders(spark, sf).where("b > 0").select("a", "b", G.divide_trace(F.col("a"), F.col("b")).alias("trace"))


@query
def mul_products(spark, sf):
    return orders(spark, sf).select("a", "b", G.partial_products(F.col("a"), F.col("b")).alias("products"))


@query
def gcd_pairs(spark, sf):
    return orders(spark, sf).select("a", "b", T.gcd(F.col("a"), F.col("b")).alias("gcd"))


@query
def tile_pool(spark, sf):
    return G.tile(G.percent_pool(spark), 5000, "prompt").select("i", "prompt", "answer")


@query
def weighted_targets(spark, sf):
    return G.targets({"newton": 5, "momentum": 5, "potential": 6, "kinematics": 6, "ohm_i": 8, "density": 8, "div": 14, "digits": 4}, 120_000, spark)


def answers(spark, sf):
    return table(spark, sf, "heldout_examples").select("item_id", "family", "suite", "completion", "expected")


@query
def norm_answer(spark, sf):
    return answers(spark, sf).select("item_id", S.norm(F.col("completion")).alias("normal"))


@query
def extract_final(spark, sf):
    return table(spark, sf, "sft_examples").where("completion is not null").select("example_id", S.final_line(F.col("completion")).alias("final")).distinct()


@query
def chat_answer(spark, sf):
    return answers(spark, sf).select("item_id", S.chat_observed(F.col("completion")).alias("answer"))


@query
def extract_boxed(spark, sf):
    boxed = F.concat(F.lit("so \\boxed{\\frac{"), "expected", F.lit("}{7}} ok"))
    return answers(spark, sf).select("item_id", S.extract_boxed(boxed).alias("boxed"))


@query
def observed_number(spark, sf):
    unit = F.concat("completion", F.lit(" kg/m^3"))
    return answers(spark, sf).select("item_id", S.observed_number(unit).alias("stripped"), S.observed_number(unit, exponents=False).alias("plain"))


def scored(spark, sf):
    """Held-out answers: those of two of three items as they are, the others changed."""
    observed = F.when(F.col("item_id") % 3 == 0, F.concat(F.col("expected"), F.lit("0"))).otherwise(S.chat_observed(F.col("completion")))
    return answers(spark, sf).select("item_id", "family", "suite", S.is_hit(F.col("expected"), observed).alias("hit"))


@query
def is_hit(spark, sf):
    return scored(spark, sf).select("item_id", "hit")


@query
def accuracy_by_family(spark, sf):
    return S.accuracy(scored(spark, sf))


@query
def running_accuracy(spark, sf):
    return S.running_accuracy(scored(spark, sf), "item_id", 25)


@query
def bench_pivot(spark, sf):
    suites = sorted(r[0] for r in answers(spark, sf).select("suite").distinct().collect())
    return S.pivot(scored(spark, sf).withColumnRenamed("suite", "model"), suites)


@query
def mono_vs_orch(spark, sf):
    return S.paired(scored(spark, sf).select("family", F.col("hit").alias("mono"), F.lit(True).alias("orch")))


@query
def pass_at_1(spark, sf):
    return S.pass_at_1(scored(spark, sf).select(F.col("suite").alias("task"), F.col("hit").alias("passed")).unionAll(spark.createDataFrame([("all", True)], "task string, passed boolean")))


def word_problems(spark, sf):
    """A problem of each template for the operands of the orders table, and one that no template knows."""
    n = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 97 + 2).alias("p"), (F.col("o_custkey") % 89 + 2).alias("q"))
    forms = F.array(
        F.format_string("A %d kg object accelerates at %d m/s^2. Find the net force.", "p", "q"), F.format_string("A %d kg object is lifted to a height of %d m. Find its potential energy. Use g = 10 m/s^2.", "p", "q"),
        F.format_string("A car travels at %d m/s and accelerates at %d m/s^2 for 7 s. Find its final velocity.", "p", "q"), F.format_string("An engine does %d J of work in %d s. Find its power output.", F.col("p") * F.col("q"), F.col("q")), F.format_string("What is %d of %d?", "p", "q"),
    )
    return n.select("o_orderkey", "p", "q", F.posexplode(forms).alias("k", "problem"))


def planned(spark, sf):
    """Distinct problems with their plans; explode keeps the plan from being computed again for each of its fields."""
    return word_problems(spark, sf).select("problem").distinct().select("problem", F.explode(F.array(O.decompose(F.col("problem")))).alias("plan"))


@query
def decompose_plan(spark, sf):
    out = planned(spark, sf)
    return out.select("problem", F.col("plan.family").alias("family"), F.size("plan.steps").cast("bigint").alias("n_steps")).withColumn("n_steps", F.when(F.col("family").isNotNull(), F.col("n_steps")))


@query
def execute_plan(spark, sf):
    out = planned(spark, sf).select("problem", F.explode(F.array(O.execute(F.col("plan")))).alias("r"))
    return out.where("r.ok").select("problem", F.col("r.answer").alias("answer"))


@query
def lr_schedule(spark, sf):
    return spark.range(0, 2000, 25).select(F.col("id").alias("step"), F.round(G.learning_rate(F.col("id"), 2000, 100, 6e-4, 6e-5), 12).alias("rate"))


@query
def parameter_count(spark, sf):
    return G.parameter_count(table(spark, sf, "model_configs"))


@query
def top_p_tokens(spark, sf):
    logits = table(spark, sf, "events").select((F.col("user_id") % 500).alias("step"), F.col("event_id").alias("token"), F.col("value").alias("logit"))
    return S.top_p(logits, 20, 0.9).select("step", "token", F.col("rank").cast("bigint").alias("rank"))


from skein.plans import queries_more  # noqa: E402, F401 - registers its queries
