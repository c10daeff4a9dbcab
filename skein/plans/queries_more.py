"""More queries of the core: exercises, curricula, domain reports, paging, tokens, routing."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import catalog as K
from skein.operators import curate as U
from skein.operators import exercises as X
from skein.operators import orchestrate as O
from skein.operators import scoring as S
from skein.operators import selection as L
from skein.operators import shards as H
from skein.operators import tokens as N
from skein.plans.queries import TOKEN_SHARD, answers, documents, query, scored, selected, table, texts
from skein.sources import working as R

#: Exercises of a family, rows of a curriculum, seed.
EACH, ROWS, SEED = 40, 2_000, 7
#: Sources of the test tables that stand for those of a domain.
STANDING_FOR = {
    "physics": ["open_notes_meadow", "open_notes_cliffside", "arxiv_sim_papers", "textbook_lantern"], "chemistry": ["open_notes_harbor", "arxiv_sim_sources", "textbook_oldshelf", "scanned_press_volumes"],
    "code": ["formal_quill", "formal_tern", "readme_gallery", "contest_ferry"],
}
LETTERS = ["n", "m", "k", "r", "t", "a"]
TOKENIZER = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


def made(spark, families, plain=False):
    return X.exercises(spark, families, EACH, SEED, plain).select("family", "i", "prompt", "answer")


@query
def math_exercises(spark, sf):
    """Prompts and answers of all families of arithmetic and algebra that SQL can repeat."""
    return made(spark, [f.name for f in X.ARITHMETIC if f.name not in ("derivative", "integral")])


@query
def physics_exercises(spark, sf):
    return made(spark, [f.name for f in X.physics_families()])


@query
def chemistry_exercises(spark, sf):
    return made(spark, [f.name for f in X.CHEMISTRY])


@query
def benchmark_problems(spark, sf):
    return made(spark, X.BENCHMARK, plain=True)


@query
def symbolic_exercises(spark, sf):
    return made(spark, [f.name for f in X.SYMBOLIC if f.name != "equation"])


@query
def sft_seed(spark, sf):
    return X.seed_examples(spark, ROWS, SEED).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("n_drawn"))


@query
def polynomial_exercises(spark, sf):
    """With worked solutions; unit tests hold them against exact fractions."""
    return X.exercises(spark, ["derivative", "integral"], EACH, SEED).select("family", "i", "prompt", "completion", "answer")


@query
def fact_solutions(spark, sf):
    return X.facts(spark).select("prompt", "completion", "answer")


@query
def proof_solutions(spark, sf):
    return X.proofs(spark, LETTERS).select("prompt", "completion", "answer")


def holdout(spark, sf):
    return table(spark, sf, "heldout_examples").where("prompt is not null").select("prompt")


def counted(rows):
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.instr("completion", "Final answer: ") == 0)).alias("n_unsolved"))


@query
def math_curriculum(spark, sf):
    return counted(X.curriculum(spark, ROWS, SEED, holdout(spark, sf), LETTERS))


@query
def physics_curriculum(spark, sf):
    return counted(X.weighted(spark, X.PHYSICS_SHARES, ROWS, SEED, holdout(spark, sf)))


@query
def chemistry_curriculum(spark, sf):
    return counted(X.weighted(spark, X.CHEMISTRY_SHARES, ROWS, SEED, holdout(spark, sf)))


@query
def few_shot_prompts(spark, sf):
    pairs = [("Compute 46 + 58.", "104"), ("What is 25% of 80?", "20")]
    return table(spark, sf, "heldout_examples").where("prompt is not null").select("item_id", X.few_shot(F.col("prompt"), pairs).alias("asked"))


@query
def distinct_prompts(spark, sf):
    rows = table(spark, sf, "sft_examples").where("family is not null and prompt is not null").select("family", "prompt", "completion")
    return X.distinct_prompts(rows).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def domain(spark, sf, name):
    rows = U.domain_rows(K.upsert(table(spark, sf, "doc_catalog")), table(spark, sf, "documents"), STANDING_FOR[name])
    return U.domain_judged(rows.select("doc_id", F.col("source_name").alias("source"), "text", "token_estimate"), name)


@query
def physics_report(spark, sf):
    return U.domain_report(domain(spark, sf, "physics"))


@query
def chemistry_report(spark, sf):
    return U.domain_report(domain(spark, sf, "chemistry"))


@query
def code_report(spark, sf):
    return U.domain_report(domain(spark, sf, "code"))


@query
def catalog_page(spark, sf):
    rows = K.upsert(table(spark, sf, "doc_catalog")).where("status = 'ok'").select("source_name", "doc_id")
    return L.page(rows, ["source_name", "doc_id"], 100, 50)


@query
def first_ok_pages(spark, sf):
    return L.first_successes(K.upsert(table(spark, sf, "doc_catalog")).select("doc_id", "status", "char_count"), (F.col("status") == "ok") & (F.col("char_count") >= 500), ["doc_id"], 100).select("doc_id", "char_count")


@query
def shuffled_take(spark, sf):
    return L.shuffled(table(spark, sf, "sft_examples").where("example_id is not null").select("example_id").distinct(), "example_id", SEED, 200)


@query
def source_frequencies(spark, sf):
    rows = K.upsert(table(spark, sf, "doc_catalog")).where("status = 'ok'")
    return L.frequencies(rows, "source_name", "token_estimate")


@query
def eval_loss(spark, sf):
    """The events' values as losses: mean and perplexity by type."""
    mean = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("loss"))
    return mean.select("event_type", F.round("loss", 9).alias("loss"), F.round(F.log(T.perplexity(F.col("loss"))), 9).alias("log_perplexity"))


@query
def shard_totals(spark, sf):
    docs = texts(spark, sf).select("doc_id", (T.token_estimate(F.col("text")) + 1).alias("n_tokens"))
    parts = H.token_shards(docs, TOKEN_SHARD, [F.col("doc_id")])
    return parts.agg(F.countDistinct("shard_idx").alias("n_shards"), F.sum("n").cast("bigint").alias("n_tokens"))


@query
def payload_digest(spark, sf):
    return texts(spark, sf).select("doc_id", T.payload_digest(F.encode("text", "UTF-8")).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query
def extract_dispatch(spark, sf):
    """Texts as payloads, decoded and extracted by type or suffix."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "source_type", "cleaned_path", F.encode("text", "UTF-8").alias("content"))
    clean = T.extracted(T.decode_payload(F.col("content")), F.col("source_type"), F.col("cleaned_path"))
    return docs.select("doc_id", clean.alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query
def token_stream(spark, sf):
    """Ids of a public tokenizer with digits apart and an end-of-document id, by document."""
    ids = N.encode(texts(spark, sf).select("doc_id", "text"), TOKENIZER, end=50256, single_digits=True)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.element_at(N.framed(F.col("ids"), 50256, 50256), 2).cast("bigint").alias("first_id"))


def physics_problems(spark):
    rows = X.exercises(spark, [f.name for f in X.physics_families()], EACH, SEED)
    rows = rows.select("family", "i", "prompt", F.regexp_extract("answer", r"^(-?\d+)", 1).alias("expected"))
    return rows.select("*", F.explode(F.array(O.decompose(F.col("prompt")))).alias("plan"))


@query
def orchestrator_self_test(spark, sf):
    """Of every template: problems, those that no plan was found for, and plans with a wrong answer."""
    done = physics_problems(spark).select("family", "expected", "plan", F.explode(F.array(O.execute(F.col("plan")))).alias("r"))
    wrong = F.col("plan").isNotNull() & ~F.coalesce(F.col("r.ok") & (F.col("r.answer").cast("string") == F.col("expected")), F.lit(False))
    return done.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("plan").isNull()).alias("n_unmatched"), F.count_if(wrong).alias("n_wrong"))


@query
def routed(spark, sf):
    """Problems are taken apart only if their plan has two steps or more."""
    return physics_problems(spark).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(O.routed(F.col("plan"))).alias("n_taken_apart"))


@query
def mono_vs_orch_problems(spark, sf):
    """One arm answers with the first step of the plan, the other with all steps, joined on the problem."""
    problems = physics_problems(spark)
    first = F.when(F.col("plan").isNotNull(), F.col("plan").withField("steps", F.slice("plan.steps", 1, 1)))
    arm = lambda plan, name: problems.select("family", "i", "expected", F.explode(F.array(O.execute(plan))).alias("r")).select("family", "i", F.coalesce(F.col("r.answer").cast("string") == F.col("expected"), F.lit(False)).alias(name))
    return S.paired(arm(first, "mono").join(arm(F.col("plan"), "orch"), ["family", "i"]))


@query
def report_document(spark, sf):
    chosen = selected(spark, sf, kinds=True)
    return R.report_document(chosen, chosen.groupBy(F.lit("ok").alias("reason")).agg(F.count(F.lit(1)).alias("n")))


@query
def markdown_report(spark, sf):
    suites = sorted(r[0] for r in answers(spark, sf).select("suite").distinct().collect())
    return R.markdown_report(scored(spark, sf).withColumnRenamed("suite", "model"), suites)


@query
def manifest_rows(spark, sf):
    """The manifest of all documents with their licence: what write_jsonl writes."""
    rows = documents(spark, sf).select("doc_id", "source", "license", "source_type")
    return rows.select("doc_id", F.to_json(F.struct(*sorted(c for c in rows.columns)), {"ignoreNullFields": "false"}).alias("line"))
