"""Problem 1: records of the evaluation splits that occur again, exactly or almost, in training.

A text is the pair of its numbers (runs of digits, thousands separators dropped) and of its words
(runs of letters, in lower case), both counted with repetition.  Two texts match if their numbers are
equal and their words share at least ``threshold`` (3/4) of their union, counted with repetition.

Exact prefix-filter join, evaluation against training:

* A *class* is all texts of one field with the same numbers and the same words; equal texts meet once
  and are expanded to pairs of records at the very end.
* Only texts whose numbers occur on both sides go on; this compares hashes of the numbers alone.
* The shingles of a class are its words, the n-th repetition of a word being a shingle of its own,
  each bound to the numbers of the class.  They are ordered from rare to frequent.  Only words that
  occur in at least one of ``HEAD`` classes have a counted rank; there are at most HEAD times the mean
  number of words of those, however large the corpus.  All others are rarer and ordered by hash. Any
  fixed order gives the exact result.
* Two classes of m and n shingles that match share one of the first m - ceil(3m/4) + 1 and
  n - ceil(3n/4) + 1.  These prefixes of the evaluation classes are the index, those of the training
  classes probe it, with the length filter 3m <= 4n <= 16m/3 and the position filter: the shingle and
  all that follow it must be able to give the overlap ceil(3(m + n)/7).
* Every candidate pair is verified on the whole shingle sets.

Defined cases: the split is trimmed and lower-cased; rows with a null or blank split or a null id take
no part; null texts and texts without word and number match nothing; texts of numbers alone match if
their numbers are equal; completions need 25 words and numbers together; records delivered twice count
once; an id on both sides doesn't match itself; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import expand, folded, table
from skein.session import materialize

#: Words of one class in so many have a counted rank.
HEAD = 2000
#: Words with a rank that are broadcast at most.
BROADCAST = 500_000
#: Least number of words and numbers of a completion.
LEAST_COMPLETION = 25
#: Marks that group the digits of a number by thousands (fixed values).
THOUSANDS = ",'\u2019\u00a0\u2009\u202f"


def numbers(text: Column) -> Column:
    grouped = F.regexp_replace(text, rf"(?<=\p{{Nd}})[{THOUSANDS}](?=\p{{Nd}}{{3}}(?!\p{{Nd}}))", "")
    return F.sort_array(F.regexp_extract_all(grouped, F.lit(r"\p{Nd}+"), F.lit(0)))


def words(text: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


def wide(*columns: Column | str) -> Column:
    """Two hashes of 64 bits with different seeds: equal only for equal values, in a collection of any size."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit("again"), *columns).alias("g"))


def texts(records: DataFrame) -> DataFrame:
    """id, train, field, text, key (128 bits of the field and the numbers): one row per text."""
    sides = records.select(F.col("example_id").alias("id"), folded(F.col("split")).alias("split"), "prompt", "completion")
    sides = sides.where("id is not null and split is not null and split <> ''")
    fields = F.inline(F.array(F.struct(F.lit(0).alias("field"), F.col("prompt").alias("text")), F.struct(F.lit(1).alias("field"), F.col("completion").alias("text"))))
    rows = sides.select("id", (F.col("split") == "train").alias("train"), fields).where("text is not null")
    return rows.withColumn("key", wide("field", numbers(F.col("text"))))


def overlap_classes(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """evals (a, x), trains (b, y) and matched (a, b): the classes of all records, and which of them match."""
    rows = texts(records)
    shared = rows.groupBy("key").agg(F.max("train").alias("t"), F.min("train").alias("e")).where("t and not e").select("key")
    near = rows.join(shared, "key", "left_semi").select("id", "train", "field", "key", words(F.col("text")).alias("words"), F.size(numbers(F.col("text"))).alias("n_numbers"))
    size = F.col("n_numbers") + F.size("words")
    near = near.where((size >= LEAST_COMPLETION) | ((F.col("field") == 0) & (size > 0)))
    near = near.withColumn("cls", wide("key", "words"))
    near = materialize(near, "p1-texts")
    members = near.select("cls", "id", "train").distinct()

    # first() may take any row: those of a class are equal in all these columns
    classes = near.groupBy("cls").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.max("train").alias("t"), F.min("train").alias("e"))
    # the words are sorted, so those of a kind stand together: where they begin tells how many there are, in one pass
    classes = classes.withColumn("begins", F.expr("filter(transform(words, (w, i) -> if(i = 0 or w <> get(words, i - 1), i, null)), i -> i is not null)"))
    shingle = F.expr("flatten(transform(begins, (s, r) -> transform(sequence(1, coalesce(get(begins, r + 1), size(words)) - s), k -> struct(get(words, s) as w, k as again))))")
    tokens = classes.select("cls", "key", "t", "e", F.explode_outer(shingle).alias("s")).select("cls", "key", "t", "e", "s.w", F.xxhash64("s.w", "s.again").alias("h"))
    many = near.select("cls").distinct().count()
    head = materialize(tokens.where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") * HEAD >= many), "p1-head")
    if head.count() <= BROADCAST:
        head = F.broadcast(head)
    ordered = tokens.join(head, "w", "left").groupBy("cls").agg(
        F.first("key").alias("key"), F.first("t").alias("t"), F.first("e").alias("e"),
        F.sort_array(F.collect_list(F.when(F.col("w").isNotNull(), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")))).getField("h").alias("sh"),
    )
    ordered = materialize(ordered, "p1-classes")

    n = F.size("sh")
    prefix = F.slice("sh", 1, F.greatest(F.lit(1), n - F.expr("(3 * size(sh) + 3) div 4") + 1))
    # texts without words keep one empty shingle, so that equal numbers meet
    probe = ordered.select("cls", "key", "t", "e", n.alias("n"), F.posexplode_outer(prefix).alias("pos", "token"))
    probe = probe.withColumn("token", F.coalesce("token", F.lit(0))).withColumn("pos", F.coalesce("pos", F.lit(0)))
    left = probe.where("not e").select("key", "token", F.col("cls").alias("a"), F.col("n").alias("m"), F.col("pos").alias("i"))
    right = probe.where("t").select("key", "token", F.col("cls").alias("b"), "n", F.col("pos").alias("j"))
    pairs = left.join(right, ["key", "token"]).where(
        "3 * m <= 4 * n and 3 * n <= 4 * m and (m = 0 or least(m - i, n - j) >= (3 * (m + n) + 6) div 7)"
    ).select("a", "b").distinct()
    sets = ordered.select("cls", "sh")
    checked = pairs.join(sets.select(F.col("cls").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("sh").alias("y")), "b")
    matched = checked.where("7 * size(array_intersect(x, y)) >= 3 * (size(x) + size(y))").select("a", "b")

    evals = members.where("not train").select(F.col("cls").alias("a"), F.col("id").alias("x"))
    trains = members.where("train").select(F.col("cls").alias("b"), F.col("id").alias("y"))
    return evals, trains, matched


def overlap_pairs(records: DataFrame) -> DataFrame:
    """eval_id, train_id: every pair of an evaluation and a training record that match in a field."""
    evals, trains, matched = overlap_classes(records)
    pairs = expand(matched, evals, trains).where("x <> y")
    return pairs.select(F.col("x").alias("eval_id"), F.col("y").alias("train_id")).distinct()


def pair_counts(records: DataFrame) -> DataFrame:
    """eval_id, pairs: how many training records match each evaluation record, of those that have any.

    Records with the same classes are counted together: only kinds of records are paired, never the records.
    """
    evals, trains, matched = overlap_classes(records)

    def kinds(members: DataFrame, cls: str, record: str, kind: str) -> DataFrame:
        """record, kind, classes; a record has two classes, or a few more if it was delivered again."""
        return materialize(members.groupBy(record).agg(F.sort_array(F.collect_set(cls)).alias("classes")).select(record, F.md5(F.to_json("classes")).alias(kind), "classes"), f"p1-{kind}")

    left, right = kinds(evals, "a", "x", "e"), kinds(trains, "b", "y", "t")
    of = lambda rows, kind, cls, name: rows.select(F.col(kind).alias(name), F.explode("classes").alias(cls)).distinct()
    both = materialize(expand(matched, of(left, "e", "a", "x"), of(right, "t", "b", "y")).select(F.col("x").alias("e"), F.col("y").alias("t")).distinct(), "p1-kinds")
    sums = both.join(right.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t").groupBy("e").agg(F.sum("n").alias("n"))
    # a record of both sides doesn't count for itself
    same = left.select("x", "e").join(right.select(F.col("y").alias("x"), "t"), "x").join(both, ["e", "t"]).select("x", F.lit(1).alias("own"))
    out = left.select("x", "e").join(sums, "e").join(same, "x", "left").select(F.col("x").alias("eval_id"), (F.col("n") - F.coalesce("own", F.lit(0))).alias("pairs"))
    return out.where("pairs > 0")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap_pairs(table(spark, sf_dir, "sft_examples", "example_id", "split", "prompt", "completion"))
    return pairs.select(F.least("eval_id", "train_id").alias("example_id_a"), F.greatest("eval_id", "train_id").alias("example_id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each evaluation split and source: records, those that occur in training, and their pairs.

    A record delivered again counts by the split and source of its latest delivery; a null source is ''.
    """
    rows = table(spark, sf_dir, "sft_examples", "example_id", "split", "source", "prompt", "completion", "built_at")
    pairs = pair_counts(rows)
    evals = rows.where("example_id is not null").groupBy("example_id").agg(F.max(F.struct("built_at", folded(F.col("split")).alias("split"), F.coalesce("source", F.lit("")).alias("source"))).alias("r"))
    evals = evals.select("example_id", "r.split", "r.source").where("split is not null and split <> '' and split <> 'train'")
    return evals.join(pairs, F.col("example_id") == F.col("eval_id"), "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("pairs").alias("n_leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs")
    )
