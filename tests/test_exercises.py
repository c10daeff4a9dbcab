"""Exercises against arithmetic done here."""

import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skein.functions import algebra as A
from skein.functions import text as T
from skein.operators import exercises as X

PLAIN = [f.name for f in X.ARITHMETIC if f.name not in ("derivative", "integral", "digits")]


def value(prompt):
    p = prompt.replace("divided by", "/").replace("multiplied by", "*").replace("times", "*").replace("plus", "+").replace("added to", "+").replace("minus", "-").replace("take away", "-")
    if m := re.search(r"divisor of (\d+) and (\d+)", p):
        return Fraction(math.gcd(int(m[1]), int(m[2])))
    if m := re.search(r"the sum of (\d+) and (\d+)", p):
        return Fraction(int(m[1]) + int(m[2]))
    if m := re.search(r"mean of (.*)\.", p):
        n = list(map(int, m[1].split(", ")))
        return Fraction(sum(n), len(n))
    if m := re.search(r"(\d+)% of (\d+)", p):
        return Fraction(int(m[1]) * int(m[2]), 100)
    if m := re.search(r"for x: (\d+)x ([+-]) (\d+) = (?:(\d+)x \+ )?(\d+)", p):
        return Fraction(int(m[5]) - int(m[2] + m[3]), int(m[1]) - int(m[4] or 0))
    if "odd" in p:
        n = int(re.search(r"first (\d+)", p)[1])
        return Fraction(sum(range(1, 2 * n, 2)))
    if m := re.search(r"\+ (\d+)\.$|first (\d+) positive", p) if ("..." in p or "positive integers" in p) else None:
        return Fraction(sum(range(1, int(m[1] or m[2]) + 1)))
    inner = re.search(r"[\d(][\d+\-*/^() ]*", p)[0].replace("^", "**").strip()
    return Fraction(eval(re.sub(r"(?<!\*)(\d+)", r"Fraction(\1)", inner)))  # noqa: S307 - of our own making


@pytest.fixture(scope="module")
def made(spark):
    return X.exercises(spark, PLAIN + ["digits", "derivative", "integral"], 25, 3).collect()


def test_answers_are_right_and_end_the_solutions(made):
    for r in made:
        assert r["completion"].endswith(f" Final answer: {r['answer']}.") and r["completion"].startswith("Plan: "), r
        if r["family"] in PLAIN:
            assert Fraction(r["answer"].removeprefix("x = ")) == value(r["prompt"]), r


def test_every_equation_in_a_solution_holds(made):
    for r in made:
        for left, right in re.findall(r"(?<![\dx^/.])(\d+ [+*-] \d+) = (\d+)(?![\d/^x])", r["completion"]):
            if "carried" not in left:
                assert eval(left) == int(right), (left, right, r)  # noqa: S307


def test_digits(made):
    for r in made:
        if r["family"] == "digits":
            assert r["answer"] == ", ".join(re.search(r"\d+", r["prompt"])[0][::-1])


def terms_of(text):
    out = {}
    for sign, num, den, x, power in re.findall(r"(-|\+|^)\s*(\d*)(?:/(\d+))?(x?)(?:\^(\d+))?", text.replace(" ", "")):
        if num or x:
            k = int(power or 1) if x else 0
            out[k] = out.get(k, 0) + Fraction(int(num or 1), int(den or 1)) * (-1 if sign == "-" else 1)
    return {k: v for k, v in out.items() if v}


def test_polynomials(made):
    seen = 0
    for r in made:
        if m := re.match(r"Find the derivative of (.*)\.", r["prompt"]):
            assert terms_of(r["answer"]) == {k - 1: v * k for k, v in terms_of(m[1]).items() if k}, r
            seen += 1
        if m := re.match(r"Compute the integral of (.*) with respect to x\.", r["prompt"]):
            assert r["answer"].endswith(" + C") and terms_of(r["answer"].removesuffix(" + C")) == {k + 1: v / (k + 1) for k, v in terms_of(m[1]).items()}, r
            seen += 1
    assert seen == 50


def test_symbolic_families(spark):
    rows = X.exercises(spark, [f.name for f in X.SYMBOLIC], 20, 5).collect()
    for r in rows:
        n = list(map(int, re.findall(r"(?<![\w^])-?\d+", r["answer"])))
        if r["family"] == "roots":
            b, c = map(int, re.findall(r"\((-?\d+)\)", r["prompt"]))
            assert b == -sum(n) and c == n[0] * n[1] and n[0] <= n[1]
        if r["family"] == "equation":
            terms = terms_of(re.match(r"Solve (.*) = 0", r["prompt"])[1])
            assert all(sum(v * x**k for k, v in terms.items()) == 0 for x in n) and n[0] < n[1]
        if r["family"] == "matrix":
            a, b, c, d, e, f, g, h = map(int, re.findall(r"-?\d+", r["prompt"]))
            assert n == [a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h, a * d - b * c]
    seeds = X.seed_examples(spark, 160, 1)
    assert {r["family"]: r["count"] for r in seeds.groupBy("family").count().collect()} == dict.fromkeys(X.SEED_KINDS, 20) | {"proof": 8}


def test_fractions_and_monomials(spark):
    c = lambda *v: [F.lit(x) for x in v]
    shown = [A.monomial_text(*c(1, 1, 3)), A.monomial_text(*c(-1, 1, 1)), A.monomial_text(*c(-3, 2, 2)), A.monomial_text(*c(5, 1, 0)), A.signed_term(F.lit(-4)), A.signed_term(F.lit(0)), A.fraction_text(*A.reduced(F.lit(-6), F.lit(4))), A.lcm(F.lit(6), F.lit(4)).cast("string")]
    row = spark.range(1).select(F.array(*shown)).first()[0]
    assert row == ["x^3", "-x", "-3/2x^2", "5", "- 4", "+ 0", "-3/2", "12"]
    nothing = F.array(A.term(F.lit(0), F.lit(1), F.lit(2)))
    assert spark.range(1).select(A.polynomial_text(nothing), A.polynomial_text(A.derivative(F.array(A.term(F.lit(7), F.lit(1), F.lit(0)))))).first()[:] == ("0", "0")
    assert spark.range(1).select(A.euclid(F.lit(12), F.lit(30))).first()[0] == ["30 = 2 * 12 + 6", "12 = 2 * 6 + 0"]


def test_pools_and_holdout(spark):
    facts = X.facts(spark)
    assert facts.select("prompt").distinct().count() == facts.count() == 1140
    held = spark.createDataFrame([("Compute 2 + 2.",), (None,)], "prompt string")
    assert X.without(facts, held).count() == 1139
    assert X.proofs(spark, ["n", "m"]).select("prompt").distinct().count() >= 40


def test_share_out_repeats_small_pools(spark):
    rows = spark.createDataFrame([("a", "1", "p1"), ("a", "2", "p2"), ("b", "1", "q")], "label string, ord string, prompt string")
    out = sorted(tuple(r) for r in X.share_out(rows, {"a": 5, "b": 0}).select("label", "prompt").collect())
    assert out == [("a", "p1")] * 3 + [("a", "p2")] * 2


def test_weighted_curriculum(spark):
    held = spark.createDataFrame([], "prompt string")
    rows = X.weighted(spark, {"newton": 1, "weight": 3}, 100, 5, held)
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {"newton": 25, "weight": 75}
    assert rows.where("label = 'newton'").select("prompt").distinct().count() == 25


def test_few_shot_and_perplexity(spark):
    row = spark.range(1).select(X.few_shot(F.lit("Q"), [("a", "1")]), T.perplexity(F.lit(50.0)), T.perplexity(F.lit(0.0))).first()
    assert row[0] == "Problem: a\nAnswer: 1\n\nProblem: Q\nAnswer:" and row[1] == pytest.approx(math.exp(20)) and row[2] == 1.0
