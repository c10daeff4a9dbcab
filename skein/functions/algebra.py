"""Fractions and polynomials as columns: a term is a struct of num, den (from 1 on) and power."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import gcd


def whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def lcm(a: Column, b: Column) -> Column:
    return a * whole_div(b, gcd(a, b))


def reduced(num: Column, den: Column) -> tuple[Column, Column]:
    """The fraction in lowest terms, for den > 0."""
    g = gcd(F.abs(num).cast("bigint"), den.cast("bigint"))
    return whole_div(num, g), whole_div(den, g)


def fraction_text(num: Column, den: Column) -> Column:
    return F.when(den == 1, num.cast("string")).otherwise(F.concat(num.cast("string"), F.lit("/"), den.cast("string")))


def signed_term(n: Column) -> Column:
    return F.when(n >= 0, F.concat(F.lit("+ "), n.cast("string"))).otherwise(F.concat(F.lit("- "), (-n).cast("string")))


def term(num: Column, den: Column, power: Column) -> Column:
    n, d = reduced(num, den)
    return F.struct(n.cast("bigint").alias("num"), d.cast("bigint").alias("den"), power.cast("int").alias("power"))


def monomial_text(num: Column, den: Column, power: Column) -> Column:
    letter = F.when(power == 1, "x").otherwise(F.concat(F.lit("x^"), power.cast("string")))
    plain = fraction_text(num, den)
    factor = F.when((num == den), "").when(num == -den, "-").otherwise(plain)
    return F.when(power == 0, plain).otherwise(F.concat(factor, letter))


def polynomial_text(terms: Column) -> Column:
    """The terms that aren't 0, with signs between them; 0 without any."""
    shown = F.filter(terms, lambda t: t["num"] != 0)
    sign = lambda t, i: F.when(i == 0, F.when(t["num"] < 0, "-").otherwise("")).otherwise(F.when(t["num"] < 0, " - ").otherwise(" + "))
    parts = F.transform(shown, lambda t, i: F.concat(sign(t, i), monomial_text(F.abs(t["num"]), t["den"], t["power"])))
    return F.when(F.size(parts) == 0, "0").otherwise(F.array_join(parts, ""))


def derivative(terms: Column) -> Column:
    """Of each term; constants fall away, and what is left of nothing is 0."""
    out = F.transform(F.filter(terms, lambda t: t["power"] != 0), lambda t: term(t["num"] * t["power"], t["den"], t["power"] - 1))
    zero = F.array(F.struct(F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"), F.lit(0).alias("power")))
    return F.when(F.size(out) == 0, zero).otherwise(out)


def integral(terms: Column) -> Column:
    return F.transform(terms, lambda t: term(t["num"], t["den"] * (t["power"] + 1), t["power"] + 1))


def euclid(a: Column, b: Column) -> Column:
    """The divisions of Euclid's algorithm as texts, from the larger number on; 64-bit numbers need at most 92."""
    number = lambda c: c.cast("bigint")
    start = F.struct(number(F.greatest(a, b)).alias("x"), number(F.least(a, b)).alias("y"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, _: Column) -> Column:
        y = F.when(s["y"] == 0, 1).otherwise(s["y"]).cast("bigint")
        text = F.concat(s["x"].cast("string"), F.lit(" = "), whole_div(s["x"], y).cast("string"), F.lit(" * "), y.cast("string"), F.lit(" + "), (s["x"] % y).cast("string"))
        on = F.struct(y.alias("x"), (s["x"] % y).cast("bigint").alias("y"), F.concat(s["lines"], F.array(text)).alias("lines"))
        return F.when(s["y"] == 0, s).otherwise(on)

    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["lines"])
