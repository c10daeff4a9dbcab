"""Exercises with worked, exact solutions, from families that are declared as data.

A family draws its numbers by a hash of seed, family, number and index, so a row is the same wherever and whenever it
is made.  Names of more numbers are computed from these; prompts and answers are templates.  The steps of a
solution are templates, or operations that the traces of ``curriculum`` spell out digit by digit.
Wordings of prompts are fixed values; those of plans and steps are this library's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import algebra as A
from skein.operators.curriculum import PREFIXES, PROOF_PREFIXES, add_trace, digits_reversed, divide_trace, place, subtract_trace
from skein.operators.orchestrate import SIGN, TEMPLATES
from skein.operators.ordered import running_sum
from skein.session import materialize

Made = str | tuple[str, str] | Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Family:
    """draws: name -> least and greatest number; let: name -> expression (or the two of Spark and of standard SQL); steps: templates or (operation, a, b)."""

    name: str
    draws: dict[str, tuple[int, int]]
    prompts: tuple[str, ...]
    answer: str
    plan: str
    steps: tuple = ()
    let: dict[str, Made] = field(default_factory=dict)
    texts: dict[str, Made] = field(default_factory=dict)  # names that are texts


def arithmetic(sign: str, spoken: tuple[str, ...], group: str | None = None) -> tuple[str, ...]:
    """Prompts for a op b: the sign in 6 of 10, else in words; the first one is the plainest."""
    forms = [f"{{a}} {sign} {{b}}"] * 6 + ([f"{group} {{a}} and {{b}}"] if group else [])
    forms += [f"{{a}} {spoken[k % len(spoken)]} {{b}}" for k in range(10 - len(forms))]
    return tuple(f"{p} {f}." for f in forms for p in PREFIXES) + tuple(f"What is {f}?" for f in forms)


def asked(*expressions: str) -> tuple[str, ...]:
    return tuple(f"{p} {e}." for e in expressions for p in PREFIXES) + tuple(f"What is {e}?" for e in expressions)


DIGITS = ("List the digits of {n} from the units place.", "What are the digits of {n}, starting from the units?", "Read off the digits of {n} from the units upward.")
#: Powers that stay small: greatest exponent of each base (fixed values).
EXPONENTS = {2: 8, 3: 5, 4: 4, 5: 4, 6: 4, 7: 3, 8: 3, 9: 3, 10: 3, 11: 3, 12: 3}


def listing(n: Column) -> Column:
    return F.array_join(digits_reversed(n).cast("array<string>"), ", ")


def polynomial(c: dict[str, Column]) -> Column:
    """One to three terms of falling power with factors from -9 to 9 but 0, and at times a constant."""
    factor = lambda x: F.when(x < 0, x).otherwise(x + 1)
    one = lambda k: A.term(factor(c[f"f{k}"]), F.lit(1), 2 * (3 - k) + c[f"p{k}"])
    terms = F.when(c["many"] == 1, F.array(one(1))).when(c["many"] == 2, F.array(one(0), one(2))).otherwise(F.array(one(0), one(1), one(2)))
    return F.when(c["constant"] < 3, F.concat(terms, F.array(A.term(c["k"], F.lit(1), F.lit(0))))).otherwise(terms)


POLYNOMIAL = {"many": (1, 3), "constant": (0, 9), "k": (-9, 9)} | {f"f{k}": (-9, 8) for k in range(3)} | {f"p{k}": (-1, 0) for k in range(3)}
FRACTION = {"a": (1, 11), "b": (2, 12), "c": (1, 11), "d": (2, 12)}


def fraction_family(name: str, sign: str) -> Family:
    return Family(
        name, FRACTION, (f"Compute {{a}}/{{b}} {sign} {{c}}/{{d}}.",), "{value}", "bring both fractions to one denominator",
        ("the least common denominator of {b} and {d} is {m}", "{a}/{b} = {p}/{m} and {c}/{d} = {q}/{m}", f"the numerators give {{p}} {sign} {{q}} = {{top}}", "{top}/{m} in lowest terms is {value}"),
        {"m": (lambda c: A.lcm(c["b"], c["d"]), "lcm(b, d)"), "p": ("a * (m div b)", "a * (m // b)"), "q": ("c * (m div d)", "c * (m // d)"), "top": f"p {sign} q"},
        {"value": (lambda c: A.fraction_text(*A.reduced(c["top"], c["m"])), "CASE WHEN m // gcd(abs(top), m) = 1 THEN (top // gcd(abs(top), m))::VARCHAR ELSE (top // gcd(abs(top), m))::VARCHAR || '/' || (m // gcd(abs(top), m))::VARCHAR END")},
    )


ARITHMETIC = [
    Family("digits", {"n": (1000, 9999)}, DIGITS, "{list}", "read the number from the units upward", (("digits", "n"),), texts={"list": (lambda c: listing(c["n"]), "array_to_string(list_reverse(string_split(n::VARCHAR, '')), ', ')")}),
    Family("add", {"a": (10, 9999), "b": (10, 9999)}, arithmetic("+", ("plus", "added to"), "the sum of"), "{r}", "add column by column, with carries", (("digits", "a"), ("digits", "b"), ("add", "a", "b")), {"r": "a + b"}),
    Family("sub", {"a": (10, 9999), "b": (10, 9999)}, arithmetic("-", ("minus", "take away")), "{r}", "take the smaller number from the larger one column by column, and give the sign", (("digits", "a"), ("digits", "b"), ("sub", "hi", "lo"), "so {a} - {b} = {r}"), {"r": "a - b", "hi": "greatest(a, b)", "lo": "least(a, b)"}),
    Family("mul", {"a": (12, 99), "b": (2, 99)}, arithmetic("*", ("times", "multiplied by")), "{r}", "multiply place by place and add the products", (("mul", "a", "b"),), {"r": "a * b"}),
    Family("div", {"b": (2, 9), "q": (12, 999)}, arithmetic("/", ("divided by",)), "{q}", "divide digit by digit", (("div", "a", "b"), "nothing is left, so {b} * {q} = {a}"), {"a": "b * q"}),
    Family("order_ops", {"a": (2, 12), "b": (2, 12), "c": (2, 12)}, asked("{a} + {b} * {c}"), "{r}", "products come before sums", ("{b} * {c} = {p}", "{a} + {p} = {r}"), {"p": "b * c", "r": "a + p"}),
    Family("grouped_ops", {"a": (2, 12), "b": (2, 12), "c": (2, 12)}, asked("({a} + {b}) * {c}"), "{r}", "what stands in brackets comes first", ("{a} + {b} = {s}", "{s} * {c} = {r}"), {"s": "a + b", "r": "s * c"}),
    Family("powers", {"base": (2, 12), "e": (0, 5)}, asked("{base}^{exp}"), "{r}", "multiply by the base one power at a time", (("power", "base", "exp"),),
           {"exp": "2 + e % (CASE base " + " ".join(f"WHEN {b} THEN {e - 1}" for b, e in EXPONENTS.items()) + " END)", "r": "CASE exp " + " ".join(f"WHEN {e} THEN {' * '.join(['base'] * e)}" for e in range(2, 9)) + " END"}),
    Family("gcd", {"a": (12, 144), "b": (12, 144)}, tuple(f"{p} the greatest common divisor of {{a}} and {{b}}." for p in PREFIXES), "{g}", "divide with remainder until nothing is left", (("euclid", "a", "b"), "the last remainder before 0 is {g}"), {"g": (lambda c: A.gcd(c["a"], c["b"]), "gcd(a, b)")}),
    Family("mean", {"m": (9, 50), "u": (-4, 4), "v": (-4, 4)}, ("Find the mean of {x}, {y}, {z}.",), "{m}", "add the numbers, then divide by how many they are", (("add", "x", "y"), ("add", "xy", "z"), ("div", "s", "three")), {"x": "m + u", "y": "m + v", "z": "m - u - v", "xy": "x + y", "s": "xy + z", "three": "3"}),
    Family("linear", {"a": (2, 9), "b": (1, 20), "x": (2, 12)}, ("Solve for x: {a}x + {b} = {c}.",), "x = {x}", "undo the sum, then the product", (("sub", "c", "b"), "{a}x = {ax}", ("div", "ax", "a")), {"ax": "a * x", "c": "ax + b"}),
    Family("linear_minus", {"a": (2, 9), "b": (1, 3), "x": (2, 12)}, ("Solve for x: {a}x - {b} = {c}.",), "x = {x}", "undo the difference, then the product", (("add", "c", "b"), "{a}x = {ax}", ("div", "ax", "a")), {"ax": "a * x", "c": "ax - b"}),
    Family("two_step_linear", {"c": (2, 8), "e": (1, 7), "b": (1, 20), "x": (2, 12)}, ("Solve for x: {a}x + {b} = {c}x + {d}.",), "x = {x}", "bring x to one side and the numbers to the other", ("taking {c}x off both sides leaves {e}x + {b} = {d}", "taking {b} off both sides leaves {e}x = {ex}", ("div", "ex", "e")), {"a": "c + e", "ex": "e * x", "d": "ex + b"}),
    fraction_family("fraction", "+"), fraction_family("fraction_minus", "-"),
    Family("odd_sum", {"n": (2, 99)}, ("Find the sum of the first {n} odd positive integers.", "What is 1 + 3 + 5 + ... through the first {n} odd positive integers?", "Compute the sum of the first {n} odd positive integers."), "{r}", "the first n odd numbers add up to n * n", (("mul", "n", "n"),), {"r": "n * n"}),
    Family("triangular", {"n": (2, 99)}, ("Find 1 + 2 + ... + {n}.", "Find the sum of the first {n} positive integers.", "Compute 1 + 2 + ... + {n}."), "{r}", "the numbers from 1 to n add up to n(n + 1)/2", ("halving the even one of {n} and {next} leaves {f} * {g}", ("mul", "f", "g")), {"next": "n + 1", "f": ("CASE WHEN n % 2 = 0 THEN n div 2 ELSE n END", "CASE WHEN n % 2 = 0 THEN n // 2 ELSE n END"), "g": ("CASE WHEN n % 2 = 0 THEN n + 1 ELSE (n + 1) div 2 END", "CASE WHEN n % 2 = 0 THEN n + 1 ELSE (n + 1) // 2 END"), "r": "f * g"}),
    Family("percent", {"w": (0, 5), "k": (1, 200)}, ("What is {p}% of {n}?",), "{r}", "take hundredths", ("1% of {n} is {n}/100", ("mul", "p", "n"), ("div", "pn", "hundred")), {"p": "CASE w WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 25 WHEN 4 THEN 50 ELSE 75 END", "n": "20 * k", "pn": "p * n", "hundred": "100", "r": ("pn div 100", "pn // 100")}),
    Family("derivative", POLYNOMIAL, ("Find the derivative of {poly}.",), "{out}", "the power rule takes a x^n to a n x^(n-1)", (("rule", "d"),), texts={"terms": polynomial, "poly": lambda c: A.polynomial_text(c["terms"]), "out": lambda c: A.polynomial_text(A.derivative(c["terms"]))}),
    Family("integral", POLYNOMIAL, ("Compute the integral of {poly} with respect to x.",), "{out} + C", "the power rule takes a x^n to a/(n+1) x^(n+1)", (("rule", "i"),), texts={"terms": polynomial, "poly": lambda c: A.polynomial_text(c["terms"]), "out": lambda c: A.polynomial_text(A.integral(c["terms"]))}),
]
SPOKEN = [
    Family("add_worded", {"a": (10, 9999), "b": (10, 9999)}, ("Compute {a} plus {b}.",), "{r}", "add column by column, with carries", (("add", "a", "b"),), {"r": "a + b"}),
    Family("sub_worded", {"a": (10, 9999), "b": (10, 9999)}, ("Compute {a} minus {b}.",), "{r}", "take the smaller number from the larger one, and give the sign", (("sub", "hi", "lo"), "so {a} - {b} = {r}"), {"r": "a - b", "hi": "greatest(a, b)", "lo": "least(a, b)"}),
]
def quadratic(c: dict[str, Column]) -> Column:
    """x^2 + bx + c as text."""
    one = lambda n, power: A.term(n, F.lit(1), F.lit(power))
    return A.polynomial_text(F.array(one(F.lit(1), 2), one(c["b"], 1), one(c["c"], 0)))


SYMBOLIC = [
    Family("roots", {"p": (-10, 10), "q": (-10, 10)}, ("Find the roots of x^2 + ({b})x + ({c}) = 0.",), "x = {low}, x = {high}", "look for two numbers by their sum and product", ("{p} + {q} is the sum and {p} * {q} = {c} the product that are wanted", "so the equation is (x - ({p}))(x - ({q})) = 0"), {"b": "0 - (p + q)", "c": "p * q", "low": "least(p, q)", "high": "greatest(p, q)"}),
    Family("equation", {"p": (-9, 8), "w": (1, 17)}, ("Solve {poly} = 0 over the real numbers.",), "x = {p}, x = {q}", "factor the polynomial", ("the polynomial is (x - ({p}))(x - ({q}))",), {"q": "p + w", "b": "0 - (p + q)", "c": "p * q"}, {"poly": quadratic}),
    Family("matrix", {n: (-5, 5) for n in ("a", "b", "c", "d", "e", "f", "g", "h")}, ("For A = [[{a}, {b}], [{c}, {d}]] and B = [[{e}, {f}], [{g}, {h}]], compute AB and det(A).",), "AB = [[{s}, {t}], [{u}, {v}]], det(A) = {z}", "rows by columns, and the product of one diagonal less that of the other",
           ("the first row of AB is {s}, {t}", "the second row of AB is {u}, {v}", "({a})({d}) - ({b})({c}) = {z}"), {"s": "a * e + b * g", "t": "a * f + b * h", "u": "c * e + d * g", "v": "c * f + d * h", "z": "a * d - b * c"}),
    Family("sine_limit", {"a": (1, 6)}, ("Evaluate lim_(x→0) sin({a}*x)/x.",), "{a}", "sin(y)/y goes to 1 as y goes to 0", ("sin({a}*x)/x = {a} * sin({a}*x)/({a}*x)",)),
]
#: Kinds of seed examples, in equal parts, and how many copies of the proofs there are for so many of them (fixed values).
SEED_KINDS, PROOF_EVERY = ["add", "sub", "mul", "linear", "roots", "fraction", "odd_sum", "triangular"], 80
#: Ranges of the numbers of the physics problems; q is the result of a division, so that it is whole (fixed values).
PHYSICS_RANGES = {
    "newton": {"g1": (2, 99), "g2": (2, 50)}, "momentum": {"g1": (2, 99), "g2": (2, 99)}, "weight": {"g1": (2, 400), "g2": (10, 10)}, "potential": {"g1": (2, 80), "g2": (2, 80), "g3": (10, 10)}, "kinematics": {"g1": (2, 90), "g2": (2, 30), "g3": (2, 30)},
    "work": {"g1": (2, 99), "g2": (2, 99)}, "ohm_v": {"g1": (2, 50), "g2": (2, 99)}, "ohm_i": {"q": (2, 40), "g2": (2, 9)}, "density": {"q": (2, 80), "g2": (2, 9)}, "power": {"q": (2, 99), "g2": (2, 9)},
}
#: Shares of the families in the curricula (fixed values).
MATH_SHARES = {"digits": 2, "add": 2, "sub": 2, "mul": 1, "div": 1, "order_ops": 0.5, "grouped_ops": 0.5, "powers": 1, "mean": 1, "linear": 0.5, "linear_minus": 0.5, "two_step_linear": 1, "gcd": 2, "fraction": 1.2, "fraction_minus": 0.8, "derivative": 2, "integral": 2}
PHYSICS_SHARES = {"newton": 5, "momentum": 5, "weight": 5, "potential": 6, "kinematics": 6, "work": 5, "ohm_v": 5, "ohm_i": 8, "density": 8, "power": 8, "div": 14, "mul": 8, "add": 5, "digits": 4}
CHEMISTRY_SHARES = {"molar_mass": 5, "mass": 5, "stoichiometry": 5, "moles": 8, "molarity": 8, "sample_density": 8, "molar_mass_two": 5, "dilution": 6, "heat": 5, "div": 14, "mul": 8, "add": 5}
POOL_SHARES = {"proofs": 0.10, "facts": 0.12, "digits": 0.05, "odd_sum": 0.015, "triangular": 0.015, "percent": 0.015}
BENCHMARK = ["add", "sub", "mul", "div", "linear", "odd_sum", "triangular", "percent", "gcd", "fraction", "add_worded", "sub_worded"]


def physics_families() -> list[Family]:
    """The word problems that ``orchestrate`` takes apart, with its own steps as solution."""
    out = []
    for name, pattern, unit, steps in TEMPLATES:
        prompt, k = pattern.replace("\\^", "^").replace("\\.", "."), 0
        while "(\\d+)" in prompt:
            k += 1
            prompt = prompt.replace("(\\d+)", f"{{g{k}}}", 1)
        draws, let, spelled = PHYSICS_RANGES[name], {}, []
        if "q" in draws:
            let["g1"] = "q * g2"
        for n, (op, a, b) in enumerate(steps, 1):
            x, y = (f"g{v}" if v > 0 else f"r{n - 1}" for v in (a, b))
            let[f"r{n}"] = "q + 0" if op == "div" else f"{x} {SIGN[op]} {y}"
            spelled.append((op, x, y))
        out.append(Family(name, draws, (prompt,), f"{{r{len(steps)}}} {unit}", "put the numbers into the formula and work it out", tuple(spelled), let))
    return out


CHEMISTRY = [
    Family("molar_mass", {"n": (2, 30), "m": (2, 40)}, ("A molecule is made of {n} atoms each of atomic mass {m}. Find its molar mass.",), "{r} g/mol", "the masses of all atoms add up", (("mul", "n", "m"),), {"r": "n * m"}),
    Family("molar_mass_two", {"a": (1, 6), "u": (1, 20), "b": (1, 6), "v": (1, 20)}, ("A molecule has {a} atoms of atomic mass {u} and {b} atoms of atomic mass {v}. Find its molar mass.",), "{r} g/mol", "take both kinds of atoms by themselves, then add", (("mul", "a", "u"), ("mul", "b", "v"), ("add", "au", "bv")), {"au": "a * u", "bv": "b * v", "r": "au + bv"}),
    Family("moles", {"m": (2, 9), "n": (2, 60)}, ("How many moles are in {g} g of a substance with molar mass {m} g/mol?",), "{n} mol", "divide the mass by the molar mass", (("div", "g", "m"),), {"g": "n * m"}),
    Family("mass", {"n": (2, 40), "m": (2, 99)}, ("Find the mass of {n} mol of a substance with molar mass {m} g/mol.",), "{r} g", "multiply the amount by the molar mass", (("mul", "n", "m"),), {"r": "n * m"}),
    Family("molarity", {"v": (2, 9), "c": (2, 40)}, ("A solution has {n} mol of solute in {v} L. Find its molarity.",), "{c} mol/L", "divide the amount by the volume", (("div", "n", "v"),), {"n": "c * v"}),
    Family("stoichiometry", {"n": (2, 40), "k": (2, 9)}, ("In a reaction, 1 mol of A yields B in a 1:{k} ratio. How many moles of B form from {n} mol of A?",), "{r} mol", "the ratio multiplies the amount", (("mul", "n", "k"),), {"r": "n * k"}),
    Family("sample_density", {"d": (2, 20), "v": (2, 9)}, ("A sample has mass {m} g and volume {v} mL. Find its density.",), "{d} g/mL", "divide the mass by the volume", (("div", "m", "v"),), {"m": "d * v"}),
    Family("dilution", {"c2": (2, 20), "k": (2, 6), "v1": (2, 9)}, ("A {c1} mol/L solution of volume {v1} L is adjusted to a volume of {v2} L. Find the new concentration.",), "{c2} mol/L", "the amount stays the same", (("mul", "c1", "v1"), ("div", "n", "v2")), {"c1": "c2 * k", "v2": "v1 * k", "n": "c1 * v1"}),
    Family("heat", {"m": (2, 20), "c": (1, 9), "t": (2, 20)}, ("How much heat is absorbed when {m} g of a substance with specific heat {c} J/(g°C) is heated by {t} °C?",), "{q} J", "mass, specific heat and rise are multiplied", (("mul", "m", "c"), ("mul", "mc", "t")), {"mc": "m * c", "q": "mc * t"}),
]
FAMILIES = {f.name: f for f in [*ARITHMETIC, *SPOKEN, *SYMBOLIC, *physics_families(), *CHEMISTRY]}

#: Statements to prove, in the letters u and v (fixed values), with what they conclude, and our proofs.
PROOFS = [
    ("{p} if {u} is even, then {u}^2 is even.", "{u}^2 is even", ("let {u} = 2k", "then {u}^2 = 4k^2 = 2(2k^2)")),
    ("{p} if {u} is odd, then {u}^2 is odd.", "{u}^2 is odd", ("let {u} = 2k + 1", "then {u}^2 = 4k^2 + 4k + 1 = 2(2k^2 + 2k) + 1")),
    ("{p} 1 + 3 + 5 + ... + (2{u} - 1) = {u}^2.", "proved by induction", ("for {u} = 1 both sides are 1", "if it holds for {u}, the next odd number 2{u} + 1 makes the sum {u}^2 + 2{u} + 1 = ({u} + 1)^2")),
    ("{p} 1 + 2 + ... + {u} = {u}({u} + 1)/2.", "proved", ("write the sum S forwards and backwards, one below the other", "each of the {u} columns adds up to {u} + 1, so 2S = {u}({u} + 1)")),
    ("{p} {u}({u} + 1) is even for every integer {u}.", "{u}({u} + 1) is even", ("one of {u} and {u} + 1 is even", "a product with an even factor is even")),
    ("{p} the sum of two even integers {u} and {v} is even.", "{u} + {v} is even", ("let {u} = 2j and {v} = 2k", "then {u} + {v} = 2(j + k)")),
    ("{p} the sum of two odd integers {u} and {v} is even.", "{u} + {v} is even", ("let {u} = 2j + 1 and {v} = 2k + 1", "then {u} + {v} = 2(j + k + 1)")),
    ("{p} if {u} is even, then {u}{v} is even for any integer {v}.", "{u}{v} is even", ("let {u} = 2k", "then {u}{v} = 2(k{v})")),
]


def fill(template: Column | str, columns: dict[str, Column]) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def used(templates: tuple[str, ...]) -> set[str]:
    return {n for t in templates for n in re.findall(r"\{(\w+)\}", t)}


def draw(seed: int, family: str, name: str, low: int, high: int) -> str:
    """A number from low to high, in the standard SQL that both dialects know but for the conversion from hexadecimal."""
    return f"{low} + hexadecimal(substring(md5(concat_ws(':', '{seed}', '{family}', '{name}', cast(i as varchar(20)))), 1, 8)) % {high - low + 1}"


def spark_sql(expression: str) -> str:
    return re.sub(r"hexadecimal\((substring\(md5\(.*?\), 1, 8\))\)", r"cast(conv(\1, 16, 10) as bigint)", expression).replace("varchar(20)", "string")


def numbers(rows: DataFrame, family: Family, seed: int) -> DataFrame:
    """rows: i. Adds the numbers and texts of the family."""
    out = rows
    for name, (low, high) in family.draws.items():
        if name not in rows.columns:
            out = out.withColumn(name, F.expr(spark_sql(draw(seed, family.name, name, low, high))).cast("bigint"))
    for name, made in (family.let | family.texts).items():
        made = made[0] if isinstance(made, tuple) else made
        value = made({c: F.col(c) for c in out.columns}) if callable(made) else F.expr(made)
        out = out.withColumn(name, value if name in family.texts else value.cast("bigint"))
    return out


def mul_steps(a: Column, b: Column) -> Column:
    """The products of all places, and the sums of one after another."""
    zeros = lambda n, i: F.concat(n.cast("string"), F.repeat(F.lit("0"), i)).cast("bigint")
    da, db = digits_reversed(a), digits_reversed(b)
    pairs = F.filter(F.flatten(F.transform(da, lambda x, i: F.transform(db, lambda y, j: F.struct(zeros(x, i).alias("x"), zeros(y, j).alias("y"))))), lambda p: (p["x"] > 0) & (p["y"] > 0))
    s = lambda c: c.cast("string")
    first = F.array_join(F.transform(pairs, lambda p: F.concat(s(p["x"]), F.lit(" * "), s(p["y"]), F.lit(" = "), s(p["x"] * p["y"]))), "; ")
    products = F.transform(pairs, lambda p: p["x"] * p["y"])
    begin = F.struct(F.coalesce(F.get(products, F.lit(0)), F.lit(0)).cast("bigint").alias("sum"), F.array(first).alias("lines"))
    on = lambda state, p: F.struct((state["sum"] + p).alias("sum"), F.concat(state["lines"], F.array(F.concat(s(state["sum"]), F.lit(" + "), s(p), F.lit(": "), add_trace(state["sum"], p)))).alias("lines"))
    return F.aggregate(F.slice(products, F.lit(2), F.greatest(F.size(products) - 1, F.lit(0))), begin, on, lambda state: state["lines"])


def spelled(step, c: dict[str, Column]) -> Column:
    """The lines of one step, as an array."""
    if isinstance(step, str):
        return F.array(fill(step, {n: c[n] for n in used((step,))}))
    op, *names = step
    s = lambda n: c[n].cast("string")
    if op == "digits":
        read = F.transform(digits_reversed(c[names[0]]), lambda d, i: F.concat(place(i), F.lit(" "), d.cast("string")))
        return F.array(F.concat(F.lit("the digits of "), s(names[0]), F.lit(": "), F.array_join(read, ", ")))
    if op == "euclid":
        return A.euclid(c[names[0]], c[names[1]])
    if op == "power":
        on = lambda state, _: F.struct((state["v"] * c[names[0]]).alias("v"), F.concat(state["lines"], F.array(F.concat(state["v"].cast("string"), F.lit(" * "), s(names[0]), F.lit(" = "), (state["v"] * c[names[0]]).cast("string")))).alias("lines"))
        return F.aggregate(F.sequence(F.lit(2).cast("bigint"), c[names[1]]), F.struct(c[names[0]].alias("v"), F.array().cast("array<string>").alias("lines")), on, lambda state: state["lines"])
    if op == "rule":
        after = (lambda t: A.derivative(F.array(t))) if names[0] == "d" else (lambda t: A.integral(F.array(t)))
        return F.transform(c["terms"], lambda t: F.concat(A.polynomial_text(F.array(t)), F.lit(" becomes "), A.polynomial_text(after(t))))
    a, b = c[names[0]], c[names[1]]
    if op == "mul":
        return mul_steps(a, b)
    line = {"add": add_trace, "sub": subtract_trace, "div": divide_trace}[op](a, b)
    return F.array(F.concat(s(names[0]), F.lit(f" {SIGN[op]} "), s(names[1]), F.lit(": "), line))


def solution(plan: str, lines: Column, answer: Column) -> Column:
    steps = F.array_join(F.transform(lines, lambda t, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), t, F.lit("."))), " ")
    return F.concat(F.lit(f"Plan: {plan}. "), steps, F.lit(" Final answer: "), answer, F.lit("."))


def render(rows: DataFrame, family: Family, seed: int = 0, every_prompt: bool = False, plain: bool = False) -> DataFrame:
    """rows: i, and numbers that aren't to be drawn. Returns family, i, prompt, completion, answer: by one of the prompts, by every one, or by the first."""
    given = numbers(rows, family, seed)
    c = {n: F.col(n) for n in given.columns}
    values = {n: c[n] for n in used((*family.prompts, family.answer))}
    answer = fill(family.answer, values)
    prompts = F.array(*[F.lit(p) for p in family.prompts])
    if every_prompt:
        chosen = prompts  # taken apart below, when all else is computed
    elif plain:
        chosen = F.lit(family.prompts[0])
    else:
        chosen = F.element_at(prompts, F.expr(spark_sql(draw(seed, family.name, "prompt", 1, len(family.prompts)))).cast("int"))
    lines = F.flatten(F.array(*[spelled(s, c) for s in family.steps]))
    out = given.select("i", chosen.alias("__p"), *[v.alias(n) for n, v in values.items() if n != "i"], answer.alias("answer"), solution(family.plan, lines, answer).alias("completion"))
    if every_prompt:
        out = out.withColumn("__p", F.explode("__p"))
    return out.select(F.lit(family.name).alias("family"), "i", fill(F.col("__p"), {n: F.col(n) for n in values}).alias("prompt"), "completion", "answer")


def exercises(spark: SparkSession, names: list[str], count: int, seed: int, plain: bool = False) -> DataFrame:
    """``count`` exercises of each family, which may repeat."""
    out = None
    for name in names:
        part = render(spark.range(count).toDF("i"), FAMILIES[name], seed, plain=plain)
        out = part if out is None else out.unionByName(part)
    return out


def facts(spark: SparkSession) -> DataFrame:
    """The basic facts of one digit in every wording, with their solutions."""
    grid = spark.range(2, 10).toDF("x").join(spark.range(2, 10).toDF("y"))
    less = spark.range(11, 19).toDF("a").join(spark.range(2, 10).toDF("b"), F.expr("a - b between 1 and 9"))
    kinds = [
        (grid.selectExpr("x as a", "y as b"), Family("fact_add", {}, tuple(f"{p} {{a}} + {{b}}." for p in PREFIXES), "{r}", "know the sums of one digit by heart", ("{a} + {b} = {r}",), {"r": "a + b"})),
        (grid.selectExpr("x as a", "y as b"), Family("fact_mul", {}, tuple(f"{p} {{a}} * {{b}}." for p in PREFIXES), "{r}", "know the products of one digit by heart", ("{a} * {b} = {r}",), {"r": "a * b"})),
        (grid.selectExpr("x as q", "y as b"), Family("fact_div", {}, tuple(f"{p} {{a}} / {{b}}." for p in PREFIXES), "{q}", "read the table of products backwards", ("{b} * {q} = {a}",), {"a": "q * b"})),
        (less, Family("fact_sub", {}, tuple(f"{p} {{a}} - {{b}}." for p in PREFIXES), "{r}", "know the differences of one digit by heart", ("{a} - {b} = {r}",), {"r": "a - b"})),
    ]
    out = None
    for rows, family in kinds:
        part = render(rows.withColumn("i", F.lit(0).cast("bigint")), family, every_prompt=True)
        out = part if out is None else out.unionByName(part)
    return out


def proofs(spark: SparkSession, letters: list[str]) -> DataFrame:
    """All statements in all wordings and letters; a pair is a letter and the one after it."""
    pairs = spark.createDataFrame([(u, letters[(k + 1) % len(letters)]) for k, u in enumerate(letters)], "u string, v string")
    grid = pairs.join(spark.createDataFrame([(p,) for p in PROOF_PREFIXES], "p string"))
    out = None
    for prompt, conclusion, lines in PROOFS:
        c = {n: F.col(n) for n in ("p", "u", "v")}
        answer = fill(conclusion, c)
        text = solution("go back to the definitions", F.array(*[fill(line, c) for line in lines]), answer)
        part = grid.select(F.lit("proof").alias("family"), F.lit(0).cast("bigint").alias("i"), fill(prompt, c).alias("prompt"), text.alias("completion"), answer.alias("answer"))
        out = part if out is None else out.unionByName(part)
    return out


def pools(spark: SparkSession, letters: list[str]) -> dict[str, DataFrame]:
    """The families of few exercises, in full."""
    n = lambda low, high: spark.range(low, high).toDF("n").withColumn("i", F.col("n"))
    percent = spark.range(6).toDF("w").join(spark.range(1, 201).toDF("k")).withColumn("i", F.col("w") * 1000 + F.col("k"))
    return {
        "proofs": proofs(spark, letters), "facts": facts(spark), "digits": render(n(10, 1000), FAMILIES["digits"], every_prompt=True), "odd_sum": render(n(2, 100), FAMILIES["odd_sum"], every_prompt=True),
        "triangular": render(n(2, 100), FAMILIES["triangular"], every_prompt=True), "percent": render(percent, FAMILIES["percent"], every_prompt=True),
    }


def without(rows: DataFrame, holdout: DataFrame) -> DataFrame:
    return rows.join(holdout.select("prompt").distinct(), "prompt", "left_anti")


def share_out(rows: DataFrame, targets: dict[str, int]) -> DataFrame:
    """rows: label, ord, prompt and more. Of each label as many rows as its target says: the first ones in order, or all of them again and again."""
    goals = rows.sparkSession.createDataFrame(list(targets.items()), "label string, target bigint")
    rows = materialize(rows, "exercises")  # ranging samples its input, which would make every exercise twice
    placed = running_sum(rows, ["label"], [F.col("ord"), F.col("prompt")], F.lit(1), "__place")
    many = placed.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    out = placed.join(goals, "label").join(many, "label").withColumn("__copies", F.expr("greatest(0, (target - __place + __n - 1) div __n)")).where("__copies > 0")
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).drop("__k", "__copies", "__place", "__n", "target", "ord")


def shares(weights: dict[str, float], count: int) -> dict[str, int]:
    whole = sum(weights.values())
    return {name: int(count * w / whole) for name, w in weights.items()}


def drawn(spark: SparkSession, wanted: dict[str, int], seed: int, holdout: DataFrame) -> DataFrame:
    """label, ord, family, prompt, completion, answer: distinct exercises of each family, the first of each prompt, twice as many as wanted if there are."""
    out = None
    for name, n in wanted.items():
        part = render(spark.range(2 * n + 50).toDF("i"), FAMILIES[name], seed)
        out = part if out is None else out.unionByName(part)
    first = without(out, holdout).groupBy("family", "prompt").agg(F.min_by(F.struct("i", "completion", "answer"), "i").alias("r"))
    return first.select(F.col("family").alias("label"), F.lpad(F.col("r.i").cast("string"), 20, "0").alias("ord"), "family", "prompt", "r.completion", "r.answer")


def weighted(spark: SparkSession, weights: dict[str, float], count: int, seed: int, holdout: DataFrame) -> DataFrame:
    """By share, distinct exercises of each family; a family that has too few is repeated until its target is met."""
    wanted = shares(weights, count)
    return share_out(drawn(spark, wanted, seed, holdout), wanted)


def curriculum(spark: SparkSession, count: int, seed: int, holdout: DataFrame, letters: list[str]) -> DataFrame:
    """A mathematics curriculum: the small pools, repeated to their shares, and for the rest drawn exercises; nothing of the held-out prompts.

    Returns label (``pool:`` and its name, or the family), family, prompt, completion, answer.
    """
    targets = {f"pool:{name}": int(count * share) for name, share in POOL_SHARES.items()}
    rest = shares(MATH_SHARES, count - sum(targets.values()))
    rows = drawn(spark, rest, seed, holdout)
    for name, pool in pools(spark, letters).items():
        order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "prompt"), 256).alias("ord")
        rows = rows.unionByName(without(pool, holdout).select(F.lit(f"pool:{name}").alias("label"), order, "family", "prompt", "completion", "answer"))
    return share_out(rows, targets | rest)


def seed_examples(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """family, i, prompt, completion, answer: plain examples of all kinds in equal parts, and proofs about odd and even numbers and sums again and again; held-out prompts are not left out."""
    per_kind = -(-count // len(SEED_KINDS))
    out = exercises(spark, SEED_KINDS, per_kind, seed, plain=True)
    some = proofs(spark, ["n"]).where(F.col("prompt").startswith(PROOF_PREFIXES[0]) & ~F.col("prompt").contains("integer"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(max(1, count // PROOF_EVERY)).cast("bigint")))
    return out.unionByName(some.withColumn("i", copies))


def distinct_prompts(rows: DataFrame, by: str = "family") -> DataFrame:
    """Of each family the distinct prompts, with the least completion of each."""
    return rows.groupBy(by, "prompt").agg(F.min("completion").alias("completion"))


def few_shot(prompt: Column, pairs: list[tuple[str, str]]) -> Column:
    """A prompt behind solved examples."""
    shown = "".join(f"Problem: {p}\nAnswer: {a}\n\n" for p, a in pairs)
    return F.concat(F.lit(shown + "Problem: "), prompt, F.lit("\nAnswer:"))
