"""Word problems decomposed into steps of one operation, and the steps executed by a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators.scoring import observed_number

#: Family, pattern with its numbers, unit, and steps (operation, argument, argument); arguments: the number of a group, or -1 for the result before (fixed values).
TEMPLATES = [
    ("newton", r"A (\d+) kg object accelerates at (\d+) m/s\^2\. Find the net force\.", "N", [("mul", 1, 2)]),
    ("momentum", r"An object of mass (\d+) kg moves at (\d+) m/s\. Find its momentum\.", "kg m/s", [("mul", 1, 2)]),
    ("weight", r"Find the weight of a (\d+) kg object\. Use g = (\d+) m/s\^2\.", "N", [("mul", 1, 2)]),
    ("potential", r"A (\d+) kg object is lifted to a height of (\d+) m\. Find its potential energy\. Use g = (\d+) m/s\^2\.", "J", [("mul", 1, 2), ("mul", -1, 3)]),
    ("kinematics", r"A car travels at (\d+) m/s and accelerates at (\d+) m/s\^2 for (\d+) s\. Find its final velocity\.", "m/s", [("mul", 2, 3), ("add", 1, -1)]),
    ("work", r"A force of (\d+) N moves an object (\d+) m in the direction of the force\. Find the work done\.", "J", [("mul", 1, 2)]),
    ("ohm_v", r"A current of (\d+) A flows through a (\d+) ohm resistor\. Find the voltage\.", "V", [("mul", 1, 2)]),
    ("ohm_i", r"A voltage of (\d+) V is applied across a (\d+) ohm resistor\. Find the current\.", "A", [("div", 1, 2)]),
    ("density", r"An object has mass (\d+) kg and volume (\d+) m\^3\. Find its density\.", "kg/m^3", [("div", 1, 2)]),
    ("power", r"An engine does (\d+) J of work in (\d+) s\. Find its power output\.", "W", [("div", 1, 2)]),
]
SIGN = {"mul": "*", "add": "+", "sub": "-", "div": "/"}
PLAN = "struct<family:string,unit:string,steps:array<struct<op:string,a_lit:bigint,a_ref:int,b_lit:bigint,b_ref:int>>>"


def decompose(problem: Column) -> Column:
    """The plan of a problem, null if no template is in it. An argument is a number or the index of an earlier step."""
    out = F.lit(None).cast(PLAN)
    for family, pattern, unit, steps in reversed(TEMPLATES):
        number = lambda g, p=pattern: F.nullif(F.regexp_extract(problem, p, g), F.lit("")).cast("bigint")
        made = []
        for k, (op, a, b) in enumerate(steps):
            literal = lambda x: number(x) if x > 0 else F.lit(None).cast("bigint")
            earlier = lambda x, k=k: F.lit(k - 1 if x < 0 else None).cast("int")
            made.append(F.struct(F.lit(op).alias("op"), literal(a).alias("a_lit"), earlier(a).alias("a_ref"), literal(b).alias("b_lit"), earlier(b).alias("b_ref")))
        plan = F.struct(F.lit(family).alias("family"), F.lit(unit).alias("unit"), F.array(*made).alias("steps")).cast(PLAN)
        out = F.when(problem.rlike(pattern), plan).otherwise(out)
    return out


def exact(op: Column, a: Column, b: Column) -> Column:
    """The answer of a source that computes exactly, as text."""
    value = F.when(op == "mul", a * b).when(op == "add", a + b).when(op == "sub", a - b).when((op == "div") & (b != 0), F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))))
    return value.cast("string")


def execute(plan: Column, answer: Callable[[Column, Column, Column], Column] = exact) -> Column:
    """Struct answer, ok: every step is asked for with its arguments filled in; the first one without a number ends it."""
    start = F.struct(F.array().cast("array<bigint>").alias("values"), F.lit(True).alias("ok"))

    def step(state: Column, s: Column) -> Column:
        a = F.coalesce(s["a_lit"], F.get(state["values"], s["a_ref"]))
        b = F.coalesce(s["b_lit"], F.get(state["values"], s["b_ref"]))
        value = observed_number(answer(s["op"], a, b), exponents=False).cast("bigint")
        done = F.struct(F.concat(state["values"], F.array(value)).alias("values"), value.isNotNull().alias("ok"))
        return F.when(~state["ok"], state).otherwise(done)

    finish = lambda end: F.struct(F.when(end["ok"], F.try_element_at(end["values"], F.lit(-1))).alias("answer"), end["ok"].alias("ok"))
    return F.when(plan.isNotNull(), F.aggregate(plan["steps"], start, step, finish))


def routed(plan: Column, least: int = 2) -> Column:
    """Whether a problem is taken apart: it has a plan of ``least`` steps or more."""
    return F.coalesce(F.size(plan["steps"]), F.lit(0)) >= least
