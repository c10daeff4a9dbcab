"""Density and quality metrics of documents, as column expressions over the whole text; ``own``: its words (``words_of``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.classify import LOWER_WEIGHT
from skein.functions.text import count_words, strip

#: Words that the metrics count (fixed values).
V1_WORDS = "theorem|proof|lemma|corollary|definition|equation|integral|matrix|algebra|calculus|geometry|topology|probability"
MATH_WORDS = "theorem|proof|lemma|definition|integral|matrix|algebra|geometry|topology|probability|equation|solution"
PHYSICS_WORDS = "force|energy|velocity|acceleration|momentum|field|charge|current|wave|frequency|mass|equation|magnetic|electric|quantum|particle|heat|temperature|pressure|density|voltage|photon|relativ"
CHEMISTRY_WORDS = "mole|molar|atom|molecule|ion|electron|bond|reaction|acid|base|compound|element|concentration|equilibrium|oxidation|reduction|enthalpy|catalyst|solution|periodic|valence|stoichiometr|organic|polymer"
SYMBOLS_V1 = r"[=+\-*/∑∫√≤≥∈∀∃]"
SYMBOLS = r"[=+\-*/^_{}\\()\[\]∑∫√≤≥∈∀∃]"
STRUCTURE = r"(?m)^[ \t]*(?:def |class |return |for |while |if |import |with |try:)"
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def chars(text: Column) -> Column:
    return F.greatest(F.lit(1), F.length(text)).cast("double")


def lines(text: Column) -> Column:
    """The lines that are not blank, stripped."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def longest(lines_: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(lines_, F.length)), F.lit(0))


def capped(c: Column, most: float = 1.0) -> Column:
    return F.least(F.lit(most), c)


def quality_v1(source: Column, text: Column, own: Column) -> Column:
    n = F.length(text).cast("double")
    count_lines = F.regexp_count(text, F.lit("\n")) + 1
    signal = capped(count_words(text, own, V1_WORDS) / F.greatest(F.lit(1.0), n / 2000.0) * 0.04, 0.35)
    symbols = capped(F.regexp_count(text, F.lit(SYMBOLS_V1)) / F.greatest(F.lit(1.0), n / 3000.0) * 0.03, 0.20)
    spaces = capped(F.regexp_count(text, F.lit(" {8,}")) / count_lines.cast("double") * 0.02, 0.25)
    longest_line = F.array_max(F.transform(F.split(text, LINE_END), F.length))
    score = F.lit(0.65) + signal + symbols - spaces - F.when(n < 1000, 0.35).otherwise(0.0) - F.when(longest_line > 20000, 0.15).otherwise(0.0) - F.when(source.isin(*LOWER_WEIGHT), 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), capped(score)))


def math_density(text: Column, own: Column) -> Column:
    return capped(count_words(text, own, MATH_WORDS) / (chars(text) / 1500.0))


def symbol_density(text: Column) -> Column:
    return capped(F.regexp_count(text, F.lit(SYMBOLS)) / (chars(text) / 25.0))


def extraction_score(text: Column, with_longest: bool = True) -> Column:
    ok_lines = F.when(longest(lines(text)) < 20000, 0.2).otherwise(0.0) if with_longest else F.lit(0.2)
    return capped(F.lit(0.65) + ok_lines + F.when(text.contains("�"), 0.0).otherwise(0.1) + F.when(F.length(text) > 1000, 0.05).otherwise(0.0))


def repetition(text: Column) -> Column:
    """Share of the lines that stand more than five times: equal lines lie together once the lines are sorted."""
    ordered = F.array_sort(lines(text))
    runs = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("repeated")),
        lambda s, x: F.struct(
            x.alias("line"),
            F.when(s["line"] == x, s["n"] + 1).otherwise(F.lit(1).cast("bigint")).alias("n"),
            # the sixth equal line brings in the five before it
            (s["repeated"] + F.when((s["line"] == x) & (s["n"] >= 6), 1).when((s["line"] == x) & (s["n"] == 5), 6).otherwise(0)).cast("bigint").alias("repeated"),
        ),
    )
    return F.coalesce(runs["repeated"], F.lit(0)) / F.greatest(F.lit(1), F.size(ordered)).cast("double")


def quality_v2(source: Column, family: Column, text: Column, math: Column, symbol: Column, extraction: Column, repeated: Column, confidence: Column) -> Column:
    base = F.when(family == "formal_proof", 0.82).when(family == "worked_problem", 0.78).when(family == "textbook_notes", 0.80).when(family == "research", 0.68).when(family == "synthetic", 0.75).otherwise(0.60)
    score = base + F.lit(0.12) * math + F.lit(0.08) * symbol + F.lit(0.10) * extraction + F.lit(0.08) * confidence - F.lit(0.20) * repeated
    score = score - F.when(F.length(text) < 700, 0.25).otherwise(0.0) - F.when(source == "math_arxiv_metadata_core", 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), capped(score))


def term_density(text: Column, own: Column, words: str) -> Column:
    return capped(count_words(text, own, words) / (chars(text) / 1500.0))


def structure_density(text: Column) -> Column:
    return capped(F.regexp_count(text, F.lit(STRUCTURE.replace("(?m)", "(?md)"))) / (chars(text) / 400.0))


def code_extraction(text: Column) -> Column:
    kept = lines(text)
    comments = F.size(F.filter(kept, lambda x: x.startswith("#"))) / F.greatest(F.lit(1), F.size(kept)).cast("double")
    return capped(F.lit(0.7) + F.when(comments < 0.7, 0.2).otherwise(0.0) + F.when(F.length(text) > 200, 0.1).otherwise(0.0))

