"""Scalar goldens, worked out by hand from the definitions."""

import pytest
from pyspark.sql import functions as F

from skein.functions import classify as C
from skein.functions import quality as Q
from skein.functions import text as T
from skein.operators import scoring as S


def value(spark, column, **fields):
    names = list(fields)
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("", 0), ("abc", 1), ("abcdefgh", 2)])
def test_token_estimate(spark, text, want):
    assert value(spark, T.token_estimate(F.col("t")), t=text) == want


def test_normalise(spark):
    assert value(spark, T.normalize(F.col("t")), t=" a\t\t b\r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert value(spark, T.normalize_local(F.col("t")), t="a  b \r\nc\t") == "a  b\nc"
    assert value(spark, T.html_to_text(F.col("t")), t="<p>A&amp;B</p><script>x</script>C<br/>D") == "A&B\n C\nD"
    assert value(spark, T.xml_to_text(F.col("t")), t="<a>x</a> &lt;y") == "x <y"
    assert value(spark, T.strip(F.col("t")), t="   a 　") == "a"
    assert value(spark, T.normalize(F.col("t")), t=None) is None


def test_dedupe_form(spark):
    assert value(spark, T.dedupe_form(F.col("t")), t="Été\n\nX = 1!") == "t x = 1"
    assert value(spark, T.duplicate_key(F.col("t")), t="A  b") == value(spark, T.duplicate_key(F.col("t")), t="a b!")
    assert value(spark, T.dedupe_form(F.col("t"), 3), t="abcdef") == "abc"


@pytest.mark.parametrize("kind,url,want", [("html", "https://x.org/a.PDF?q#f", ".pdf"), ("xml", "https://x.org/a", ".xml"), ("other", "https://x.org/a.exe", ".bin"), ("text", "https://x.org/", ".txt")])
def test_extension(spark, kind, url, want):
    assert value(spark, T.raw_extension(F.col("k"), F.col("u")), k=kind, u=url) == want


@pytest.mark.parametrize("text,want", [("permitted use", 0.95), ("licenses vary", 0.60), ("varies", 0.45), ("see-repository-license", 0.80)])
def test_license(spark, text, want):
    assert value(spark, C.license_confidence(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "domain,text,want",
    [("math", "prime matrix", "algebra"), ("math", "xyz", "general_math"), ("math", "éprime", "general_math"), ("math", "number theory, number theory", "number_theory"), ("physics", "gravity", "general_physics"), ("physics", "quantum photon force", "modern_physics"), ("physics", "schrödinger", "modern_physics"), ("chemistry", "molar mass", "stoichiometry"), ("code", "class Foo", "data_structures"), ("code", "class ", "general_python"), ("code", "os.path", "io_system")],
)
def test_topic(spark, domain, text, want):
    counts = C.topic_counts(domain, F.col("t"), T.words_of(F.col("t")))
    assert value(spark, C.topic_of(domain, counts), t=text) == want


def test_level_and_family(spark):
    assert value(spark, C.level_of(F.col("s"), F.col("t")), s="math_wikipedia_x", t="an undergraduate note") == "graduate"
    assert value(spark, C.math_family(F.col("s")), s="arxiv_x") == "research"
    assert value(spark, C.science_family(F.col("s")), s="openstax_physics_textbooks") == "other"
    assert value(spark, C.science_family(F.col("s"), True), s="openstax_chemistry_textbooks") == "textbook"
    assert value(spark, C.format_of(F.col("s"), F.col("k")), s="arxiv_math_papers", k="pdf") == "paper"


def test_repetition(spark):
    assert value(spark, Q.repetition(F.col("t")), t="a\n" * 6 + "b\n" * 2) == 0.75
    assert value(spark, Q.repetition(F.col("t")), t="a\n" * 5) == 0
    assert value(spark, Q.repetition(F.col("t")), t="") == 0


def test_gcd(spark):
    df = spark.createDataFrame([(12, 18), (0, 7), (7, 0), (2**62, 3)], "a bigint, b bigint")
    assert [r[0] for r in df.select(T.gcd(F.col("a"), F.col("b"))).collect()] == [6, 7, 7, 1]


def test_trim_and_prompt(spark):
    assert value(spark, T.trim_at(F.col("t"), "<e>", "Problem:"), t="ab Problem: c <e>") == "ab "
    assert value(spark, T.prompt_of(F.col("t"), "qa"), t="x") == "Question: x\nAnswer:"
    assert value(spark, T.clean_decoded(F.col("t")), t="aĠbĊ :") == "a b\n:"


def test_answers(spark):
    assert value(spark, S.norm(F.col("t")), t="13,118.") == "13118"
    for e, o, want in (("x = 6", "6", True), ("7/4", "1.75", True), ("25/12", "50/24", True), ("5", None, False), ("3", "4", False), ("1/0", "1", False), ("\\frac{7}{4}", "7/4", True)):
        assert value(spark, S.is_hit(F.col("e"), F.col("o")), e=e, o=o) is want, (e, o)
    assert value(spark, S.extract_boxed(F.col("t")), t="so \\boxed{\\frac{7}{4}} ok") == "\\frac{7}{4}"
    assert value(spark, S.extract_boxed(F.col("t")), t="\\boxed{1 + {2}") == "1 + {2}"
    assert value(spark, S.extract_boxed(F.col("t")), t="none") is None
    assert value(spark, S.final_line(F.col("t")), t="Final answer: 3\nfinal answer: 4 <end>") == "4"
    assert value(spark, S.chat_observed(F.col("t")), t="Answer: Answer: 55.") == "55"
    assert value(spark, S.chat_observed(F.col("t")), t="it is 1,234 or 5/6") == "5/6"
    assert value(spark, S.chat_observed(F.col("t")), t="a\nlast ") == "last"
    assert value(spark, S.observed_number(F.col("t")), t="5 kg/m^3") == "5"
    assert value(spark, S.observed_number(F.col("t"), exponents=False), t="5 kg/m^3") == "3"
    assert value(spark, S.observed_number(F.col("t")), t="26 + 99 = 125") == "125"
    assert value(spark, S.eval_hit(F.col("e"), F.col("o")), e="636", o="6 36 or 7") is True
    assert value(spark, S.eval_hit(F.col("e"), F.col("o")), e="n^2 is even", o="So n^2 is  EVEN") is True
    assert value(spark, S.judged_answer(F.col("t")), t="Therefore the answer is 12.") == "12"
    assert value(spark, S.extract_code(F.col("t"), "f"), t="x\n```python\ndef f(a):\n    return a\n```\nProblem: y").startswith("def f(a):\n    return a")
