"""Scalar text functions as column expressions; nothing here needs a Python worker but ``unescape_html``."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that str.strip removes, as a character class of both regular-expression dialects (fixed values).
BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A character of a word.
WORDISH = r"[\p{L}\p{N}_]"


#: The same as a string.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize(c: Column) -> Column:
    """Line ends to LF, runs of blanks and tabs to one blank, three and more LF to two, stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_local(c: Column) -> Column:
    """Line ends to LF, the right of every line and the whole stripped; blanks inside stay."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    blank = BLANK.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
    return strip(F.regexp_replace(c, rf"{blank}+(\n|$)", "$1"))


def strip_html(c: Column) -> Column:
    """HTML to text before entities are decoded: blocks without text removed, block ends to LF, other tags to a blank."""
    c = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|section|article|h[1-6]|li|tr)>", "\n")
    return F.regexp_replace(c, r"<[^>]+>", " ")


@F.pandas_udf(StringType())
def unescape_html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The full table of entities, which no built-in function has."""
    for t in texts:
        yield t.map(lambda s: html.unescape(s) if isinstance(s, str) and "&" in s else s)


def html_to_text(c: Column) -> Column:
    return normalize(unescape_html(strip_html(c)))


def xml_to_text(c: Column) -> Column:
    return normalize(unescape_html(F.regexp_replace(c, r"<[^>]+>", " ")))


def decode_bytes(c: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(c.cast("string")), F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1"))


@F.pandas_udf(StringType())
def decode_wide(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-16 where the bytes are valid, else Latin-1; only contents that aren't UTF-8 need it."""

    def one(data: bytes) -> str:
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    for part in contents:
        yield part.map(lambda data: one(data) if isinstance(data, (bytes, bytearray)) else None)


def decode_payload(c: Column) -> Column:
    """UTF-8, else UTF-16, else Latin-1: the first in which the bytes are valid."""
    valid = F.is_valid_utf8(c.cast("string"))
    return F.when(valid, F.decode(c, "UTF-8")).otherwise(decode_wide(F.when(~valid, c)))


def extracted(text: Column, source_type: Column, path: Column) -> Column:
    """Clean text by the type of a source or the suffix of its file; null for PDF, which another program has to read."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.when((source_type == "pdf") | (suffix == ".pdf"), "pdf").when((source_type == "html") | suffix.isin(".html", ".htm"), "html").when((source_type == "xml") | (suffix == ".xml"), "xml"), F.lit("text"))
    marked = unescape_html(F.when(kind == "html", strip_html(text)).when(kind == "xml", F.regexp_replace(text, r"<[^>]+>", " ")))
    return F.when(kind == "pdf", None).when(kind.isin("html", "xml"), normalize(marked)).otherwise(normalize(text))


def payload_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def perplexity(loss: Column) -> Column:
    """Of a mean loss, which counts as 20 at most."""
    return F.exp(F.least(F.lit(20.0), loss))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for the empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("bigint")


def short_hash(c: Column) -> Column:
    """The first 24 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 24)


def dedupe_form(c: Column, limit: int | None = None) -> Column:
    """Lower case, white space to blanks, only letters, digits and common signs of ASCII; its first ``limit`` characters, or all."""
    c = F.regexp_replace(F.lower(c), rf"{BLANK}+", " ")
    c = F.regexp_replace(c, r"[^a-z0-9 =+\-*/^().,;:]+", "")
    return F.substring(c, 1, limit) if limit else c


def duplicate_key(c: Column, limit: int | None = None) -> Column:
    return short_hash(dedupe_form(c, limit))


def raw_extension(source_type: Column, url: Column) -> Column:
    """Suffix of the URL's path where it is a known one, else by source type."""
    path = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))
    by_type = F.when(source_type == "html", ".html").when(source_type == "xml", ".xml").when(source_type == "pdf", ".pdf").when(source_type == "text", ".txt").otherwise(".bin")
    return F.when(path.isin(".txt", ".html", ".htm", ".xml", ".pdf", ".json", ".md"), path).otherwise(by_type)


def words_of(c: Column) -> Column:
    """The words of a text in lower case. Make it a column of its own where several counts need it."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"{WORDISH}+"), F.lit(0))


def spelled(alternative: str) -> list[str]:
    """The spellings that an alternative with a character class stands for."""
    m = re.search(r"\[([^\]]+)\](\??)", alternative)
    if not m:
        return [alternative]
    return [s for c in [*m[1], *([""] if m[2] else [])] for s in spelled(alternative[: m.start()] + c + alternative[m.end() :])]


def count_words(text: Column, words: Column, alternatives: str, follow: str = "") -> Column:
    """How often one of the alternatives stands in ``text`` as whole words; ``words`` are its words.

    Single words are looked up among the words; only texts that hold a phrase at all are searched for
    phrases, and for the alternatives in ``follow``, which end in a sign before a word.
    """
    every = [s for a in alternatives.split("|") for s in spelled(a)]
    single = [a for a in every if " " not in a]
    # a phrase whose first word stands earlier in the list is never reached
    phrases = [a for k, a in enumerate(every) if " " in a and a.split(" ")[0] not in every[:k]]
    total = F.size(F.filter(words, lambda w: w.isin(single)))
    low = F.lower(text)
    for parts, before in ((phrases, rf"(?!{WORDISH})"), ([f for f in follow.split("|") if f], rf"(?={WORDISH})")):
        if parts:
            plain = [p.replace("\\", "") for p in parts]
            held = F.lit(False)
            for p in plain:
                held = held | F.contains(low, F.lit(p))
            total = total + F.when(held, F.regexp_count(low, F.lit(rf"(?<!{WORDISH})(?:{'|'.join(parts)}){before}"))).otherwise(0)
    return total


def clean_decoded(c: Column) -> Column:
    """Marks of a byte-level decoder replaced by what they stand for."""
    for mark, meant in (("Ġ", " "), ("Ċ", "\n"), ("ĉ", "\t"), (" :", ":"), (" .", "."), (" ,", ",")):
        c = F.replace(c, F.lit(mark), F.lit(meant))
    return c


def trim_at(c: Column, *markers: str) -> Column:
    """The text before the first of the markers."""
    places = [F.nullif(F.instr(c, m), F.lit(0)) for m in markers]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first - 1))


def prompt_of(c: Column, style: str) -> Column:
    """A prompt in the styles plain, qa and solution."""
    if style == "qa":
        return F.concat(F.lit("Question: "), c, F.lit("\nAnswer:"))
    if style == "solution":
        return F.concat(F.lit("Problem: "), c, F.lit("\nSolution:"))
    return c


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two numbers from 0 on: Euclid's steps, of which 64-bit numbers need at most 92."""
    start = F.struct(F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])
