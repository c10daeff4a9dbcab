"""Problem 4: repair of text from scanned pages.

Per document, on its lines:

* Running headers and footers are lines that break the flow of a paragraph, stand at a page's edge (first
  line, next to a form feed) or are set unlike the body (capitals, spaced letters, a page number set
  apart), and that repeat, up to misread letters and the page number, or have such a form by themselves.
* Page numbers are lines of a number alone.  Set off by signs or spaces they always count; plain ones
  count if they continue the document's sequence of page numbers or break a paragraph, so that
  numbers that belong to the text stay.
* A line is continued if its last word ends in a hyphen mark.  The corpus vocabulary decides whether the
  mark belongs to the word: the joined word against the hyphenated one.
* A word that is not in the vocabulary is misread if exchanging characters that scans confuse gives a
  word of the vocabulary; words with foreign characters (ligatures, long s, the replacement character,
  digits inside) are misread in any case.

The vocabulary counts all words of all documents that are not scans.  Words that occur twice at least are kept,
and of those the WORDS most frequent ones, so its size is bounded and its reach doesn't shrink as the corpus grows.

Defined cases: null, empty and blank texts have no line; a document's last line with a mark is not
continued; repeated rows count once in found and give repeated rows in repair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import table
from skein.session import materialize, ship

WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
SOFT = "­‐‑¬"
#: Characters by which the width of lines may be misjudged.
SLACK = 4
NUMBER = re.compile(r"^(?P<open>~ ?|[-–—] ?|\[ ?|\( ?|p\. ?|page |Page |S\. ?)?(?P<n>\d+)(?P<close> ?~| ?[-–—]| ?\]|)$")
NUMBERED = re.compile(r"^(?:(?P<left>\d+)\s{2,}(?P<a>\S.*)|(?P<b>\S.*?)\s{2,}(?P<right>\d+))$")
ROMAN = re.compile(r"^(?:[~\[(–—-] ?|p\. ?|page )?(?P<n>[ivxlcdm]{1,9})(?: ?[~\])–—-])?$", re.I)
CHAPTER = re.compile(r"^(?:chapter|kapitel|chapitre|part|section)\s+(?:\d+|[ivxlc]+)$", re.I)
#: What the characters of old type and ligatures mean (fixed values).
FORMS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s", "ꝛ": "r", "ʼ": "'"}
#: Characters read for others (fixed values): what stands there, and what may be meant.
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("1", "t"), ("2", "z"), ("3", "e"), ("3", "s"), ("4", "a"), ("5", "s"), ("6", "b"), ("6", "g"), ("6", "o"), ("7", "t"), ("8", "b"), ("9", "g"), ("9", "q"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("$", "s"), ("@", "a"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "n"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("in", "m"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("u", "n"), ("n", "u"), ("f", "s"), ("f", "t"), ("t", "f"),
    ("a", "o"), ("o", "a"), ("o", "e"), ("e", "o"), ("y", "v"), ("v", "y"), ("g", "q"), ("q", "g"), ("r", "n"), ("j", "i"), ("i", "j"), ("u", "ii"), ("h", "li"), ("d", "ol"), ("ri", "n"), ("tl", "d"), ("ä", "a"), ("a", "ä"), ("ö", "o"), ("o", "ö"), ("ü", "u"), ("u", "ü"), ("fi", "h"), ("k", "lc"), ("lc", "k"),
]
#: Names of files and addresses: no words of the text.
NAME = re.compile(r"\S*\w\.\w+\.\w\S*")
#: A word of body text with its signs off, for misreadings; digits and the signs above may stand inside.
BODY_WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*(?:[|!$@�̀-ͯ]+[^\W_]+)*�?|�[^\W_]+(?:�[^\W_]*)*")
FORMULA = re.compile(r"^\d*[a-zA-Z]\d*$|^\d+(?:st|nd|rd|th|er|e)$|^v\d+$", re.I)


class Page:
    """The lines of one document and what they are."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.bare = [line.replace("\x0c", "").rstrip() for line in self.lines]
        self.strip = [b.strip() for b in self.bare]
        # of lines with words of the body that end with a whole word: not of headers, nor of lines that a part of a word makes longer
        lengths = sorted(len(b) for b in self.bare if re.search(r"[^\W\d_]{2}.*\s[a-zß-ÿ]{2}", b) and b[-1] not in SOFT + "-")
        self.width = lengths[int(len(lengths) * 0.97)] if lengths else 0
        self.furniture = self.find_furniture()

    def short(self, i: int, skip: set[int]) -> bool:
        """Whether the first word of the next body line had ample room behind line i, so that it wasn't wrapped there."""
        j = i + 1
        while j in skip:
            j += 1
            while j < len(self.strip) and not self.strip[j]:
                j += 1
        if j >= len(self.bare) or not self.strip[j]:
            return True
        return len(self.bare[i]) + 1 + len(self.strip[j].split()[0]) <= self.width - SLACK

    def splits_word(self, i: int) -> bool:
        """Whether line i stands between the halves of a broken word."""
        a, b = i - 1, i + 1
        while a >= 0 and (not self.strip[a] or NUMBER.match(self.strip[a])):
            a -= 1
        while b < len(self.strip) and (not self.strip[b] or NUMBER.match(self.strip[b])):
            b += 1
        if a < 0 or b >= len(self.strip) or not self.strip[b][0].islower():
            return False
        return bool(re.search(r"[^\W\d_]{2}[-" + SOFT + "]$", self.strip[a])) and len(self.strip[i].split()) > 1

    def edge(self, i: int) -> bool:
        return i == 0 or "\x0c" in self.lines[i] or (i > 0 and "\x0c" in self.lines[i - 1])

    def inside(self, i: int, skip: set[int]) -> bool:
        """Whether line i stands between lines that go on: the one before isn't the end of a paragraph."""
        a, b = i - 1, i + 1
        while a in skip:
            a -= 1
        while b in skip:
            b += 1
        if a < 0 or b >= len(self.strip):
            return False
        if not self.strip[a]:
            return False
        if not self.strip[b]:  # a blank line may follow a header or footer
            b += 1
            if b >= len(self.strip) or not self.strip[b]:
                return False
        before, after = self.strip[a], self.strip[b]
        if before[-1] in SOFT + "-":
            return True
        if before[-1] not in ".!?:\"”“»)" or before[-2:] in ("f.", "g.", "p.", "c."):
            if after[0].islower() or after[0] in "=+-*<>≡(" or after[0].isdigit():
                return True
            return not self.short_against(a, after) and not after[0].isdigit()
        return after[0].islower()

    def apart(self, i: int, skip: set[int]) -> bool:
        """Whether line i belongs to neither neighbour: a sentence ends before it and another begins after it."""
        a, b = i - 1, i + 1
        while a in skip or (a >= 0 and not self.strip[a]):
            a -= 1
        while b in skip or (b < len(self.strip) and not self.strip[b]):
            b += 1
        ended = a < 0 or self.strip[a][-1] in ".!?\"”“)"
        begun = b >= len(self.strip) or not self.strip[b][0].islower()
        return ended and begun

    def short_against(self, a: int, after: str) -> bool:
        return len(self.bare[a]) + 1 + len(after.split()[0]) <= self.width - SLACK

    def find_furniture(self) -> set[int]:
        out: set[int] = set()
        plain: list[tuple[int, int]] = []
        known: list[tuple[int, int]] = []  # (line, page number)
        loose: list[int] = []
        for i, s in enumerate(self.strip):
            if not s:
                continue
            m = NUMBER.match(s)
            if m:
                n = int(m["n"])
                if m["open"] or m["close"] or len(self.bare[i]) - len(s) >= 8:
                    out.add(i)
                    known.append((i, n))
                elif self.edge(i):
                    out.add(i)
                    known.append((i, n))
                else:
                    plain.append((i, n))
                continue
            m = ROMAN.match(s)
            if m and (m["n"].islower() or m["n"].isupper()):
                if len(m["n"]) > 1 or self.edge(i):
                    out.add(i)
                    known.append((i, roman(m["n"])))
                else:
                    plain.append((i, roman(m["n"])))
                continue
            form = self.header_form(i, s)
            if form:
                out.add(i)
                if form > 1:
                    known.append((i, form - 2))
            elif s[-1] not in ".!?,;:" + SOFT and s[-1] not in "-=+<>*" and s[0].isupper():
                if self.splits_word(i):
                    out.add(i)
                else:
                    loose.append(i)
        # headers without a form of their own: repeated up to misread letters, or between lines that go on
        loose = [i for i in loose if self.short(i, out)]
        keys = {i: re.sub(r"[\W\d_]+", " ", self.strip[i]).strip().lower() for i in loose}
        counts = Counter(keys.values())
        near = near_equal(sorted(counts))
        for i in loose:
            k = keys[i]
            if " " not in k:
                continue
            again = counts[k] > 1 or k in near
            titled = title_form(self.strip[i])
            if (again and (titled or self.inside(i, out) or self.edge(i))) or (titled and (len(self.bare[i]) < 0.75 * self.width or self.edge(i) or self.inside(i, out) or self.apart(i, out))):
                out.add(i)
        # page numbers: those that go on with the sequence, or break a paragraph
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for i, n in known + plain:
            first[n], last[n] = min(i, first.get(n, i)), max(i, last.get(n, i))
        for i, n in plain:
            follows = first.get(n - 1, i) <= i - 4 or last.get(n + 1, i) >= i + 4
            if follows or self.inside(i, out):
                out.add(i)
        return out

    def header_form(self, i: int, s: str) -> int:
        """0: none; 1: a form of headers; 2 + n: one with page number n."""
        parts = s.split()
        if len(parts) >= 6 and sum(len(p) == 1 for p in parts) >= 0.8 * len(parts) and "  " in s and not re.search(r"[=<>≡+*/^]", s):
            return 1
        if CHAPTER.match(s):
            return 1
        letters = re.sub(r"[\W\d_]+", "", s)
        if len(letters) >= 5 and s.upper() == s and not s.endswith(".") and (len(parts) > 1 or self.inside(i, set())):
            beside = [self.strip[j] for j in (i - 1, i + 1) if 0 <= j < len(self.strip) and self.strip[j]]
            if not any(b.upper() == b and len(re.sub(r"[\W\d_]+", "", b)) >= 5 for b in beside):
                return 1
        m = NUMBERED.match(s)
        if m and self.bare[i][:1] != " ":
            title = m["a"] or m["b"]
            if re.search(r"[^\W\d_]{3}", title) and not re.search(r"[=≡<>]", title) and title[-1] not in ".,;:":
                return 2 + int(m["left"] or m["right"])
        return 0


def near_equal(keys: list[str]) -> set[str]:
    """The keys of which another, of nearly the same length, differs by a few letters only (a ratio over 0.85).

    A pair of s letters with so high a ratio has m > 0.425 s letters in common blocks, at most s - 2 m + 1
    blocks, and so 3 m - s - 1 common bigrams at least.  Only keys that share one of their rarest
    bigrams, as many as that number leaves, are compared; no pair is lost.
    """
    least = lambda s: 3 * (17 * s // 40 + 1) - s - 1
    grams: dict[str, set[tuple]] = {}
    for k in keys:
        had: Counter = Counter()
        grams[k] = own = set()
        for pair in zip(k, k[1:]):
            had[pair] += 1
            own.add((*pair, had[pair]))
    often = Counter(g for own in grams.values() for g in own)
    rare, holders = {}, {}
    for k, own in grams.items():
        common = min(least(s) for s in range(max(1, 2 * len(k) - 2), 2 * len(k) + 3))
        rare[k] = sorted(own, key=lambda g: (often[g], g))[: max(0, len(own) - max(1, common) + 1)]
        for g in rare[k]:
            holders.setdefault((g, len(k)), []).append(k)
    out = set()
    for k, own in grams.items():
        matcher = SequenceMatcher(None, "", k)
        seen = {k}
        for n in range(len(k) - 2, len(k) + 3):
            need = least(n + len(k))
            for g in rare[k]:
                for o in holders.get((g, n), ()):
                    if o in seen:
                        continue
                    seen.add(o)
                    if len(own & grams[o]) >= need:
                        matcher.set_seq1(o)
                        if matcher.quick_ratio() > 0.85 and matcher.ratio() > 0.85:
                            out.add(k)
                            break
                if k in out:
                    break
            if k in out:
                break
    return out


def roman(numeral: str) -> int:
    """Value of a Roman numeral, or of what a scan made of one."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in numeral.lower()]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def title_form(s: str) -> bool:
    """A short title or names, without the signs of sentences and formulas."""
    return len(s.split()) <= 10 and not re.search(r"[=<>≡*/^0-9\"“”();:.!?]", s)


class Vocabulary:
    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        #: What the replacement character may stand for: all letters with two cases.
        self.letters = sorted({c for word in counts for c in word if c.lower() != c.upper()})
        self.memory: dict[str, str | None] = {}

    def known(self, word: str) -> int:
        return self.counts.get(word, 0)

    def joined(self, left: str, right: str) -> bool:
        """Whether a mark between the two parts of a word is no part of it."""
        whole, apart = self.known((left + right).lower()), self.known(f"{left}-{right}".lower())
        if whole or apart:
            return whole >= apart
        # parts of compounds: the last and the first simple word around the mark
        a, b = left.rsplit("-", 1)[-1].lower(), right.split("-", 1)[0].lower()
        whole, apart = self.known(a + b), self.known(f"{a}-{b}")
        if whole or apart:
            return whole >= apart
        return not (self.known(a) and self.known(b) and len(a) > 2 and len(b) > 2)

    def meant(self, word: str) -> str | None:
        """What a misread word means; the word itself if it is in order; None if it can't be told."""
        low = word.lower()
        if low in self.memory:
            return self.memory[low]
        if len(self.memory) > 500_000:
            self.memory.clear()
        self.memory[low] = out = self.search(low)
        return out

    def search(self, low: str) -> str | None:
        if self.known(low):
            return low
        formed = low
        for a, b in FORMS.items():
            formed = formed.replace(a, b)
        if formed != low and self.known(formed):
            return formed
        if "-" in low and all(self.known(p) for p in low.split("-")):
            return low
        odd = any(c.isdigit() or c in "|!$@�" for c in formed)
        first = self.exchange(formed)
        best = max(first, key=self.known, default="")
        if best and self.known(best):
            return best
        if odd or formed != low:
            for one in first:
                best = max(self.exchange(one), key=self.known, default="")
                if best and self.known(best):
                    return best
            return None
        return low

    def exchange(self, word: str) -> set[str]:
        out = set()
        for a, b in CONFUSED:
            at = word.find(a)
            while at >= 0:
                out.add(word[:at] + b + word[at + len(a) :])
                at = word.find(a, at + 1)
        at = word.find("�")
        if at >= 0:
            out |= {word[:at] + c + word[at + 1 :] for c in self.letters}
        return out

    def misread(self, word: str) -> bool:
        if not word or FORMULA.match(word):
            return False
        if any(c in FORMS or c == "�" for c in word):
            return True
        letters = sum(c.isalpha() for c in word)
        digits = sum(c.isdigit() for c in word)
        if digits and letters < 2:
            return False
        found = self.meant(word)
        return found is None or found != word.lower()


def classify(text: str, vocabulary: Vocabulary) -> tuple[Page, dict[int, tuple[str, str, int]], set[int]]:
    """The page, its broken words (line -> left part, right part, line of the right part), its misread lines."""
    page = Page(text)
    body = [i for i, s in enumerate(page.strip) if s and i not in page.furniture]
    broken: dict[int, tuple[str, str, int]] = {}
    misread: set[int] = set()
    for k, i in enumerate(body):
        s = page.strip[i]
        if s[-1] in SOFT + "-" and k + 1 < len(body) and len(s) > 1:
            left = re.search(r"([^\W_][^\s\"“„(\[«]*)[-" + SOFT + "]$", s)
            right = re.match(r"[^\W_�]+(?:[-|!$@�][^\W_�]+)*�?", page.strip[body[k + 1]])
            if left and right and re.search(r"[^\W\d_]", left[1]) and re.search(r"[^\W\d_]", right[0]):
                a, b = left[1], right[0]
                if s[-1] in "­¬‐‑" or vocabulary.joined(tidy(a), tidy(b)):
                    broken[i] = (a, b, body[k + 1])
    starts = {j: b for _, b, j in broken.values()}
    for i in body:
        s = page.strip[i]
        if i in broken:
            a, b, j = broken[i]
            s = s[: len(s) - len(a) - 1]
            judge_halves(a, b, i, j, vocabulary, misread)
        if i in starts:
            s = s[len(starts[i]) :]
        if "." in s:
            s = NAME.sub(" ", s)
        for word in BODY_WORD.findall(s):
            word = word.rstrip("!|$@")
            if vocabulary.misread(word):
                misread.add(i)
                break
    return page, broken, misread


def tidy(part: str) -> str:
    for a, b in FORMS.items():
        part = part.replace(a, b)
    return part


def judge_halves(a: str, b: str, i: int, j: int, vocabulary: Vocabulary, misread: set[int]) -> None:
    """Which of the lines of a broken word hold a misread part of it."""
    whole = (a + b).lower()
    odd_a, odd_b = (bool(re.search(r"[�" + "".join(FORMS) + "]", x)) for x in (a, b))
    if odd_a:
        misread.add(i)
    if odd_b:
        misread.add(j)
    if odd_a or odd_b or vocabulary.known(whole):
        return
    found = vocabulary.meant(whole) if "-" not in whole else vocabulary.meant(whole.rsplit("-", 1)[-1] if "-" in a else whole.split("-", 1)[0])
    if found is None:
        for part, line in ((a, i), (b, j)):
            if re.search(r"\d", part):
                misread.add(line)
    elif "-" not in whole and found != whole:
        head = len(a)
        if found[:head] != whole[:head] or (len(found) == len(whole) and found[:head] != whole[:head]):
            misread.add(i)
        if found[len(found) - len(b) :] != whole[head:]:
            misread.add(j)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0):
            counts.update(WORD.findall((text.as_py() or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def vocabulary_of(texts: DataFrame) -> dict[str, int]:
    """Words with their counts in texts (text STRING), without the rarest."""
    ship(texts.sparkSession)
    counts = materialize(texts.where("text is not null").mapInArrow(count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "p4-words")
    # how many words there are of each number of occurrences, to two digits: a few hundred rows
    step = F.pow(F.lit(10.0), F.floor(F.log10("n")) - 1)
    often = counts.where("n >= 2").groupBy(F.when(F.col("n") < 100, F.col("n")).otherwise((F.floor(F.col("n") / step) * step).cast("bigint")).alias("least")).count().collect()
    least, room = 2, WORDS
    for row in sorted(often, key=lambda r: -r["least"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["least"]
    kept = counts.where(F.col("n") >= (least if room < 0 else 2)).toArrow()
    return dict(zip(kept["word"].to_pylist(), kept["n"].to_pylist()))


def finder(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words.value)
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                page, broken, misread = classify(text, vocabulary)
                out += [(doc, i + 1, "furniture") for i in page.furniture] + [(doc, i + 1, "hyphen") for i in broken] + [(doc, i + 1, "misread") for i in misread]
            docs, lines, kinds = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "line_no", "kind"])

    return run


def repair_text(text: str, vocabulary: Vocabulary) -> str:
    """Continuous paragraphs: without furniture, with broken words joined and misread words replaced."""
    page, broken, misread = classify(text, vocabulary)

    def better(word: re.Match) -> str:
        w = word.group()
        if not vocabulary.misread(w):
            return w
        found = vocabulary.meant(w)
        if found is None:
            return tidy(w)
        return found.capitalize() if w[:1].isupper() else found

    paragraphs: list[list[str]] = [[]]
    glue = False
    after_furniture = False
    for i, s in enumerate(page.strip):
        if i in page.furniture:
            after_furniture = True
            continue
        if not s:
            if not glue and not (after_furniture and paragraphs[-1] and paragraphs[-1][-1][-1:] not in ".!?:\"”)"):
                paragraphs.append([])
            continue
        if page.bare[i].startswith("   ") and not glue:
            paragraphs.append([])
        after_furniture = False
        part = s[:-1] if i in broken else s
        held = paragraphs[-1]
        if held and (glue or held[-1].endswith("-") and held[-1][-2:-1].isalpha()):
            held[-1] += part
        else:
            held.append(part)
        glue = i in broken
    out = "\n\n".join(" ".join(p) for p in paragraphs if p)
    return BODY_WORD.sub(better, out)


def repairer(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words.value)
        for batch in batches:
            texts = [repair_text(t, vocabulary) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "source_type")
    words = vocabulary_of(documents.where("source_type is null or source_type <> 'pdf'").select("text"))
    pages = documents.where("source_type = 'pdf' and doc_id is not null").select("doc_id", "text")
    return pages, spark.sparkContext.broadcast(words)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, words = scans(spark, sf_dir)
    return pages.mapInArrow(finder(words), "doc_id bigint, line_no bigint, kind string").distinct()


def p4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the continuous paragraphs of every scanned document."""
    pages, words = scans(spark, sf_dir)
    return pages.mapInArrow(repairer(words), "doc_id bigint, text string")
