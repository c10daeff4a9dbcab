"""Problem 10: the sentences of every document, in all its languages and scripts.

A paragraph (text between blank lines) is cut at *marks*: stops, question and exclamation marks of all
scripts with the closing quotes and brackets behind them, spaces between Thai letters, and line breaks
after Thai.  A semi-Markov dynamic programme chooses which marks end a sentence.  It scores whole spans
between two marks, jointly by

* closing words: abbreviations, initials, ordinals and ellipses speak against an end, the more so if a
  number follows; stops of scripts without letter case speak for it;
* opening words: a small letter, a comma or a dash behind the mark speaks against it, a capital, an
  opening quote or an inverted mark for it;
* balance: a span that leaves a quotation or bracket open costs, as does one that closes what it didn't open;
* length: spans of a single short word, and very long ones, cost a little.

A span may hold any number of marks.  Of the beginnings more than LONG characters back only those are
kept that can still be best (``choose``), so that the work on long paragraphs stays small; paragraphs
are independent.

Defined cases: null, empty and blank texts have no sentence; a paragraph without marks is one sentence;
positions count Unicode characters from 1; repeated rows give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import table
from skein.session import ship

#: Characters from which on the length of a span costs, and the cost of each.
LONG, EACH = 400, 0.002

#: Abbreviations that never end a sentence (fixed values).
BOUND = set(
    "dr prof mr mrs ms st fig figs eq eqs sec secs thm lem prop cor def ch chap p pp vol vols vs cf e.g i.e resp approx ed eds ref refs"
    " ca vgl abb nr s bzw bspw z z.b d d.h u.a m mme mlle mm éq env p.ex c.-à-d art núm pág págs sra sr srta p.ej ej ex"
    " рис стр т т.е см гл г-н ср табл проф акад доц им ул тов инж гр ср п.п د डॉ प्रो श्री पृ".split()
)
#: Abbreviations that may end one, if a capital or nothing follows (fixed values).
LOOSE = set("etc usw a.m p.m т.д т.п д п др al jr inc ltd co b h a u min max hr hrs sec e".split())
#: Abbreviations that bind only a number that follows (fixed values).
COUNTED = set("no nos n".split())
#: Words before a German ordinal (fixed values).
BEFORE_ORDINAL = {"am", "im", "vom", "zum", "beim", "zur"}

CLOSERS = "\"'”’»›)]}」』）】〉》“"
OPENERS = "\"'“‘«‹([{「『（【〈《„¿¡‚"
PAIRS = {"“": "”", "«": "»", "‹": "›", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》"}
WIDE = "。！？｡．"
CASELESS_STOPS = "।॥؟۔።։"
MARK = re.compile(
    r"(?P<wide>[。！？｡]+)(?P<wclose>[”’」』）】》\"]*)"
    r"|(?P<stop>[.!?…।॥؟۔።։]+)(?P<close>(?:[   ]?[»›](?![^\s.,;:!?»›]))|[\"'”’)\]}“」』]*)(?P<close2>[\"'”’»)\]}“]*)(?=\s|$|(?<=[।॥؟۔])|(?<=[…]))"
    r"|(?P<thai>(?<=[ก-๛])[  ]+(?=[ก-๛]))"
    r"|(?P<line>(?<=[ก-๛])\s*\n\s*|(?<=\S)\s*\n\s*(?=[ก-๛]))"
)
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
TOKEN = re.compile(r"\S+$")
WORD_BEFORE = re.compile(r"(\S+)\s+\S+$")
THAI = re.compile(r"[ก-๛]")


def closing(text: str, start: int, mark: int, stop: str, after: str, flat: bool) -> float:
    """Evidence of the words before the mark at ``mark``; ``after`` is the character behind it; ``flat``: the text has letters of one case only."""
    if stop[0] in CASELESS_STOPS:
        return 4.0
    if stop[0] in "!?":
        return -9.0 if flat and stop == "!" and text[mark - 1].isdigit() and after else 2.0
    if len(stop) > 1 or stop == "…":
        return -1.0
    line = text[max(start, mark - 40) : mark]
    found = TOKEN.search(line)
    if not found:
        return 1.0
    token = found.group().lstrip(OPENERS + "—–-").lower()
    bare = token.replace("­", "")
    before = WORD_BEFORE.search(line)
    if bare in BOUND and not (bare in {"s", "m", "p", "d", "z", "g"} and not after):
        if bare == "sec" and not after.isdigit() and after != "(" and not flat:
            return 1.5
        return -9.0
    if bare in COUNTED:
        return -9.0 if after.isdigit() else 1.5
    last = before.group(1).lower().lstrip(OPENERS) if before else ""
    if bare in LOOSE or bare.replace(" ", "") in LOOSE:
        if bare in {"b", "h", "e", "u", "a"} and last in {"z.", "d.", "u.", "i.", "e."}:
            return -9.0
        if bare == "е" or (bare == "e" and last == "т."):
            return -9.0
        if flat and bare in {"sec", "a.m", "p.m", "max", "min", "al"} and after:
            return -9.0
        if bare in {"д", "п"} or len(bare) > 1:
            return 1.0
    if bare in {"ex", "ej"} or (bare == "е" and last == "т."):
        return -9.0
    if bare.isdigit() and last in BEFORE_ORDINAL and after.isalpha():
        return -9.0
    if len(bare) == 1 and bare.isalpha() and found.group().lstrip(OPENERS).isupper() and not flat:
        return -4.0 if after.isalpha() and after.isupper() else 1.0
    return 2.5


def opening(text: str, end: int, limit: int, quoted: bool, stop: str, flat: bool = False) -> float:
    """Evidence of what stands behind the mark, from ``end`` on; in a ``flat`` text the case of letters says nothing."""
    i = end
    while i < limit and text[i].isspace():
        i += 1
    if i >= limit:
        return 9.0
    c = text[i]
    if c in ",;:)]}»”’.!?…":
        return -9.0
    dash = c in "—–-"
    if dash:
        j = i + 1
        while j < limit and text[j].isspace():
            j += 1
        c = text[j] if j < limit else c
        if c.islower() or flat:
            return -9.0
        return -1.5 if quoted or text[i] == "-" else -0.5
    if c in OPENERS:
        while i + 1 < limit and (text[i] in OPENERS or text[i].isspace()):
            i += 1
        return -2.0 if text[i].islower() and not flat else 2.0
    if flat and (c.islower() or c.isupper()):
        return -9.0 if stop[0] in "!?" and (quoted or text[end - 1] == ")") else 1.5
    if c.islower():
        return -9.0
    if c.isupper():
        return 2.0
    if c.isdigit():
        return 0.5 if not quoted else -2.0
    if c.isalpha():  # scripts without case: behind a quotation the sentence goes on
        return -9.0 if quoted else 1.5
    return -4.0


class Balance:
    """Cost of quotations and brackets that a span leaves open, or closes without opening."""

    def __init__(self, text: str, begin: int, ends: list[int]):
        seg = text[begin : ends[-1]]
        low = "„" in seg
        pairs = [(a, b) for a, b in PAIRS.items() if (a in seg or b in seg) and not (a == "“" and low)]
        self.rows: list[tuple[float, list[int]]] = []  # cost of one, and how many are open at each end
        for a, b in pairs:
            self.rows.append((1.5, self.count(text, begin, ends, a, b)))
        if low:
            self.rows.append((1.5, self.count(text, begin, ends, "„", "“”")))
        self.quotes = self.count(text, begin, ends, '"', "") if '"' in seg else None

    @staticmethod
    def count(text: str, begin: int, ends: list[int], plus: str, minus: str) -> list[int]:
        out, last, total = [0], begin, 0
        for end in ends:
            total += text.count(plus, last, end) - sum(text.count(c, last, end) for c in minus)
            out.append(total)
            last = end
        return out

    def cost(self, i: int, j: int) -> float:
        """Of the span from end i (-1: the beginning) to end j."""
        total = 0.0
        for each, at in self.rows:
            total += each * abs(at[j + 1] - at[i + 1])
        if self.quotes and (self.quotes[j + 1] - self.quotes[i + 1]) % 2:
            total += 2.0
        return total


def length(n: int) -> float:
    return -1.0 if n < 3 else -EACH * max(0, n - LONG)


def sentence_ends(text: str) -> list[int]:
    """Position behind the last character of each sentence (that is, from 1, the position of that character)."""
    out: list[int] = []
    begin = 0
    flat = text == text.lower() or text == text.upper()
    edges = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)] + [(len(text), len(text))]
    for stop, resume in edges:
        out += paragraph_ends(text, begin, stop, flat)
        begin = resume
    return out


def choose(begin: int, ends: list[int], scores: list[float], cost: Callable[[int, int], float] | None) -> list[int]:
    """The ends of the best spans.

    Beyond LONG characters the length costs in proportion, so a beginning i is worth best[i] + EACH * its
    place, whatever the end.  As cost is a metric, one that is worth less than another by the cost
    between the two is never better than it and is dropped.
    """
    n = len(ends)
    best, back = [0.0] * n, [-1] * n
    place = lambda i: begin if i < 0 else ends[i]
    worth = lambda i: (best[i] if i >= 0 else 0.0) + EACH * place(i)
    between = cost or (lambda i, j: 0.0)
    near, far = -1, []  # the first beginning that isn't far, and those of the far ones that may be best
    for j in range(n):
        top, at, end = -1e18, -1, ends[j]
        while near < j and end - place(near) > LONG:
            if not any(worth(near) + between(i, near) < worth(i) for i in far):
                far = [i for i in far if worth(i) + between(i, near) > worth(near)] + [near]
            near += 1
        for i in (*range(j - 1, near - 1, -1), *reversed(far)):
            value = length(end - place(i)) + (best[i] if i >= 0 else 0.0)
            if cost:
                value -= cost(i, j)
            if value > top:
                top, at = value, i
        best[j], back[j] = top + scores[j], at
        if scores[j] >= 6.0:  # no span reaches over so sure an end
            near, far = j, []
    chosen, j = [], n - 1
    while j >= 0:
        chosen.append(ends[j])
        j = back[j]
    return chosen[::-1]


def paragraph_ends(text: str, begin: int, limit: int, flat: bool = False) -> list[int]:
    while limit > begin and text[limit - 1].isspace():
        limit -= 1
    while begin < limit and text[begin].isspace():
        begin += 1
    if begin == limit:
        return []
    ends, scores = [], []
    for m in MARK.finditer(text, begin, limit):
        kind = m.lastgroup
        if m["thai"] is not None or m["line"] is not None:
            end, score = m.start(), 6.0
        elif m["wide"] is not None:
            end, quoted = m.end(), bool(m["wclose"])
            rest = text[end : end + 1]
            score = -9.0 if quoted and rest and not rest.isspace() else 4.0
            if quoted and rest.isspace():
                score += opening(text, end, limit, True, m["wide"], flat)
        else:
            end = m.end()
            quoted = bool((m["close"] or "").strip("   )]}") or m["close2"])
            behind = text[end : end + 24].lstrip()
            after = behind.lstrip(OPENERS)[:1] if behind[:1] != "(" else "("
            score = closing(text, begin, m.start("stop"), m["stop"], after, flat) + opening(text, end, limit, quoted, m["stop"], flat)
            if m["stop"].startswith("…") and not text[end : end + 1].isspace():
                score = -9.0
        if end < limit:
            ends.append(end)
            scores.append(score)
    if not ends:
        return [limit]
    ends.append(limit)
    scores.append(20.0)
    balance = Balance(text, begin, ends)
    chosen = choose(begin, ends, scores, balance.cost if balance.rows or balance.quotes else None)
    out = []
    for end in chosen:
        while text[end - 1].isspace():
            end -= 1
        if not out or end > out[-1]:
            out.append(end)
    return out


def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            docs, places, ends, starts = [], [], [], []
            part = batch.slice(at, 2000)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                last = 0
                for k, end in enumerate(sentence_ends(text) if text else []):
                    while text[last].isspace():
                        last += 1
                    docs.append(doc)
                    places.append(k)
                    starts.append(last + 1)
                    ends.append(end)
                    last = end
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "place", "start_pos", "end_pos"])


def sentences(documents: DataFrame) -> DataFrame:
    """documents: doc_id BIGINT, text STRING. Returns doc_id, place (from 0), start_pos, end_pos (from 1), one row per sentence."""
    ship(documents.sparkSession)
    return documents.where("text is not null").mapInArrow(split_batches, "doc_id bigint, place bigint, start_pos bigint, end_pos bigint")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents", "doc_id", "text", "source_type").where("source_type = 'text' and doc_id is not null").select("doc_id", "text")
    return sentences(texts).select("doc_id", "end_pos").distinct()


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document, whatever its source_type, in order."""
    return sentences(table(spark, sf_dir, "documents", "doc_id", "text"))
