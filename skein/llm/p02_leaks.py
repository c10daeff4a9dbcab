"""Problem 2: held-out test items that stand, whole or in part, in documents.

A document leaks an item if it holds ``PASSAGE`` (13) consecutive words of the item's prompt, or the
whole prompt where that is shorter.  Words are runs of letters and digits after the removal of markup
tags, entities, invisible characters and compatibility forms.  As ``a<b ... c>d`` may be comparisons or a
tag, documents are also read with only what has the syntax of a tag removed, and with nothing removed;
prompts are read in these two ways.  A hyphen at a line end may belong to the word or not: each one is read in
every way that gives words of the items.

Size-partitioned MinHash containment search, in one pass over the documents:

* The *passages* of an item are its shingles of 13 words, or the one of all its words.
* Items are partitioned by their number of words.  A partition with lower bound L takes every window
  of L consecutive words as a set of shingles of (L + 1) // 2 words; items of 13 words and more form
  the last partition with L = 13.
* The sketch of a window is the MinHash (the least hash) of its shingles.  A document that holds a
  passage of an item has a window with the same shingles and so with the same MinHash: unlike a band
  of random rows, the sketch of windows misses nothing, for documents of any length.
* A bitmap of fixed size (SKETCH_BITS) of the items' sketches, and one of their words, are the only broadcasts, however
  many items there are.  Windows of documents whose sketch is in the bitmap are candidates.
* Verification: candidates are joined with the passages of the items on all their words.  The share of an item's
  passages that a document holds is its containment.

Defined cases: null texts, null ids and prompts without words match nothing; repeated rows count once;
several items with the same prompt are all reported; of a word broken at more than CHAIN line ends only two
readings are tried, that with all hyphens and that with none.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import bitmap, table
from skein.llm.textwork import WORD, U, WordIds, Words, folded_form, held, shingles, sliding_min, whole
from skein.session import materialize, ship

PASSAGE = 13
#: Lower bounds of the partitions by number of words.
BOUNDS = (1, 2, 3, 4, 6, 8, 10, PASSAGE)
#: Bits of the bitmaps: slots of sketches and of words.
SKETCH_BITS, WORD_BITS = 26, 24
#: Line ends in one word of which all combinations are read.
CHAIN = 6

INVISIBLE = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff"))
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>")
#: Tags without attributes, or with such as have a value or need none.
SURE_TAG = re.compile(
    r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+(?:[A-Za-z_:@][\w:.-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+)"
    r"|(?:disabled|checked|selected|required|readonly|multiple|hidden|async|defer|open|controls|loop|muted|autofocus|autoplay|novalidate|reversed|nowrap|noshade|compact)(?=[\s/>])))*\s*/?>"
    r"|<![A-Za-z][^<>]*>",
    re.I,
)
BROKEN = re.compile(r"(?<=\w)[-\u2010\u2011\u00ad\u00ac][ \t\r\f]*\n\s*(?=\w)")
#: Stands for a hyphen at a line end; a character of the private area.
MARK = "\ue000"
MARKED_WORD = re.compile(rf"[^\W_]+(?:{MARK}[^\W_]+)*")
WIKI_LINK = re.compile(r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]")
MD_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")
LATEX_NAME = re.compile(r"\\[A-Za-z]+\*?")


def untagged(tag: re.Pattern, text: str) -> str:
    """Without comments that end, and without what ``tag`` matches."""
    parts, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        parts.append(text[at:begin])
        at = end + 3
    text = " ".join([*parts, text[at:]]) if parts else text
    return tag.sub(" ", text)


def without(tag: re.Pattern | None, text: str) -> str:
    """The text without what ``tag`` matches, without entities and invisible characters."""
    if tag and "<" in text:
        text = untagged(tag, text)
    if "&" in text:
        text = html.unescape(text)
        if tag and "<" in text:
            text = untagged(tag, text)
    return text if text.isascii() else text.translate(INVISIBLE)


def choices(token: str, known) -> list[tuple[str, ...]]:
    """The words that a token with marks may be, every hyphen joined or kept; inner words must be words of the items, and one of the outer ones."""
    parts = token.split(MARK)
    if len(parts) > CHAIN + 1:
        return [("".join(parts),), tuple(parts)]
    out = []
    for cuts in itertools.product((False, True), repeat=len(parts) - 1):
        words = [parts[0]]
        for part, cut in zip(parts[1:], cuts):
            if cut:
                words.append(part)
            else:
                words[-1] += part
        if all(map(known, words[1:-1])) and (known(words[0]) or known(words[-1])):
            out.append(tuple(words))
    return out or [tuple(parts)]


def read(text: str, known) -> list[list[str]]:
    """Word lists that together hold every passage of the text: the whole text once, and what stands around hyphens of several readings."""
    if not BROKEN.search(text):
        return [WORD.findall(folded_form(text if text.isascii() else text.replace("\u00ad", "")))]
    marked = BROKEN.sub(MARK, text.replace(MARK, " ")).replace("\u00ad", "")
    tokens = [choices(t, known) if MARK in t else [(t,)] for t in MARKED_WORD.findall(folded_form(marked))]
    out = [[w for t in tokens for w in t[0]]]
    open_ = [k for k, t in enumerate(tokens) if len(t) > 1]
    begin = 0
    for k in range(1, len(open_) + 1):
        if k < len(open_) and open_[k] - open_[k - 1] < PASSAGE:
            continue
        group, begin = open_[begin:k], k
        # a pattern of as many choices as a passage can meet, repeated, gives every combination at every place
        period = max(sum(a <= b < a + PASSAGE for b in group) for a in group)
        for pattern in itertools.product(range(max(len(tokens[i]) for i in group)), repeat=period):
            if any(pattern):
                chosen = {i: tokens[i][pattern[n % period] % len(tokens[i])] for n, i in enumerate(group)}
                around = range(max(0, group[0] - PASSAGE), min(len(tokens), group[-1] + PASSAGE + 1))
                out.append([w for i in around for w in chosen.get(i, tokens[i][0])])
    return out


def readings(text: str, known) -> list[list[str]]:
    """Word lists of a document, for every view of its tags, and where it has such without link targets and command names."""
    forms = []
    for tag in (TAG, SURE_TAG, None) if "<" in text or "&" in text else (None,):
        kept = without(tag, text)
        forms.append(kept)
        if "](" in kept or "[[" in kept or "\\" in kept:
            forms.append(LATEX_NAME.sub(" ", MD_LINK.sub(r"\1", WIKI_LINK.sub(r"\1", kept))))
    return [words for form in dict.fromkeys(forms) for words in read(form, known)]


def prompt_readings(prompt: str) -> list[list[str]]:
    """Word lists of an item: without what has the syntax of a tag, and with it; hyphens at line ends joined, and kept."""
    out = []
    for kept in dict.fromkeys(without(tag, prompt) for tag in (SURE_TAG, None)):
        for joined in (BROKEN.sub("", kept), kept):
            words = WORD.findall(folded_form(joined.replace("\u00ad", "")))
            if words and words not in out:
                out.append(words)
    return out


def bound(n: int) -> int:
    return max(b for b in BOUNDS if b <= n)


def sketch(ids: np.ndarray, width: int) -> np.ndarray:
    """MinHash of the window of ``width`` words from every place on."""
    k = (width + 1) // 2
    return sliding_min(shingles(ids, k), width - k + 1)


def slot_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The low bits: a least hash is small, but its low bits are as even as those of any other."""
    return (hashes & U((1 << bits) - 1)).astype(np.int64)


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, prompt -> item_id, passage, size, sketch (slot of each window of the partition), words (slots)."""
    ids = WordIds()
    for batch in batches:
        rows: list[tuple] = []
        for item, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in prompt_readings(prompt):
                size = min(len(words), PASSAGE)
                hashed = ids.array(words)
                slots = slot_of(sketch(hashed, bound(size)), SKETCH_BITS).tolist()
                known = slot_of(hashed, WORD_BITS).tolist()
                rows += [(item, " ".join(words[i : i + size]), size, slots[i], known[i : i + size]) for i in range(len(words) - size + 1)]
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["item_id", "passage", "size", "sketch", "words"])


class Known(dict):
    """Whether a word may be one of the items' words."""

    def __init__(self, bits: np.ndarray, ids: WordIds):
        self.bits, self.ids = bits, ids

    def __missing__(self, word: str) -> bool:
        if len(self) > 1 << 18:
            self.clear()
        out = self[word] = bool(held(self.bits, slot_of(np.array([self.ids[word]], np.uint64), WORD_BITS))[0])
        return out


def searcher(shared):
    """doc_id, text -> doc_id, passage: windows of the documents whose sketch an item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, vocabulary, sizes = shared.value
        ids = WordIds()
        known = Known(vocabulary, ids).__getitem__
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, len(docs), 512):
                lists, owner = [], []
                for i, text in enumerate(texts.slice(at, 512).to_pylist()):
                    for words in readings(text, known):
                        lists.append(words)
                        owner.append(at + i)
                found = sorted({(owner[t], passage) for t, passage in candidates(lists, ids, sketches, sizes)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(docs[[p for p, _ in found]]), pa.array([w for _, w in found], pa.string())], ["doc_id", "passage"])

    return run


def candidates(lists: list[list[str]], ids: WordIds, sketches: np.ndarray, sizes: dict[int, list[int]]) -> Iterable[tuple[int, str]]:
    """(place of the text, passage) of every window whose sketch is in the bitmap, in all sizes of its partition."""
    words = Words(lists, ids)
    total = len(words.ids)
    for b, lengths in sizes.items():
        least = sketch(words.ids, b)
        if not len(least):
            continue
        hits = np.flatnonzero(held(sketches, slot_of(least, SKETCH_BITS)) & whole(words.starts, total, b))
        texts = np.searchsorted(words.starts, hits, side="right") - 1
        for place, text in zip(hits.tolist(), texts.tolist()):
            start = place - int(words.starts[text])
            for size in lengths:
                if start + size <= len(lists[text]):
                    yield text, " ".join(lists[text][start : start + size])


def containment(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents: doc_id BIGINT, text STRING; items: item_id BIGINT, prompt STRING.

    Returns doc_id, item_id, passage: the passages of each item that each document holds; a passage may come twice.
    """
    spark = documents.sparkSession
    ship(spark)
    items = items.where("item_id is not null and prompt is not null").select("item_id", "prompt").distinct()
    wanted = materialize(items.mapInArrow(passages, "item_id bigint, passage string, size int, sketch bigint, words array<bigint>"), "p2-passages")
    sizes: dict[int, list[int]] = {}
    for (size,) in wanted.select("size").distinct().collect():  # at most 13 numbers
        sizes.setdefault(bound(size), []).append(size)
    sketches = bitmap(wanted.select(F.col("sketch").alias("slot")), SKETCH_BITS)
    vocabulary = bitmap(wanted.select(F.explode("words").alias("slot")), WORD_BITS)
    shared = spark.sparkContext.broadcast((sketches, vocabulary, sizes))
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = texts.mapInArrow(searcher(shared), "doc_id bigint, passage string")
    return found.join(wanted.select("item_id", "passage").distinct(), "passage").select("doc_id", "item_id", "passage")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = containment(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "heldout_examples", "item_id", "prompt"))
    return hits.select("doc_id", "item_id").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every item that leaked: suite, family, the number of documents and of sources that hold it, and the most passages of it that one document holds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    items = table(spark, sf_dir, "heldout_examples", "item_id", "suite", "family", "prompt")
    hits = containment(docs.select("doc_id", "text"), items.select("item_id", "prompt")).groupBy("doc_id", "item_id").agg(F.countDistinct("passage").alias("held"))
    hits = hits.join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.max("held").alias("most_passages"))
    return items.drop("prompt").join(hits, "item_id")
