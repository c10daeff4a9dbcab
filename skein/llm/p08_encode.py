"""Problem 8: the token ids of every document by a public byte-level BPE tokenizer.

In every partition

* texts are cut into pieces by the tokenizer's pattern, as operations on arrays of code points;
* each distinct piece is a *word* of token-position rows (word, pos, token), at first one row a byte;
* a recursive DuckDB query joins the rows with the merge table and contracts each word's leftmost pair
  of least rank, until no pair of the word is in the table; an aggregation ordered by position gives the
  word's ids.  The other places of the same pair follow in the same turn, from the left: as every merge of a
  token ranks behind the one that made it, which is checked when the table is read, they would be the next ones anyway;
* the ids of the words are put together by document.

The query keeps one row for each byte of its words, whatever the number of turns, so its memory is bounded by
QUERY_BYTES, or by the longest word.  A word that is itself a token is not contracted: the merges of every token of
this table lead to it, which a test holds for all of them.  Words are encoded once per worker and known again by
two hashes of 64 bits; the memory that holds them is emptied at a bounded size.

Defined cases: null and empty texts have the empty list of ids; strings of special tokens are ordinary
text; repeated rows give repeated rows; a null doc_id is kept.
"""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.tables import table
from skein.llm.textwork import U, mix
from skein.session import ship

#: Where the public vocabulary files lie, on every machine.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
#: Bytes of words in one recursive query, and words held by a worker.
QUERY_BYTES, HELD = 1 << 19, 1 << 20
#: Memory of a query; a word of more than QUERY_BYTES gets as much more as it is longer.
MEMORY_MB = 400
#: Characters that are cut at once.
CUT = 1 << 20
#: Characters whose new words are contracted together.
TOGETHER = 1 << 24

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
#: White space of the pattern (fixed values).
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a contraction (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
EDGE_CHAR = 0x110000


class Classes:
    """Class of every code point, by blocks of 256 that are filled when they are first met."""

    def __init__(self) -> None:
        self.of = np.full(EDGE_CHAR + 256, OTHER, np.uint8)
        self.known = np.zeros((EDGE_CHAR >> 8) + 1, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        for block in np.flatnonzero(np.bincount(points >> 8, minlength=len(self.known))[: len(self.known)].astype(bool) & ~self.known):
            for c in range(block << 8, min(EDGE_CHAR, (block + 1) << 8)):
                kind = unicodedata.category(chr(c))[0]
                self.of[c] = SPACE if c in SPACES else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
            self.known[block] = True
        self.of[EDGE_CHAR] = EDGE
        return self.of[points]


def piece_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places where the pieces begin; every text is followed by EDGE_CHAR, which is a piece."""
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    before[0], after[-1] = EDGE, EDGE
    blank = np.roll(points, 1) == 0x20
    blank[0] = False
    start = (kind != before) | (kind == EDGE)
    start &= ~(blank & (kind != SPACE) & (kind != EDGE))  # a blank goes with what follows it
    start |= (kind == SPACE) & (after != SPACE) & (after != EDGE)  # the last of several white spaces stands apart
    for at in np.flatnonzero((points == 0x27) & (before != OTHER) & ~blank & (after == LETTER)):
        tail = "".join(map(chr, points[at + 1 : at + 3][kind[at + 1 : at + 3] == LETTER].tolist()))
        for c in CONTRACTIONS:
            if tail.startswith(c):
                start[at + 1] = False
                if kind[at + 1 + len(c)] == LETTER:
                    start[at + 1 + len(c)] = True
                break
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, name: str):
        with open(f"{TOKENIZERS}/{name}.tiktoken", "rb") as f:
            self.id = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(f"{TOKENIZERS}/{name}.json", encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        letters = byte_letters()
        bytes_of = lambda s: bytes(letters[c] for c in s)
        left, right, result = [], [], []
        for pair in merges:
            a, b = map(bytes_of, pair.split(" ") if isinstance(pair, str) else pair)
            left.append(self.id[a])
            right.append(self.id[b])
            result.append(self.id[a + b])
        if len(set(result)) != len(result):
            raise ValueError("a token has two merges, so words that are tokens would have to be contracted")
        made = {c: k for k, c in enumerate(result)}
        if any(max(made.get(a, -1), made.get(b, -1)) >= k for k, (a, b) in enumerate(zip(left, right))):
            raise ValueError("a merge ranks before the one that makes its part, so equal pairs can't be contracted in one turn")
        self.merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(range(len(left)), pa.int32()), "result": pa.array(result, pa.int32())})


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in the file: itself where it is printable, else one from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


CONTRACT = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM bytes
    UNION
    (WITH live AS (
        SELECT word, pos, tok FROM recurring.state WHERE tok IS NOT NULL AND word IN (SELECT word FROM state)),
    ranked AS (
        SELECT word, pos, next_pos, result, rank
        FROM (SELECT word, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos FROM live WINDOW w AS (PARTITION BY word ORDER BY pos))
        JOIN merges ON tok = l AND next_tok = r),
    least AS (SELECT word, min(rank) AS rank FROM ranked GROUP BY word),
    hits AS (SELECT word, pos, next_pos, result FROM ranked JOIN least USING (word, rank)),
    chained AS (
        SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos) AS chain
        FROM (SELECT *, (lag(next_pos) OVER (PARTITION BY word ORDER BY pos) IS DISTINCT FROM pos)::INTEGER AS fresh FROM hits)),
    merged AS (
        SELECT word, pos, next_pos, result FROM chained
        QUALIFY row_number() OVER (PARTITION BY word, chain ORDER BY pos) % 2 = 1)
    SELECT unnest([word, word]) AS word, unnest([pos, next_pos]) AS pos, unnest([result, NULL]) AS tok FROM merged)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE tok IS NOT NULL GROUP BY word ORDER BY word
"""


@dataclass
class Cut:
    texts: int
    owner: np.ndarray  # the text of each word
    unique: np.ndarray
    again: np.ndarray
    inverse: np.ndarray
    known: np.ndarray
    words: list[bytes]
    apart: bool


class Encoder:
    """Encodes texts; keeps the words it met."""

    def __init__(self, name: str):
        self.vocabulary = Vocabulary(name)
        self.classes = Classes()
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self.db.register("merges_in", self.vocabulary.merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.byte_ids = np.array([self.vocabulary.id[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.again, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.  Words of like length share a query, as the longest of a query decides its number of turns."""
        out: list[list[int]] = [[]] * len(words)
        block: list[int] = []
        size = most = 0
        for k in sorted(range(len(words)), key=lambda k: len(words[k])):
            if block and (size + len(words[k]) > QUERY_BYTES or len(words[k]) > most):
                self.query(words, block, size, out)
                block, size = [], 0
            if not block:
                most = max(16, 2 * len(words[k]))
            block.append(k)
            size += len(words[k])
        if block:
            self.query(words, block, size, out)
        return out

    def query(self, words: list[bytes], block: list[int], size: int, out: list[list[int]]) -> None:
        if size > 2 * QUERY_BYTES:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB * (size // QUERY_BYTES + 1)}MB'")
        sizes = np.array([len(words[k]) for k in block])
        data = np.frombuffer(b"".join(words[k] for k in block), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = pa.table({"word": np.repeat(np.arange(len(block), dtype=np.int32), sizes), "pos": place.astype(np.int32), "tok": self.byte_ids[data]})
        self.db.register("bytes", rows)
        result = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("bytes")
        for k, ids in zip(result["word"].to_pylist(), result["ids"].to_pylist()):
            out[block[k]] = ids

    def tokens_of(self, words: list[bytes]) -> list[list[int]]:
        known = [self.vocabulary.id.get(w) for w in words]
        rest = [k for k, i in enumerate(known) if i is None]
        lists: list[list[int]] = [[i] if i is not None else [] for i in known]
        for k, ids in zip(rest, self.contract([words[k] for k in rest])):
            lists[k] = ids
        return lists

    def learn(self, hashes: np.ndarray, again: np.ndarray, words: list[bytes]) -> None:
        lists = self.tokens_of(words)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in lists for i in ids), np.int32, int(count.sum()))])
        hashes, again, at, count = np.concatenate([self.hashes, hashes]), np.concatenate([self.again, again]), np.concatenate([self.at, at]), np.concatenate([self.count, count])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.again, self.at, self.count = hashes[order], again[order], at[order], count[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def cut(self, texts: list[str], apart: bool = False) -> Cut:
        """The words of all texts, and those that this worker doesn't know yet; ``apart``: all of them."""
        joined = "".join(t + "\0" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = EDGE_CHAR
        kind = self.classes(points)
        starts = piece_starts(points, kind)
        sizes = np.diff(np.append(starts, len(points)))
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        spread = points.astype(np.uint64) * U(0x9E3779B1) + place.astype(np.uint64) * U(0x85EBCA6B27D4EB2F)
        hashes = mix(np.add.reduceat(mix(mix(spread) + U(1)), starts) + sizes.astype(np.uint64))
        again = mix(np.bitwise_xor.reduceat(mix(spread + U(0xC2B2AE3D27D4EB4F)), starts) + sizes.astype(np.uint64))
        edge = points[starts] == EDGE_CHAR
        owner = np.searchsorted(ends, starts)[~edge]
        starts, sizes, hashes, again = starts[~edge], sizes[~edge], hashes[~edge], again[~edge]
        word = lambda k: joined[starts[k] : starts[k] + sizes[k]].encode("utf-8", "replace")
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self.find(unique)
        apart = apart or (again[first][inverse] != again).any() or (self.again[at[known]] != again[first][known]).any()
        wanted = range(len(starts)) if apart else first[~known].tolist()
        return Cut(len(texts), owner.astype(np.int32), unique, again[first], inverse.astype(np.int32), known, [word(k) for k in wanted], apart)

    def learn_all(self, cuts: list[Cut]) -> None:
        """Contract what the cuts don't know, all at once."""
        new: dict[int, tuple[int, bytes]] = {}
        for c in cuts:
            if not c.apart:
                new.update(zip(c.unique[~c.known].tolist(), zip(c.again[~c.known].tolist(), c.words)))
        clash = {h for c in cuts if not c.apart for h, a in zip(c.unique[~c.known].tolist(), c.again[~c.known].tolist()) if new[h][0] != a}
        for c in cuts:
            c.apart = c.apart or bool(clash)
        if new and not clash:
            self.learn(np.fromiter(new, np.uint64, len(new)), np.array([a for a, _ in new.values()], np.uint64), [w for _, w in new.values()])

    def ids_of(self, c: Cut) -> tuple[np.ndarray, np.ndarray]:
        at, _ = self.find(c.unique)
        begin, count = self.at[at][c.inverse], self.count[at][c.inverse]
        ids = self.ids[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        return ids, np.bincount(c.owner, weights=count, minlength=c.texts).astype(np.int64)

    def encode_many(self, runs: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each run of texts the ids of all texts one after another, and the number of ids of each."""
        if len(self.hashes) > HELD:
            self.forget()
        cuts = [self.cut(texts) for texts in runs]
        self.learn_all(cuts)
        return [self.one_by_one(texts) if c.apart else self.ids_of(c) for texts, c in zip(runs, cuts)]

    def one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words with the same first hash as others: every word by itself."""
        c = self.cut(texts, apart=True)
        lists = self.tokens_of(c.words)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(count.sum())), np.bincount(c.owner, weights=count, minlength=c.texts).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_many([texts])[0]


@lru_cache(maxsize=1)
def encoder_of(name: str) -> Encoder:
    """One for each Python worker, which goes on to the next tasks with the words it met."""
    return Encoder(name)


def cuts(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in runs of about CUT characters; null is the empty text."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1]) + 1
        if size >= CUT:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_with(name: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name)
        docs, runs, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for ids, (out, counts) in zip(docs, encoder.encode_many(runs)):
                if lengths_only:
                    column = pa.array(counts)
                else:
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([ids, column], ["doc_id", "n_tokens" if lengths_only else "ids"])

        for batch in batches:
            at = 0
            for texts in cuts(batch.column(1).to_pylist()):
                docs.append(batch.column(0).slice(at, len(texts)))
                runs.append(texts)
                at += len(texts)
                size += sum(map(len, texts))
                if size >= TOGETHER:
                    yield from flush()
                    docs, runs, size = [], [], 0
        yield from flush()

    return run


def encode(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """documents: doc_id BIGINT, text STRING. Returns doc_id, ids ARRAY<INT>."""
    ship(documents.sparkSession)
    return documents.mapInArrow(encode_with(name, False), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, n_tokens BIGINT."""
    ship(documents.sparkSession)
    return documents.mapInArrow(encode_with(name, True), "doc_id bigint, n_tokens bigint")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
