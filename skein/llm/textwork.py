"""Words and shingles of many texts at once, as numpy arrays; used inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")

U = np.uint64
#: Odd multipliers of the hashes (fixed values).
MULTIPLY = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * STEP
    x = x ^ (x >> U(29))
    x = x * MULTIPLY
    return x ^ (x >> U(32))


class WordIds(dict):
    """word -> 64-bit hash, kept for as long as the worker lives and emptied at a bounded size."""

    LIMIT = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Words:
    """The words of many texts, one after another, with the place where each text begins."""

    def __init__(self, lists: list[list[str]], ids: WordIds):
        self.lists = lists
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.concatenate([ids.array(w) for w in lists]) if lists else np.zeros(0, np.uint64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lists)), self.sizes)


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids from every place on; the last k - 1 places have none."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * STEP + ids[i : i + n]
    return mix(out)


def whole(starts: np.ndarray, total: int, k: int) -> np.ndarray:
    """Which of the first total - k + 1 places begin k words of one text."""
    n = max(0, total - k + 1)
    keep = np.ones(n, bool)
    for end in starts[1:-1]:
        keep[max(0, end - k + 1) : end] = False
    return keep


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the width values from every place on."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:])[:n] if rest else out[:n]


def plain_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def folded_form(text: str) -> str:
    """Compatibility forms of characters replaced, case folded."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold()


def held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set in a bitmap."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
