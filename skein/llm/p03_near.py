"""Problem 3: groups of documents that are equal up to small edits.

Documents are sets of three consecutive words (runs of letters and digits, in any case).  Candidates
come from improved consistent weighted sampling (ICWS) over TF-IDF weights, banded, and from a prefix
filter that loses nothing; they are verified exactly.

* Frequencies.  All shingles of all documents are counted in SLOTS counters by 24 bits of their hash.  A counter
  is never below the document frequency df, and above it by mean(shingles a document) / SLOTS of all
  documents on average, about a hundred-thousandth, at every size of the corpus.  The counters, rounded to one
  byte each, are the only broadcast, of fixed size.
* IDF.  A shingle of df documents weighs ln(N / df), at most ln(1 / THETA).
* ICWS.  Each of BANDS * ROWS samples of a document draws, per shingle, r and c from Gamma(2, 1) and
  beta from U(0, 1), sets t = floor(ln w / r + beta), y = exp(r (t - beta)) and a = c / (y exp(r)), and
  keeps the shingle with the least a.  Two documents get the same sample with the probability of their
  weighted Jaccard similarity.  Weights are rounded to powers of sqrt(2) (LEVELS of them), so that ln a is a lookup by
  the weight's level and 16 hashed bits.
* Bands.  ROWS equal samples of a band make a candidate pair.  A document is paired with the NEIGHBOURS next
  ones of its band only: what a crowded band leaves out, the prefixes find.
* Prefixes.  Membership is decided by the share of common shingles, and the weighted similarity can fall
  far below it: where a large group shares its shingles, these weigh little and the edits most.  So pairs
  that share a shingle of their prefixes are candidates as well.  A prefix is the first n - ceil(0.6 n) + 1
  of the n shingles, from rare to frequent by their counters; two documents that match have the first of their
  common shingles in both prefixes, and behind it enough room for the others.  Any order that is the same
  everywhere loses no pair.  Shingles whose counter is 1 stand in one document only and need no partner.
* Hot shingles.  The holders of a shingle with a counter over HOT are dealt to blocks of about HOT, and every
  pair of blocks meets on its own, so no task gets more than two blocks.
* Parities.  Each document has a bitmap of 2 to 4 bits a shingle, in which every shingle flips a bit.  The bits in which
  two documents differ are no more than the shingles in which they differ, so candidates with too many are
  dropped before any set is moved.  In a large collection a shingle has many holders and nearly all of their pairs are
  no match: the holders of a shingle with a counter of SKETCHED and more bring their bitmaps along, and to their bands if
  half of their prefix is of that kind, and such pairs are dropped where they meet and are never written.
* Turns.  Holders meet in turns, each with its share of the keys, so that the rows of a turn take no more than TURN of the
  space of the signatures, at every size of the collection.
* Verification.  Each remaining pair is compared by its whole shingle sets: weighted Jaccard
  similarity (reported) and the share of common shingles, which decides.

Equal shingle sets form one class before any pairing; pairs are made between class representatives
and expanded at the end where a query asks for all pairs of documents.

Defined cases: null ids and texts, and texts of fewer than 20 words, take part in nothing; repeated
rows of a document count once; a class of equal texts is a group even without further neighbours.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import bitmap, expand, table
from skein.llm.textwork import U, WordIds, Words, held, mix, plain_words, shingles, whole
from skein.session import materialize, release, ship

WIDTH = 3
LEAST_WORDS = 20
THETA = 1 / 1000
BANDS, ROWS = 12, 3
#: Documents of a band that one is paired with.
NEIGHBOURS = 32
#: Counters of shingles, in blocks that are summed one by one; 24 bits of a hash choose one.
SLOT_BITS = 24
SLOTS, BLOCK = 1 << SLOT_BITS, 1 << 16
#: Holders of a shingle that meet in one task.
HOT = 20_000
#: Holders of a shingle from which on they bring their parities along.
SKETCHED = 16
#: Bytes of the rows that meet in one turn, at most, as a share of the bytes of the signatures.
TURN = 1.5
#: Bits of the filter of wanted documents.
WANTED_BITS = 24
#: Weights are rounded to powers of sqrt(2): level L stands for 2 ** (L / 2).
LEVELS = 12
LOWEST = -2
THRESHOLD = (3, 5)  # share of common shingles, as a fraction


def sample_tables(samples: int) -> np.ndarray:
    """[level, 16 bits] -> 24 bits that order ln a, with seeded draws; one table serves all samples by other bits."""
    rng = np.random.default_rng(20250101)
    r, ln_c = rng.gamma(2.0, 1.0, 1 << 16), np.log(rng.gamma(2.0, 1.0, 1 << 16))
    beta = rng.uniform(size=1 << 16)
    ln_a = []
    for level in range(LEVELS):
        ln_w = (level + LOWEST) / 2 * np.log(2)
        t = np.floor(ln_w / r + beta)
        ln_a.append(ln_c - r * (t - beta) - r)
    flat = np.array(ln_a)
    # ranks keep order and equality exactly: two levels with the same t have the same ln a
    values, rank = np.unique(np.round(flat, 9), return_inverse=True)
    return (rank.reshape(flat.shape).astype(np.uint64) << U(40)).astype(np.uint64)


def level_of(weight: np.ndarray) -> np.ndarray:
    return np.clip(np.round(2 * np.log2(np.maximum(weight, 1e-9))).astype(np.int64) - LOWEST, 0, LEVELS - 1)


def distinct(texts: list[str | None], ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text once with their counts, sorted by text; texts that are too short have none."""
    lists = [plain_words(t) if t else [] for t in texts]
    lists = [w if len(w) >= LEAST_WORDS else [] for w in lists]
    words = Words(lists, ids)
    hashed = shingles(words.ids, WIDTH)
    keep = whole(words.starts, len(words.ids), WIDTH)
    owner = words.owners()[: len(hashed)][keep]
    hashed = hashed[keep]
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashed[first], np.diff(np.append(first, len(hashed)))


def pieces(batch: pa.RecordBatch, size: int = 1024) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    docs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    for at in range(0, len(docs), size):
        yield docs[at : at + size], texts.slice(at, size).to_pylist()


def slots_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> U(64 - SLOT_BITS)).astype(np.int64)


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, counts: how many shingles of documents fell into each counter; block -1: the number of documents."""
    ids, docs = WordIds(), 0
    counters = np.zeros(SLOTS, np.int32)
    for batch in batches:
        for part, texts in pieces(batch):
            _, hashed, _ = distinct(texts, ids)
            np.add.at(counters, slots_of(hashed), 1)
            docs += len(part)
    blocks, packed = [-1], [np.array([docs], np.int64).tobytes()]
    for k in range(SLOTS // BLOCK):
        block = counters[k * BLOCK : (k + 1) * BLOCK]
        if block.any():
            blocks.append(k)
            packed.append(pack_counts(block))
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each count below 255, the others behind them."""
    high = np.flatnonzero(counts >= 255)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + np.concatenate([high, counts[high]]).astype(np.int64).tobytes(), 4)


def unpack_counts(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    counts = np.frombuffer(data, np.uint8, BLOCK).astype(np.int64)
    high, values = np.frombuffer(data, np.int64, offset=BLOCK).reshape(2, -1)
    counts[high] = values
    return counts


def sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each block; a task holds one array per block it got, however many parts there are."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            more = np.frombuffer(counts, np.int64) if block < 0 else unpack_counts(counts)
            held[block] = held[block] + more if block in held else more
    for block, counts in held.items():
        data = counts.tobytes() if block < 0 else zlib.compress(rounded(counts).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "counts"])


def rounded(counts: np.ndarray) -> np.ndarray:
    """One byte for a count: exact below 16, in eighths of a power of two from there on."""
    high = 16 + np.floor(8 * np.log2(np.maximum(counts, 16) / 16))
    return np.where(counts < 16, counts, np.minimum(high, 255)).astype(np.uint8)


#: The counts that the bytes stand for.
MEANT = np.where(np.arange(256) < 16, np.arange(256), 16 * 2 ** ((np.arange(256) - 15.5) / 8))


def frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """The rounded counters of all shingles, and the number of documents."""
    parts = documents.mapInArrow(count_slots, "block int, counts binary")
    sums = parts.repartition("block").mapInArrow(sum_slots, "block int, counts binary").toArrow()
    counters, total = np.zeros(SLOTS, np.uint8), 0
    for block, counts in zip(sums["block"].to_pylist(), sums["counts"].to_pylist()):
        if block < 0:
            total = int(np.frombuffer(counts, np.int64)[0])
        else:
            counters[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(counts), np.uint8)
    return counters, total


def prefixes(owner: np.ndarray, hashed: np.ndarray, often: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Of each text the shingles one of which any match must share, from rare to frequent, without those that no other text can hold; and how many these are."""
    up, down = THRESHOLD
    order = np.lexsort((hashed, owner.astype(np.uint64) << U(8) | often))
    lengths = sizes - -(-up * sizes // down) + 1
    first = np.arange(len(hashed)) - np.repeat(starts, sizes) < np.repeat(lengths, sizes)
    lonely = first & (often[order] <= 1)
    skipped = np.add.reduceat(lonely.astype(np.int64), starts)
    offsets = np.append(0, np.cumsum(lengths - skipped)).astype(np.int32)
    return skipped, pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[order][first & ~lonely].view(np.int64)))


def parities(owner: np.ndarray, hashed: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap of each text with 2 to 4 bits a shingle, of which every shingle flips one."""
    bits = np.maximum(64, 2 ** np.ceil(np.log2(2 * sizes)).astype(np.int64))
    at = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(at[row] + (hashed & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a : a + n] for a, n in zip((at // 8).tolist(), (bits // 8).tolist())]


def weigh(hashed: np.ndarray, counts: np.ndarray, heavy: tuple[np.ndarray, int]) -> np.ndarray:
    """TF-IDF weights: (1 + ln tf) * ln(N / df)."""
    counters, total = heavy
    idf = np.log(np.maximum(total, 2) / np.maximum(1, MEANT[counters[slots_of(hashed)]]))
    return (1 + np.log(counts)) * np.clip(idf, 0.05, -np.log(THETA))


SIGNED = ["doc_id", "key_a", "key_b", "bands", "size", "skipped", "prefix", "bits", "posted"]


def common(holders: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """Of which texts half of the prefix has SKETCHED holders and more."""
    return 2 * np.bincount(row, holders >= SKETCHED, count) >= np.maximum(1, np.bincount(row, minlength=count))


def posted(prefix: pa.ListArray, bits: np.ndarray, counters: np.ndarray, hot: int) -> np.ndarray:
    """Bytes of the postings of each text, of which key, document and place take 16 when compressed; bits: the bytes of its parities."""
    holders = MEANT[counters[slots_of(prefix.flatten().to_numpy().view(np.uint64))]]
    row = np.repeat(np.arange(len(bits)), np.diff(prefix.offsets.to_numpy()))
    each = np.maximum(1, np.ceil(holders / hot)) * (16 + np.where(holders >= SKETCHED, bits[row], 0))
    return (BANDS * (16 + np.where(common(holders, row, len(bits)), bits, 0)) + np.bincount(row, each, len(bits))).astype(np.int64)


def signer(heavy, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = WordIds(), sample_tables(BANDS * ROWS)
        low40 = U((1 << 40) - 1)
        odd = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | U(1)
        flat_table = tables.ravel()
        for batch in batches:
            for docs, texts in pieces(batch):
                owner, hashed, counts = distinct(texts, ids)
                if not len(hashed):
                    continue
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                base = level_of(weigh(hashed, counts, heavy.value)).astype(np.uint64) << U(16)
                element = hashed & low40
                bands = np.zeros((len(starts), BANDS), np.uint64)
                for s in range(BANDS * ROWS):
                    value = flat_table[base | ((hashed * odd[s]) >> U(48))] | element
                    bands[:, s // ROWS] = bands[:, s // ROWS] * STEP_BAND + np.minimum.reduceat(value, starts)
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                # the class: sum and xor of the mixed shingles, with their number
                one, two = mix(hashed), mix(hashed ^ STEP_BAND)
                sizes = np.diff(np.append(starts, len(hashed)))
                key_a = np.add.reduceat(one, starts) + sizes.astype(np.uint64)
                key_b = np.bitwise_xor.reduceat(two, starts)
                flat = pa.array(bands.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), flat)
                skipped, prefix = prefixes(owner, hashed, heavy.value[0][slots_of(hashed)], starts, sizes)
                bits = parities(owner, hashed, sizes)
                cost = posted(prefix, np.fromiter(map(len, bits), np.int64, len(bits)), heavy.value[0], hot)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[owner[starts]]), pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)), lists, pa.array(sizes, pa.int32()), pa.array(skipped, pa.int32()), prefix, pa.array(bits, pa.binary()), pa.array(cost)],
                    SIGNED,
                )

    return run


STEP_BAND = U(0xA0761D6478BD642F)


def outside(slots):
    """The rows whose slot (the last column) isn't among ``slots``, or with ``inside`` those whose slot is."""

    def run(inside: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(held(slots.value, batch.column(batch.num_columns - 1).to_numpy()) == inside))

        return pick

    return run


def postings(heavy, hot: int, turns: int, turn: int):
    """key, d, place, bits of the keys of a turn: the bands of each document (place -1 - size) and its prefix (size and place in one number); hot shingles once for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                yield of(batch.slice(start, 2048))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, size, skipped = (batch.column(k).to_numpy() for k in ("d", "size", "skipped"))
        band = batch.column("bands").flatten().to_numpy()
        lists = batch.column("prefix")
        token, many = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(doc)), many)
        at = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + skipped[row]
        holders = MEANT[heavy.value[0][slots_of(token.view(np.uint64))]]
        banded = np.flatnonzero(band.view(np.uint64) % U(turns) == U(turn))
        band_bits = common(holders, row, len(doc))[banded // BANDS]
        now = token.view(np.uint64) % U(turns) == U(turn)
        token, row, at, holders = token[now], row[now], at[now], holders[now]
        cold = holders <= hot
        keys, owners, places, with_bits = [token[cold]], [row[cold]], [at[cold]], [holders[cold] >= SKETCHED]
        for k in np.flatnonzero(~cold).tolist():
            blocks = int(-(-holders[k] // hot))
            own = int(mix(np.array([doc[row[k]]]).astype(np.uint64))[0]) % blocks
            other = np.arange(blocks, dtype=np.uint64)
            low, high = np.minimum(other, U(own)), np.maximum(other, U(own))
            keys.append(mix(token[k : k + 1].view(np.uint64) + mix(low * U(blocks) + high + U(1))).view(np.int64))
            owners.append(np.full(blocks, row[k]))
            places.append(np.full(blocks, at[k]))
            with_bits.append(np.full(blocks, holders[k] >= SKETCHED))
        owner = np.concatenate([banded // BANDS, *owners])
        spots = np.concatenate([-1 - size[banded // BANDS].astype(np.int64), size[owner[len(banded) :]].astype(np.int64) << 32 | np.concatenate(places)])
        bits = batch.column("bits").take(pa.array(owner, mask=~np.concatenate([band_bits, *with_bits])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([band[banded], *keys])), pa.array(doc[owner]), pa.array(spots), bits], ["key", "d", "place", "bits"])

    return run


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, d, place, bits (or none) in order of key and place -> a, b: the pairs of each key that can match by length, position and parities."""
    held = [np.zeros(0, np.int64)] * 3
    bits = pa.array([], pa.binary())
    fresh = 0  # the held rows before this place have met each other
    for batch in batches:
        rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        bits = pa.concat_arrays([bits, batch.column(3) if batch.num_columns > 3 else pa.nulls(batch.num_rows, pa.binary())])
        key, _, spot = rows
        if not len(key):
            continue
        yield from meet(rows, bits, fresh)
        # rows of the last key wait for more of it: of a band the neighbours, of a shingle all
        last = int(np.searchsorted(key, key[-1]))
        if spot[-1] < 0:
            last = max(last, len(key) - NEIGHBOURS)
        held, bits = [r[last:] for r in rows], bits.slice(last)
        fresh = len(held[0])


def meet(rows: list[np.ndarray], bits: pa.BinaryArray, fresh: int) -> Iterator[pa.RecordBatch]:
    up, down = THRESHOLD
    key, d, spot = rows
    size, at = spot >> 32, spot & 0xFFFFFFFF  # of bands the size is -1
    match = matcher(bits, np.where(spot < 0, -1 - spot, size))
    n = len(key)
    place = np.arange(n)
    new = np.append(True, (key[1:] != key[:-1]) | ((size[1:] < 0) != (size[:-1] < 0)))
    run = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)[run]
    # in order of size the partners behind a row are those up to the longest that its room and length allow
    longest = np.minimum(down * size // up, (up + down) * (size - at) // up - size)
    until = np.searchsorted((run << 32) + np.maximum(size, 0), (run << 32) + np.maximum(longest, 0), side="right")
    until = np.where(size < 0, np.minimum(ends, place + 1 + NEIGHBOURS), np.minimum(until, ends))
    since = np.maximum(place + 1, fresh)
    many = np.maximum(0, until - since)
    done = np.append(0, np.cumsum(many))
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(done, done[begin] + (1 << 20), side="right")) - 1)
        left = np.repeat(place[begin:end], many[begin:end])
        right = np.arange(len(left)) - np.repeat(done[begin:end] - done[begin], many[begin:end]) + since[left]
        fits = (size[left] < 0) | ((up + down) * (size[right] - at[right]) >= up * (size[left] + size[right]))
        left, right = left[fits], right[fits]
        alike = match(left, right) & (d[left] != d[right])
        left, right = d[left[alike]], d[right[alike]]
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])
        begin = end


def matcher(bits: pa.BinaryArray, size: np.ndarray):
    """Tells of pairs of rows whether their parities differ in no more bits than a match allows; rows without parities match all."""
    up, down = THRESHOLD
    data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
    data = data[: len(data) // 8 * 8].view(np.uint64)
    at = np.frombuffer(bits.buffers()[1] or bytes(4), np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64) // 8
    words = np.diff(at)

    def of(row: np.ndarray, count: int, wanted: int) -> np.ndarray:
        x = data[at[row][:, None] + np.arange(count)]
        while x.shape[1] > wanted:  # in halves
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    def match(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keep = np.ones(len(left), bool)
        kind = words[left] << 32 | words[right]
        for k in np.unique(kind).tolist():
            one, two = k >> 32, k & 0xFFFFFFFF
            if not (one and two):
                continue
            rows, step, wanted = np.flatnonzero(kind == k), max(1, (1 << 19) // max(one, two)), min(one, two)
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                x, y = left[some], right[some]
                differ = np.bitwise_count(of(x, one, wanted) ^ of(y, two, wanted)).sum(axis=1, dtype=np.int64)
                keep[some] = (up + down) * differ <= (down - up) * (size[x] + size[y])
        return keep

    return match


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, m, x, n, y (sizes and parities) -> the pairs whose parities differ in no more bits than a match allows."""
    up, down = THRESHOLD
    for batch in batches:
        keep = []
        for i, (m, x, n, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)))):
            if len(x) < len(y):
                x, y = y, x
            one, two, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
            while bits > 8 * len(y):  # the longer one in halves
                bits //= 2
                one = (one >> bits) ^ (one & ((1 << bits) - 1))
            if (up + down) * (one ^ two).bit_count() <= (down - up) * (m + n):
                keep.append(i)
        if keep:
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])


def wanted_slot() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("p3"), "doc_id"), 64 - WANTED_BITS)


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """Which slots hold a wanted doc_id."""
    return bitmap(wanted.select(wanted_slot().alias("slot")), WANTED_BITS)


def shingle_sets(wanted):
    """doc_id, text, slot -> doc_id, sh (hashes), tf (how often each occurs) of the whole texts in wanted slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            batch = batch.filter(pa.array(held(wanted.value, batch.column(2).to_numpy())))
            for docs, texts in pieces(batch, 256):
                owner, hashed, counts = distinct(texts, ids)
                if not len(hashed):
                    continue
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                offsets = pa.array(np.append(starts, len(hashed)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[owner[starts]]),
                        pa.ListArray.from_arrays(offsets, pa.array(hashed.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                    ],
                    ["doc_id", "sh", "tf"],
                )

    return run


def verify(heavy):
    """a, b, x, s, y, t -> a, b, common share and weighted Jaccard similarity of the pairs that reach the threshold."""
    up, down = THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shares, weighted = [], [], []
            lists = []
            for k in range(2, 6):
                column = batch.column(k)
                lists.append((column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()))
            for i in range(batch.num_rows):
                x, s, y, t = (values[at[i] : at[i + 1]] for values, at in lists)
                _, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                common, union = len(at_x), len(x) + len(y) - len(at_x)
                if common * down >= up * union:
                    u, v = weigh(x.view(np.uint64), s, heavy.value), weigh(y.view(np.uint64), t, heavy.value)
                    least = float(np.minimum(u[at_x], v[at_y]).sum())
                    keep.append(i)
                    shares.append(common / union)
                    weighted.append(least / (float(u.sum()) + float(v.sum()) - least))
            if keep:
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(shares), pa.array(weighted)], ["a", "b", "share", "weighted"])

    return run


def members_of(signed: DataFrame) -> DataFrame:
    """doc_id, rep (least doc_id with the same shingle set), n (the class's size)."""
    keys = signed.select("doc_id", "key_a", "key_b").distinct()
    classes = keys.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return keys.join(classes, ["key_a", "key_b"]).select("doc_id", "rep", "n")


def turns_of(signed: DataFrame) -> int:
    """In how many turns the holders of keys meet."""
    stored = F.octet_length("bits") + 8 * F.size("prefix") + 8 * BANDS + 40
    needed, held = signed.agg(F.sum("posted"), F.sum(stored)).first()
    return max(1, math.ceil((needed or 0) / (TURN * (held or 1))))


def originals(signed: DataFrame, members: DataFrame) -> DataFrame:
    """The rows that take part in pairing: no copies. What isn't in a slot of a copy is no copy, and only the others are looked up."""
    slots = signed.sparkSession.sparkContext.broadcast(wanted_filter(members.where("doc_id <> rep").select("doc_id")))
    parts = signed.select("doc_id", "size", "skipped", "bands", "prefix", "bits").withColumn("slot", wanted_slot())
    pick = outside(slots)
    sure = parts.mapInArrow(pick(False), parts.schema)
    rest = parts.mapInArrow(pick(True), parts.schema).join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    return sure.unionByName(rest).drop("slot").withColumnRenamed("doc_id", "d")


def candidates(kept: DataFrame, posted) -> DataFrame:
    """a, b: the pairs that meet in a turn."""
    rows = kept.mapInArrow(posted, "key bigint, d bigint, place bigint, bits binary")
    return rows.repartition("key").sortWithinPartitions("key", "place").mapInArrow(meetings, "a bigint, b bigint").distinct()


def near_classes(documents: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """documents: doc_id BIGINT, text STRING.

    Returns members (doc_id, rep: least doc_id with the same shingle set, n: the class's size) and links (a, b: representatives
    with a < b, share, weighted) of all classes that match.
    """
    spark = documents.sparkSession
    ship(spark)
    documents = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    heavy = spark.sparkContext.broadcast(frequencies(documents))
    signed = documents.mapInArrow(signer(heavy, hot), "doc_id bigint, key_a bigint, key_b bigint, bands array<bigint>, size int, skipped int, prefix array<bigint>, bits binary, posted bigint")
    signed = materialize(signed, "p3-signed")
    members = materialize(members_of(signed), "p3-members")
    release(spark)
    turns = turns_of(signed)
    kept = materialize(originals(signed, members), "p3-kept")
    release(spark, signed)
    met = []
    for turn in range(turns):
        met.append(materialize(candidates(kept, postings(heavy, hot, turns, turn)), "p3-pairs"))
        release(spark)
    pairs = reduce(DataFrame.union, met)
    if turns > 1:
        pairs = pairs.distinct()
    bits = kept.select("d", "size", "bits")
    both = pairs.join(bits.toDF("a", "m", "x"), "a").join(bits.toDF("b", "n", "y"), "b").select("a", "b", "m", "x", "n", "y")
    near = materialize(both.mapInArrow(close, "a bigint, b bigint").distinct(), "p3-close")
    del both, pairs
    release(spark, kept, *met)

    wanted = spark.sparkContext.broadcast(wanted_filter(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    sets = documents.withColumn("slot", wanted_slot()).mapInArrow(shingle_sets(wanted), "doc_id bigint, sh array<bigint>, tf array<int>")
    sets = materialize(sets, "p3-sets").dropDuplicates(["doc_id"])
    joined = near.join(sets.toDF("a", "x", "s"), "a").join(sets.toDF("b", "y", "t"), "b").select("a", "b", "x", "s", "y", "t")
    return members, joined.mapInArrow(verify(heavy), "a bigint, b bigint, share double, weighted double")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    copies = members.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    members = members.select("rep", "doc_id")
    both = expand(links.select("a", "b").unionByName(copies), members.toDF("a", "x"), members.toDF("b", "y")).where("a <> b or x < y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where("doc_id_a <> doc_id_b").distinct()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of 20 words and more.

    doc_id, class_id (least id with the same shingles), n_copies (documents of the class), n_links (other classes with 0.6 of
    the shingles in common), n_weighted (those of them whose weighted Jaccard similarity reaches 0.6 as well) and closest
    (the greatest weighted similarity to a linked class, null without a link).
    """
    members, links = near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    up, down = THRESHOLD
    degree = links.select(F.explode(F.array("a", "b")).alias("rep"), "weighted").groupBy("rep").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("weighted") * down >= up).alias("n_weighted"), F.max("weighted").alias("closest")
    )
    out = members.join(degree, "rep", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), count("n_links"), count("n_weighted"), F.round("closest", 6).alias("closest"))
