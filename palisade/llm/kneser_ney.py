"""Operator 5: quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over words, three words long. N-grams are dealt to shards by their middle word, so that a shard knows all
that a word's probability needs: how often a, b, c stand together and what else follows a, b; before how many words b, c
stands and what else follows b. Only continuation counts of single words come from the whole corpus. What very frequent
words stand amid is dealt to several shards by the word before; what follows such a word is in each of them.

Words travel as blocks: codes of frequent words by rank, other words by 63 bits of their hash, in compressed columns. Of
the texts to be rated those words are asked for whose middle word the model holds, PASSES times another part of the shards,
so that what lies on disk at once stays small; a word that the model doesn't hold is told from others by a bitmap of fixed
size. A shard answers with sums of each text's log probabilities.

Trusted texts are dealt into two halves by a hash of their id. The model is fitted on all of one half; the
thresholds are quantiles of the other, which the model has not seen.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, columns, discarded, likely, mixed, most_frequent, slices, stored
from .hashing import SPACE, STEP, Table, hashed_words

ORDER = 3
#: Words in the broadcast table: its bound.
TABLE = 1 << 17
#: Bits of the bitmap of the other words, as a power of two: 16 MB.
MARK_BITS = 27
#: In place of words: one that the model doesn't hold, what stands before a text's first word, a text's end.
UNKNOWN, BEGIN, END = 1, 2, 3
#: A text is rejected beyond this quantile of its language's held-out trusted texts.
QUANTILE = 0.99
#: Parts of the shards that are asked one after another; shards at least; positions that a task deals out at a time; and
#: how often a word stands in trusted texts for each shard that it is dealt to.
PASSES, SHARDS, CHUNK, HEAVY = 4, 24, 1 << 20, 1 << 20
_CODEC = pa.Codec("zstd", compression_level=1)
_BLOCK = "m int, shard int, of int, start long, data binary"
_COUNTED = "m int, shard int, first boolean, n1 long, n2 long, n3 long, n4 long, data binary"


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers that are not negative, each in as few bytes as its largest takes, compressed byte by byte."""
    made = []
    for x in arrays:
        size = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
        own = np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()
        own = _CODEC.compress(own, asbytes=True) if own else own
        made += [struct.pack("<IBI", len(x), size, len(own)), own]
    return b"".join(made)


def _unpacked(data: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(data):
        n, size, k = struct.unpack_from("<IBI", data, at)
        x = np.zeros((n, 8), np.uint8)
        if n:
            x[:, :size] = np.frombuffer(_CODEC.decompress(data[at + 9 : at + 9 + k], n * size, asbytes=True), np.uint8).reshape(size, n).T
        found.append(x.view("<i8").ravel())
        at += 9 + k
    return found


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """A 63-bit number for n-grams given by their words, the last first."""
    key = mixed(words[0].astype(np.uint64))
    for w in words[1:]:
        key = mixed(key * STEP + w.astype(np.uint64))
    return (key >> np.uint64(1)).astype(np.int64)


class Known:
    """The most frequent words, by rank: codes, and how many shards each is dealt to. Then also before how many words
    each stands (its continuation count)."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, shards: int):
        order = np.lexsort((ids, -n))
        order = order[ids[order] > END]
        self.ids = np.concatenate([[UNKNOWN, BEGIN, END], ids[order]]).astype(np.int64)
        self.spread = np.minimum(np.concatenate([[1, 1, 1], -(-n[order] // HEAVY)]), shards).astype(np.uint64)
        self.table = Table(self.ids, np.arange(len(self.ids), dtype=np.int32), -1)
        self.shards, self.before = shards, np.zeros(len(self.ids), np.int64)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of words, -1 for those beyond the table."""
        return self.table.get(words).astype(np.int64)

    def homes(self, words: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shard of each word, and how many there are from it on."""
        return (mixed(words.astype(np.uint64)) >> np.uint64(40)) % np.uint64(self.shards), np.where(codes < 0, np.uint64(1), self.spread[codes])

    def block(self, words: list[np.ndarray], codes: list[np.ndarray], *more: np.ndarray) -> bytes:
        """Columns of words, and further ones."""
        codes = np.stack(codes)
        rare = codes < 0
        others, at = np.unique(np.stack(words)[rare], return_inverse=True)
        codes[rare] = len(self.ids) + at
        return _packed(np.diff(others, prepend=0), *codes, *more)

    def words(self, block: bytes, n: int) -> list[np.ndarray]:
        """Its columns, n of them words."""
        others, *found = _unpacked(block)
        ids = np.concatenate([self.ids, np.cumsum(others)])
        return [*(ids[x] for x in found[:n]), *found[n:]]


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts with what stands before and after them in one array, the places of words and ends in it, and how
    many each text has."""
    before, end = np.full(ORDER - 1, BEGIN, np.int64), np.array([END])
    data = np.concatenate([x for own in texts for x in (before, own, end)])
    counts = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    starts = np.cumsum(counts + ORDER - 1) - counts - (ORDER - 1)
    keep = np.ones(len(data), bool)
    for j in range(ORDER - 1):
        keep[starts + j] = False
    return data, np.flatnonzero(keep), counts


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number, and where words begin."""
    words, starts, _ = hashed_words(raw)
    return np.maximum(words, END + 1), starts


def _words(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text, of long ones a part at a time."""
    short = [x if len(x) <= SLICE else b"" for x in texts]
    words, starts = _hashed(b" ".join(short))
    ends = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)) + 1)
    found = np.split(words, np.searchsorted(starts, ends[:-1]))
    for i, x in enumerate(texts):
        if len(x) > SLICE:
            own, at = [], 0
            while at < len(x):
                cut = SPACE.search(x, at + SLICE)
                end = cut.start() if cut else len(x)
                own.append(_hashed(x[at:end])[0])
                at = end
            found[i] = np.concatenate(own)
    return found


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], int]]:
    """Words of a task's texts, some CHUNK at a time, the first one's place among all, and a sum of all texts so far."""
    held, size, start, mark = [], 0, 0, 0
    for batch in parts:
        for texts in slices(batch.column("text")):
            for x in texts:
                mark = zlib.crc32(x, mark)
            held += _words(texts)
            size += sum(len(x) + 1 for x in held[len(held) - len(texts) :])
            if size >= CHUNK:
                yield start, held, mark
                start, held, size = start + len(held), [], 0
    if held:
        yield start, held, mark


def _cut(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard's places in an array, in their order."""
    order = np.argsort(shard.astype(np.uint32 if len(shard) and shard.max() >> np.uint64(16) else np.uint16), kind="stable")
    own = shard[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    for lo, hi in zip(starts, [*starts[1:], len(own)]):
        yield int(own[lo]), order[lo:hi]


def _rows(schema: str, **values) -> pa.RecordBatch:
    """One row; columns that are not named are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    of = dict(x.split() for x in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([values.get(k)], kinds[t]) for k, t in of.items()], list(of))


def _few(n: np.ndarray) -> dict[str, int]:
    """How many counts are one, two, three and four."""
    of = np.bincount(np.minimum(n, 5), minlength=6)
    return {f"n{k}": int(of[k]) for k in range(1, 5)}


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_by[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, reduce(np.logical_or, (x[1:] != x[:-1] for x in sorted_by))])


def _joined(blocks: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, np.int64), *(x[k] for x in blocks)]) for k in range(n)]


def _counted(held: list[list[np.ndarray]], by: tuple[int, ...]) -> list[np.ndarray]:
    """Columns of words and a count, sorted by columns (`by`, the first of them first), equal ones summed."""
    *words, n = _joined(held, len(by) + 1)
    order = np.lexsort([words[k] for k in reversed(by)])
    words = [x[order] for x in words]
    starts = _runs(*words)
    return [*(x[starts] for x in words), np.add.reduceat(n[order], starts) if len(starts) else n[:0]]


def _gathered(parts: Iterator[pa.RecordBatch], known: Known, by: tuple[int, ...]) -> tuple[int, list[np.ndarray]]:
    """What a shard's blocks hold: summed again and again, so that equal n-grams are not held many times."""
    shard, held, size = -1, [], 0
    for batch in parts:
        for own, block in zip(batch.column("shard").to_pylist(), batch.column("data")):
            shard = own
            held.append(known.words(block.as_py(), len(by)))
            size += len(held[-1][0])
            if size > 4 * CHUNK and size > 2 * len(held[0][0]):
                held = [_counted(held, by)]
                size = len(held[0][0])
    return shard, _counted(held, by) if held else []


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts, _ in _chunks(parts):
        words, n = np.unique(np.concatenate(texts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])


@dataclass
class Rates:
    """Discounts of each order (of counts of none, one, two, and three or more), the sum of single words' counts, the
    probability of an unknown word, and the logarithm of the end's."""

    discounts: dict[int, np.ndarray]
    total: int
    share: float
    end: float

    def single(self, n: np.ndarray) -> np.ndarray:
        """Probabilities of words by their continuation counts."""
        return np.where(n > 0, (n - self.discounts[1][np.minimum(n, 3)]) / max(1, self.total), 0) + self.share


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of none, one, two, and three or more, from how many counts are 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))])


def _dealt(df: DataFrame, make: Callable, shards: int) -> DataFrame:
    """Blocks that `make` gives, each shard's in one task."""
    return df.mapInArrow(make, _BLOCK).repartitionById(shards, "shard")


def model(texts: DataFrame, table: int = TABLE) -> tuple[DataFrame, Known, Rates]:
    """Of each shard (m, shard, data): continuation counts of its words beyond the table (m = 1), before how many words
    pairs stand (2), how often n-grams of three words come (3); the words in the table; and what all shards need."""
    spark = texts.sparkSession
    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = stored(texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    first = words.where(most_frequent(words, "n", table)).toArrow()  # `table` rows at most
    discarded(words)
    known = Known(first.column("word").to_numpy(), first.column("n").to_numpy(), shards)
    sent = spark.sparkContext.broadcast(known)

    def threes(parts):
        known = sent.value
        for _, texts, _ in _chunks(parts):
            data, at, _ = _laid(texts)
            code = known.codes(data)
            home, spread = known.homes(data, code)
            shard = (home[at - 1] + (mixed(data[at - 2].astype(np.uint64)) >> np.uint64(40)) % spread[at - 1]) % np.uint64(shards)
            for k, own in _cut(shard):
                own = at[own]
                a, b, c, n = _counted([[data[own - 2], data[own - 1], data[own], np.ones(len(own), np.int64)]], (1, 0, 2))
                yield _rows(_BLOCK, shard=k, data=known.block([a, b, c], [known.codes(x) for x in (a, b, c)], n))

    def counted_threes(parts):
        known = sent.value
        shard, found = _gathered(parts, known, (1, 0, 2))
        if found:
            *words, n = found
            yield _rows(_COUNTED, m=3, shard=shard, **_few(n), data=known.block(words, [known.codes(x) for x in words], n))

    trigrams = stored(_dealt(texts, threes, shards).mapInArrow(counted_threes, _COUNTED))

    def twos(parts):
        known = sent.value
        for batch in parts:
            for block in batch.column("data"):
                _, b, c, n = known.words(block.as_py(), 3)
                b, c, n = _counted([[b, c, np.ones_like(n)]], (0, 1))
                home, _ = known.homes(b, known.codes(b))
                for k, own in _cut(home):
                    yield _rows(_BLOCK, shard=k, data=known.block([b[own], c[own]], [known.codes(x[own]) for x in (b, c)], n[own]))

    def counted_twos(parts):
        known = sent.value
        shard, found = _gathered(parts, known, (0, 1))
        if found:
            b, c, n = found
            spread = known.homes(b, known.codes(b))[1].astype(np.int64)
            for k in range(int(spread.max())):
                own = np.flatnonzero(spread > k)
                few = _few(n) if k == 0 else _few(n[:0])
                yield _rows(_COUNTED, m=2, shard=(shard + k) % shards, first=k == 0, **few, data=known.block([b[own], c[own]], [known.codes(x[own]) for x in (b, c)], n[own]))

    bigrams = stored(_dealt(trigrams.select("shard", "data"), twos, shards).mapInArrow(counted_twos, _COUNTED))

    def ones(parts):
        for batch in parts:
            for block in batch.column("data"):
                words, n = np.unique(sent.value.words(block.as_py(), 2)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])

    singles = stored(bigrams.where("first").select("data").mapInArrow(ones, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    few = {m: [x or 0 for x in own.agg(*(F.sum(f"n{k}") for k in range(1, 5))).first()] for m, own in ((2, bigrams), (3, trigrams))}
    of_all = singles.agg(F.sum("n"), F.count("*"), *(F.sum(F.when(F.col("n") == k, 1).otherwise(0)) for k in range(1, 5))).first()
    discounts = {1: _discounts([x or 0 for x in of_all[2:]]), **{m: _discounts(x) for m, x in few.items()}}
    # an unknown word is one of as many as there are, and one more
    saved = sum(discounts[1][k] * (of_all[1 + k] or 0) for k in (1, 2)) + discounts[1][3] * (of_all[1] - (of_all[2] or 0) - (of_all[3] or 0))
    share = (saved / of_all[0] if of_all[0] else 1.0) / (of_all[1] + 1)
    rates = Rates(discounts, of_all[0] or 0, share, 0.0)
    ends = singles.where(F.col("word") == END).first()
    rates.end = math.log(rates.single(np.array([ends["n"] if ends else 0]))[0])
    own = spark.createDataFrame(pa.table({"word": known.ids}))
    got = singles.join(F.broadcast(own), "word").toArrow()  # `table` rows at most
    known.before[known.codes(got.column("word").to_numpy())] = got.column("n").to_numpy()
    known.marks = _marks(singles.join(F.broadcast(own), "word", "left_anti"))

    def rare(parts):
        known = sent.value
        for batch in parts:
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("data")):
                words = np.unique(np.concatenate(known.words(block.as_py(), 2)[:2]))
                words = words[known.codes(words) < 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), shard, np.int32)), pa.array(words)], ["shard", "word"])

    def counted_ones(parts):
        shard, held = -1, []
        for batch in parts:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                held.append([batch.column(x).to_numpy() for x in ("word", "n")])
        if held:
            words, n = _joined(held, 2)
            words, at = np.unique(words, return_index=True)
            yield _rows(_COUNTED, m=1, shard=shard, data=_packed(np.diff(words, prepend=0), n[at]))

    asked = bigrams.select("shard", "data").mapInArrow(rare, "shard int, word long").join(singles, "word").select("shard", "word", "n")
    counts = stored(asked.repartitionById(shards, "shard").mapInArrow(counted_ones, _COUNTED))
    discarded(singles)
    return reduce(DataFrame.unionByName, (counts, bigrams, trigrams)).select("m", "shard", "data"), known, rates


def _marked_place(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * STEP) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _marks(rest: DataFrame) -> np.ndarray:
    """The bitmap of the words beyond the table, of fixed size, made in parts."""
    bits = MARK_BITS - 7

    def places(parts):
        for batch in parts:
            p = _marked_place(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((p >> bits).astype(np.int32)), pa.array((p & ((1 << bits) - 1)).astype(np.int32))], ["part", "p"])

    def part(key, group):
        own = np.zeros(1 << bits, bool)
        own[group.column("p").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([np.packbits(own).tobytes()], pa.binary())})

    table = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    size = 1 << (bits - 3)
    # 128 parts at most
    for i, marks in rest.select("word").mapInArrow(places, "part int, p int").groupBy("part").applyInArrow(part, "part int, marks binary").collect():
        table[i * size : (i + 1) * size] = np.frombuffer(marks, np.uint8)
    return table


def _found(known: Known, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with UNKNOWN for those that the model surely doesn't hold, and their codes."""
    code = known.codes(words)
    rare = np.flatnonzero(code < 0)
    place = _marked_place(words[rare])
    lost = rare[(known.marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 0]
    words[lost], code[lost] = UNKNOWN, 0
    return words, code


class _Shard:
    """What a shard's words are told by."""

    def __init__(self, known: Known, rates: Rates, held: dict[int, list[bytes]]):
        own = [_unpacked(x) for x in held[1]]
        ids, before = _joined([[np.cumsum(x), n] for x, n in own], 2)
        self.ids, at = np.unique(ids, return_index=True)
        self.known, self.rates, self.before = known, rates, before[at]
        cut = lambda m, n: rates.discounts[m][np.minimum(n, 3)]
        b, c, n = _joined([known.words(x, 2) for x in held[2]], 3)
        starts = _runs(b)
        sizes = np.diff(np.append(starts, len(b)))
        total, saved = (np.add.reduceat(x, starts) if len(b) else x for x in (n, cut(2, n)))
        gamma = saved / np.maximum(total, 1)
        single = self.single(c)
        pair = (n - cut(2, n)) / np.repeat(total, sizes) + np.repeat(gamma, sizes) * single
        keys = _keys([c, b])
        self.pairs = Table(keys, np.log(pair / single), np.nan)
        self.words = Table(b[starts], np.arange(len(starts), dtype=np.int32), -1)
        # a word that no text of the model has is the last one here; nothing foretells what a text begins with
        self.back = np.append(np.log(gamma), 0.0)
        self.alone = np.append(np.where(b[starts] == BEGIN, 0.0, np.log(self.single(b[starts]))), math.log(rates.share))
        at = Table(keys, np.arange(len(keys), dtype=np.int32), -1)
        a, b, c, n = _joined([known.words(x, 3) for x in held[3]], 4)
        starts = _runs(b, a)
        sizes = np.diff(np.append(starts, len(b)))
        total, saved = (np.add.reduceat(x, starts) if len(b) else x for x in (n, cut(3, n)))
        gamma, at = saved / np.maximum(total, 1), at.get(_keys([c, b]))
        three = (n - cut(3, n)) / np.repeat(total, sizes) + np.repeat(gamma, sizes) * pair[at]
        self.threes = Table(_keys([c, b, a]), np.log(three / single[at]), np.nan)
        self.after = Table(_keys([b[starts], a[starts]]), np.log(gamma), np.nan)

    def single(self, words: np.ndarray) -> np.ndarray:
        code, n = self.known.codes(words), np.zeros(len(words), np.int64)
        n[code >= 0] = self.known.before[code[code >= 0]]
        rare = np.flatnonzero(code < 0)
        n[rare] = self.before[np.searchsorted(self.ids, words[rare])] if len(rare) else 0
        return self.rates.single(n)

    def logs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """ln p(c | a, b) / p(c) and ln p(b) together: summed over a text, and with the end's ln p, its log probability."""
        value = self.threes.get(_keys([c, b, a]))
        word = self.words.get(b)
        lost = np.flatnonzero(np.isnan(value))
        a, b, c = a[lost], b[lost], c[lost]
        pair = self.pairs.get(_keys([c, b]))
        value[lost] = np.nan_to_num(self.after.get(_keys([b, a])), nan=0.0) + np.where(np.isnan(pair), self.back[word[lost]], pair)
        return value + self.alone[word]


def perplexities(docs: DataFrame, trusted: DataFrame, table: int = TABLE) -> DataFrame:
    """doc_id, lang, n_words and perplexity (a word's, with the text's end; null without words) from docs
    (doc_id, text, lang), under the model of trusted (text). Without trusted texts every word is as likely as any.
    docs is read several times and has to give its rows in the same order each time; otherwise this is an error."""
    whole, known, rates = model(trusted, table)
    docs, shards = docs.select("doc_id", "lang", "text"), known.shards
    sent = docs.sparkSession.sparkContext.broadcast((known, rates))
    kinds = {f.name: f.dataType for f in docs.schema}
    names = ["row", "doc_id", "lang", "n_words", "total"]

    def told(parts):
        """Each text's words, and the sum of what is known of it without the shards; last, what all texts sum to."""
        (known, rates), of, row, mark = sent.value, TaskContext.get().partitionId(), 0, 0
        types = None
        for batch in parts:
            texts, held = [], []
            for own in slices(batch.column("text")):
                texts += own
                held += _words(own)
            for x in texts:
                mark = zlib.crc32(x, mark)
            if texts:
                types = [batch.column(x).type for x in names[1:3]]
                data, at, counts = _laid(held)
                lost = np.add.reduceat((_found(known, data)[0][at] == UNKNOWN).astype(np.int64), np.cumsum(counts) - counts)
                rows = (of << 33) + row + np.arange(len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(rows), *(batch.column(x) for x in names[1:3]), pa.array(counts - 1), pa.array(lost * math.log(rates.share) + rates.end)], names)
            row += len(texts)
        if types:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - of]), *(pa.nulls(1, t) for t in types), pa.nulls(1, pa.int64()), pa.array([float(mark)])], names)

    def asking(nth):
        def asked(parts):
            (known, _), of, mark = sent.value, TaskContext.get().partitionId(), None
            for start, texts, mark in _chunks(parts):
                data, at, counts = _laid(texts)
                data, code = _found(known, data)
                home, spread = known.homes(data, code)
                at, owner = at[kept := np.flatnonzero(code[at - 1] != 0)], np.repeat(np.arange(len(texts)), counts)[kept]
                shard = (home[at - 1] + (mixed(data[at - 2].astype(np.uint64)) >> np.uint64(40)) % spread[at - 1]) % np.uint64(shards)
                mine = np.flatnonzero(shard % np.uint64(PASSES) == nth)
                at, owner = at[mine], owner[mine]
                for k, own in _cut(shard[mine]):
                    p = at[own]
                    three = [p - 2, p - 1, p]
                    yield _rows(_BLOCK, m=4, shard=k, of=of, start=start, data=known.block([data[x] for x in three], [code[x] for x in three], np.diff(owner[own], prepend=0)))
            if mark is not None:
                yield _rows(_BLOCK, m=5, shard=nth, of=of, start=mark)

        return asked

    def answered(parts):
        known, rates = sent.value
        held, shard = defaultdict(list), None
        for batch in parts:
            for m, of, start, data in zip(*(batch.column(x).to_pylist() for x in ("m", "of", "start", "data"))):
                if m < 4:
                    held[m].append(data)
                elif m == 5:
                    yield _rows(_BLOCK, m=m, of=of, start=start)
                else:
                    shard = shard or _Shard(known, rates, held)
                    a, b, c, owner = known.words(data, 3)
                    owner = np.cumsum(owner)
                    starts = _runs(owner)
                    sums = np.add.reduceat(shard.logs(a, b, c), starts).astype(np.float32)
                    yield _rows(_BLOCK, m=m, of=of, start=start, data=_packed(np.diff(owner[starts], prepend=0), sums.view(np.uint32)))

    def summed(parts):
        held, size = [], 0

        def folded():
            rows, own = (np.concatenate(x) for x in zip(*held))
            rows, at = np.unique(rows, return_inverse=True)
            return rows, np.bincount(at, own, len(rows))

        for batch in parts:
            for m, of, start, data in zip(*(batch.column(x).to_pylist() for x in ("m", "of", "start", "data"))):
                if m == 5:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - of]), pa.array([float(start)])], ["row", "total"])
                    continue
                owner, sums = _unpacked(data)
                held.append(((of << 33) + start + np.cumsum(owner), sums.astype(np.uint32).view(np.float32).astype(np.float64)))
                size += len(owner)
                if size > CHUNK:
                    held, size = [folded()], 0
        if held:
            rows, own = folded()
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(own)], ["row", "total"])

    types = {k: t.simpleString() for k, t in kinds.items()}
    rows = stored(docs.mapInArrow(told, f"row long, doc_id {types['doc_id']}, lang {types['lang']}, n_words long, total double"))
    sums = [rows.select("row", "total")]
    for nth in range(PASSES):
        own = whole.where(F.col("shard") % PASSES == nth).select("m", "shard", F.lit(None).cast("int").alias("of"), F.lit(None).cast("long").alias("start"), "data")
        both = docs.mapInArrow(asking(nth), _BLOCK).unionByName(own)  # texts first: rows go by their tasks
        met = both.repartitionById(-(-shards // PASSES), F.expr(f"shard div {PASSES}").cast("int")).sortWithinPartitions("m")
        sums.append(stored(met.mapInArrow(answered, _BLOCK).repartition("of").mapInArrow(summed, "row long, total double")))
    discarded(whole)
    every = reduce(DataFrame.unionByName, sums)
    if every.where("row < 0").groupBy("row").agg(F.count("*").alias("n"), F.count_distinct("total").alias("kinds")).where(f"n <> {PASSES + 1} OR kinds > 1").count():
        raise RuntimeError("texts came in another order when they were read again")
    total = every.where("row >= 0").groupBy("row").agg(F.sum("total").alias("total"))
    return rows.where("row >= 0").drop("total").join(total, "row").select(
        "doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("total") / (F.col("n_words") + 1))).alias("perplexity")
    )


def _in_training(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.concat(F.lit("trusted "), F.col(doc_id).cast("string")).cast("binary")) % 2 == 0


def rate(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
    quantile: float = QUANTILE, table: int = TABLE,
) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold and kept of each row.

    Trusted texts are those labelled 1 (of several labels of an id the worst counts). One half of their ids by hash
    trains the model, all of it. A row is kept if its perplexity is at most
    the `quantile` of the other half's texts of its language; in a language that the half does not have, of the whole
    half; if it is empty, every text is kept. Null texts and texts without a word have no perplexity
    and are not kept. Null languages are a language of their own; ids may be null (they have no label) or repeated.
    An empty table gives an empty table; other columns are not looked at.
    """
    rows = columns(df, doc_id=id_col, text=text_col, lang=lang_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = columns(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IS NOT NULL")
    # The ids grow with the corpus: a merge join at every size, not a broadcast while they happen to be few.
    good = stored(known.groupBy("doc_id").agg(F.min("label").alias("label")).where("label > 0").select("doc_id")).hint("merge")
    training = rows.where((F.col("text") != "") & _in_training())
    # of the texts only those that likely have a label are shuffled
    alike = good.select(F.col("doc_id").cast(rows.schema["doc_id"].dataType))  # hashes depend on the type
    trusted = likely(training, "doc_id", alike).join(good, "doc_id", "left_semi").select("text")
    found = stored(perplexities(rows, trusted, table))
    rated = found.where("perplexity IS NOT NULL").where(~_in_training()).join(good, "doc_id", "left_semi")
    fence = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    own = stored(rated.groupBy(F.col("lang").alias("of")).agg(fence.alias("own")))
    of_all = rated.agg(fence).first()[0]
    threshold = F.coalesce("own", F.lit(of_all).cast("double"))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))))
    return found.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), F.coalesce(kept, F.lit(False)).alias("kept")
    )
