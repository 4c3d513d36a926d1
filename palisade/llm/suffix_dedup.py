"""Operator 3: removal of byte strings that repeat anywhere, by sorted suffixes.

1. Anchors: in every window of `width` bytes the GRAM bytes with the smallest hash are its anchor, so equal
   windows have equal anchors at equal offsets. An anchor owns a run of neighbouring windows; the run's
   bytes are its span. About one position in 85 is an anchor.
2. Anchors meet by hash, counted first, so that only anchors that occur twice go on. Spans that occur several times,
   by the hashes of anchor and span, 128 bits, repeat with all their windows. A task combines its
   own equal spans and texts first, so that each sends a row for each task at most, however often it occurs.
3. Where different spans share an anchor, some of their windows may be equal: their suffixes are sorted,
   deep-shallow. The shallow part is a multikey quicksort, eight bytes at a time: ranges are parted into less, equal
   and greater around a pivot of their own, and only ranges that are not resolved go on, equal ones to the next
   character. The deep part sorts each remaining range, whose suffixes have a long common prefix, in a blind
   trie. Neighbours with a common prefix of `width` bytes repeat.
4. The repeated windows of a text are merged and cut out.

Texts are known by a hash of their bytes that is checked to stand for one text; equal texts are one text with several
places.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, likely, mixed, most_frequent, stored

WIDTH = 200
GRAM = 32
#: Bytes of text, anchors and windows that a task works on at once.
BYTES = 1 << 21
HELD = 500_000
SORTED = 200_000
#: Different spans of one anchor beyond which its windows are dealt by their own hash.
MANY = 1000
#: Rows of one anchor, and copies of one text, beyond which they are not shuffled by it, while what is sent to all tasks
#: for those is no more than SENT entries (the anchors with most rows).
HOT = 1000
SENT = 1_000_000
#: Characters of eight bytes that the shallow sort looks at.
SHALLOW = 2
_STEP = 0x9E3779B97F4A7C15
_PLACE = np.uint64(30)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position, by doubling."""
    h, size, step = data.astype(np.uint64) + np.uint64(1), 1, _STEP
    while size < GRAM:
        h = h[:-size] * np.uint64(step) + h[size:]
        size, step = 2 * size, step * step & 0xFFFFFFFFFFFFFFFF
    return mixed(h)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: for each anchor its hash and place, and its first and last window start."""
    if len(data) < width:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h = _gram_hashes(data)
    # Equal hashes: the last place, which is the smaller number.
    top = (np.uint64(1) << _PLACE) - np.uint64(1)
    values = (h >> _PLACE << _PLACE) | (top - np.arange(len(h), dtype=np.uint64))
    least = _window_minima(values, width - GRAM + 1)
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    fresh = np.r_[True, least[1:] != least[:-1]]
    fresh[starts[long & (starts < len(least))]] = True
    first = np.flatnonzero(valid & (fresh | ~np.r_[False, valid[:-1]]))
    stop = np.r_[np.flatnonzero(valid[:-1] & (~valid[1:] | fresh[1:])), len(least) - 1] if len(least) else first
    last = stop[np.searchsorted(stop, first)]
    place = (top - (least[first] & top)).astype(np.int64)
    return h[place], place, first, last


def _pieces(parts, width):
    """Neighbouring rows of some BYTES together: bytes, ends, keys, and where in its text each begins. A long text
    comes in pieces that overlap so that each window is in one of them. A text that the task had before comes as
    no bytes."""
    seen: dict[int, int] = {}

    def out(held):
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        ends = np.cumsum(np.fromiter((len(x) for *_, x in held), np.int64, len(held)))
        return data, ends, np.array([k for k, _, _ in held], np.int64), np.array([at for _, at, _ in held], np.int64)

    for batch in parts:
        held, n = [], 0
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            size = len(text.as_buffer())
            if key in seen:
                yield None, key, size
                continue
            if len(seen) > HELD:
                seen.clear()
            seen[key] = size
            raw = memoryview(text.as_buffer())
            for at in range(0, size - width + 1, BYTES):
                held.append((key, at, raw[at : at + BYTES + width - 1]))
                n += len(held[-1][2])
                if n >= BYTES:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)


ROW = "h long, span long, n int, key long, lo int, hi int"


def _rows(parts, width):
    """A row for each span of the task. Of spans that it holds several times one row stands for all, with
    n = 2; the others' places are covered already and go on under their text's key, merged (n = 3), and so does a text
    that the task holds several times, once."""
    held: list[np.ndarray] = []
    again: dict[int, int] = {}
    n = 0
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32)

    def batch_of(values):
        return pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip(values, kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])

    def out():
        h, span, key, lo, hi = np.concatenate(held, axis=1)
        order = np.lexsort((span, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (span[order][1:] != span[order][:-1])]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(order)])
        times = np.empty(len(order), np.int64)
        times[order] = np.repeat(sizes, sizes)
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        rest = ~first
        k, a, b = key[rest], lo[rest], hi[rest]
        start = np.r_[True, (k[1:] != k[:-1]) | (a[1:] > b[:-1] + width)] if len(k) else np.zeros(0, bool)
        stop = np.r_[start[1:], True] if len(k) else start
        k, a, b = k[start], a[start], b[stop]
        return batch_of((np.r_[h[first], k], np.r_[span[first], a], np.r_[np.minimum(times[first], 2), np.full(len(k), 3)], np.r_[key[first], k], np.r_[lo[first], a], np.r_[hi[first], b]))

    for data, *about in _pieces(parts, width):
        if data is None:
            again[about[0]] = about[1]
            continue
        ends, keys, begins = about
        h, place, first, last = anchors(data, ends, width)
        owner = np.searchsorted(ends, first, side="right")
        shift = (np.r_[0, ends[:-1]] - begins)[owner]
        view = memoryview(np.ascontiguousarray(data))
        spans = (xxhash.xxh3_64_intdigest(view[f : t + width], p - f) for p, f, t in zip(place.tolist(), first.tolist(), last.tolist(), strict=True))
        span = np.fromiter(spans, np.uint64, len(first)).astype(np.int64)
        held.append(np.stack([h.astype(np.int64), span, keys[owner], first - shift, last - shift]))
        n += len(first)
        if n > HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()
    if again:
        key, size = np.array(list(again), np.int64), np.array(list(again.values()), np.int64)
        yield batch_of((key, key, np.full(len(key), 3), key, np.zeros(len(key)), size - width))


class BlindTrie:
    """Sorts strings of one length with a long common prefix: nodes keep only where their strings part.

    A string goes down by the bytes at those places, is compared with the one leaf it reaches, and enters
    where the two part. Strings that don't part at all are equal."""

    def __init__(self, length: int):
        self.length = length
        self.root: list | None = None
        self.equal: list[list[int]] = []

    def add(self, text: bytes, item: int) -> None:
        """A node is [depth, {byte: node}, a leaf below it]; a leaf is [length, its string, index in equal]."""
        if self.root is None:
            self.root = self._leaf(text, item)
            return
        node = self.root
        while node[0] < self.length:
            node = node[1].get(text[node[0]]) or node[2]
        common = _common(text, node[1], self.length)
        if common == self.length:
            self.equal[node[2]].append(item)
            return
        above, node = None, self.root
        while node[0] < common:
            above, node = node, node[1][text[node[0]]]
        if node[0] == common:
            node[1][text[common]] = self._leaf(text, item)
            return
        leaf = node if node[0] == self.length else node[2]
        parted = [common, {text[common]: self._leaf(text, item), leaf[1][common]: node}, leaf]
        if above is None:
            self.root = parted
        else:
            above[1][text[above[0]]] = parted

    def _leaf(self, text: bytes, item: int) -> list:
        self.equal.append([item])
        return [self.length, text, len(self.equal) - 1]

    def ordered(self) -> list[list[int]]:
        """Items by string, equal ones together."""
        found, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            if node[0] == self.length:
                found.append(self.equal[node[2]])
            else:
                open_.extend(node[1][x] for x in sorted(node[1], reverse=True))
        return found


def _common(a: bytes, b: bytes, length: int) -> int:
    low, high = 0, length
    if a == b:
        return length
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _medians(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows of words (a column for each character) within their group (ascending): their order, and where
    ranges of equal rows begin.

    All unresolved ranges are parted at once: each around the median of three of its members at its own depth. Less
    and greater stay at the depth, equal ones go one character deeper; ranges of one row, or at the last depth,
    are done."""
    n, deepest = words.shape
    order = np.argsort(group, kind="stable")
    fresh = np.ones(n, bool)
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    depth = np.zeros(len(start), np.int64)
    while True:
        done = depth == deepest
        for a, k in zip(start[done & (size > 1)].tolist(), size[done & (size > 1)].tolist(), strict=True):
            fresh[a + 1 : a + k] = False
        open_ = ~done & (size > 1)
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order, fresh
        ends = np.cumsum(size)
        begins = ends - size
        at = np.arange(ends[-1]) + np.repeat(start - begins, size)
        own = order[at]
        value = words[own, np.repeat(depth, size)]
        pivot = np.repeat(_medians(value[begins], value[begins + size // 2], value[ends - 1]), size)
        less, equal = value < pivot, value == pivot
        kind = np.where(less, 0, np.where(equal, 1, 2))
        # where each row goes: its range's begin, the rows of smaller kinds, those of its kind before it
        counts = np.stack([np.add.reduceat(kind == k, begins) for k in range(3)], axis=1)
        to = np.empty(len(at), np.int64)
        before = np.cumsum(counts, axis=1) - counts
        for k in range(3):
            mine = kind == k
            nth = np.cumsum(mine) - 1
            nth -= np.repeat(nth[begins] + (~mine[begins]), size)
            to[mine] = (np.repeat(start + before[:, k], size) + nth)[mine]
        order[to] = own
        start = (start[:, None] + before).ravel()
        size = counts.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def sorted_suffixes(data: bytes, starts: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts`, in order of group and their first `width` bytes, and where runs of equal ones begin.

    Shallow: multikey quicksort of the first characters of eight bytes. Deep: blind tries, for each range left."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    words = np.stack([np.ascontiguousarray(windows[starts + 8 * d]).view(">u8").ravel().astype(np.uint64) for d in range(SHALLOW)], axis=1)
    order, fresh = multikey_quicksort(words, group)
    cuts = np.r_[np.flatnonzero(fresh), len(order)]
    for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
        a, b = int(cuts[i]), int(cuts[i + 1])
        trie = BlindTrie(width)
        for item, at in zip(order[a:b].tolist(), starts[order[a:b]].tolist(), strict=True):
            trie.add(data[at : at + width], item)
        for equal in trie.ordered():
            order[a : a + len(equal)] = equal
            fresh[a] = True
            a += len(equal)
    return order, fresh


SPAN = "h long, part long, alone boolean, key long, lo int, bytes binary"


def _spans(parts, width):
    """From rows (key, text, wanted spans): the spans' bytes; of anchors with MANY spans each window alone. Of equal
    windows of a task one goes on for all; the others, and that one, are found already and have no bytes."""
    met: dict[tuple, tuple] = {}
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
    for batch in parts:
        rows, size = [], 0
        for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
            raw = memoryview(text.cast(pa.binary()).as_buffer())
            for x in wanted.as_py():
                if x["m"] <= MANY:
                    rows.append((x["h"], 0, x["n"] == 1, key, x["lo"], bytes(raw[x["lo"] : x["hi"] + width])))
                    size += len(rows[-1][5])
                    continue
                for at in range(x["lo"], x["hi"] + 1):
                    own = bytes(raw[at : at + width])
                    known = (x["h"], xxhash.xxh3_128_digest(own))
                    if known in met:
                        rows += [(k, -1, True, k, lo, None) for k, lo in {met[known], (key, at)} if k is not None]
                        met[known] = (None, None)
                        continue
                    if len(met) > HELD:
                        met.clear()
                    met[known] = (key, at)
                    rows.append((x["h"], xxhash.xxh3_64_intdigest(own) >> 1, x["n"] == 1, key, at, own))
                    size += width
                if size > BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SPAN.split(", ")])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SPAN.split(", ")])


def _repeated(parts, width):
    """From spans sorted by h and part: the windows of spans met once that repeat, as merged runs."""
    held: list[tuple] = []
    windows = 0

    def runs(keys, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "lo", "hi"])

    def out():
        size = np.fromiter((len(x[5]) for x in held), np.int64, len(held))
        n = size - width + 1
        span = np.repeat(np.arange(len(held)), n)
        offset = np.cumsum(n) - n
        starts = np.arange(len(span)) + (np.cumsum(size) - size - offset)[span]
        group = np.cumsum([0, *(a[:2] != b[:2] for a, b in zip(held, held[1:], strict=False))])
        order, fresh = sorted_suffixes(b"".join(x[5] for x in held) + bytes(8 * SHALLOW), starts, group[span], width)
        times = np.diff(np.r_[np.flatnonzero(fresh), len(order)])
        hit = np.zeros(len(starts), bool)
        hit[order] = np.repeat(times > 1, times)
        hit &= np.array([x[2] for x in held])[span]
        spots = np.flatnonzero(hit)
        if not len(spots):
            return None
        new = np.r_[True, (np.diff(spots) > 1) | (np.diff(span[spots]) > 0)]
        first, last = spots[new], spots[np.r_[new[1:], True]]
        own = span[first]
        shift = np.array([x[4] for x in held])[own] - offset[own]
        return runs([held[i][3] for i in own.tolist()], shift + first, shift + last)

    for batch in parts:
        found = []
        for row in zip(*(batch.column(x).to_pylist() for x in ("h", "part", "alone", "key", "lo", "bytes")), strict=True):
            if row[5] is None:
                found.append((row[3], row[4]))
                continue
            if windows > SORTED and row[:2] != held[-1][:2]:
                if (sorted_ := out()) is not None:
                    yield sorted_
                held, windows = [], 0
            held.append(row)
            windows += len(row[5]) - width + 1
        if found:
            yield runs([k for k, _ in found], [at for _, at in found], [at for _, at in found])
    if held and (sorted_ := out()) is not None:
        yield sorted_


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without the runs, and how many runs there are once merged."""
    kept, at, n = [], 0, 0
    end = None
    for lo, hi in sorted(runs):
        if end is None or lo > end:
            if end is not None:
                at = end
            kept.append(raw[at:lo])
            n += 1
            end = hi
        else:
            end = max(end, hi)
    return b"".join(kept) + raw[at if end is None else end :], n


def _of_anchors(rows: DataFrame, live: DataFrame) -> DataFrame:
    """rows with m (how many of them, at least, have its anchor h), of the anchors that live tells of. Rows of hot
    anchors are joined where they are."""
    hot = stored(live.where((F.col("m") > HOT) & most_frequent(live, "m", SENT)))
    some = likely(rows, "h", live.select("h"))
    if hot.limit(1).count() == 0:
        return some.join(live, "h")
    marked = some.join(F.broadcast(hot.select("h", F.col("m").alias("hot_m"))), "h", "left")
    cold = marked.where("hot_m IS NULL").drop("hot_m").join(live, "h")
    return cold.unionByName(marked.where("hot_m IS NOT NULL").withColumnRenamed("hot_m", "m"))


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, lo, hi from docs (key, text): starts of repeated windows, first to last, of each text; runs may
    come several times or overlap."""
    rows = stored(docs.mapInArrow(partial(_rows, width=width), ROW))
    spans = rows.where("n < 3")
    # Anchors are counted where they are before they are shuffled. One whose only span is met once repeats nothing.
    live = spans.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    live = stored(live.where("all > 1").select("h", "m"))
    # Equal spans meet: a row for each task at most. Then different spans of an anchor are told by count again.
    n = F.sum("n").over(Window.partitionBy("h", "span")).alias("n")
    met = stored(_of_anchors(spans, live).select("h", "span", n, "key", "lo", "hi", "m"))
    covered = rows.where("n = 3").select("key", "lo", "hi").unionByName(met.where("n > 1").select("key", "lo", "hi"))
    different = met.dropDuplicates(["h", "span"])
    of = stored(different.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("alone")).where("m > 1 AND alone = 1").select("h", "m"))
    wanted = _of_anchors(different.drop("m"), of)
    wanted = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("h", "n", "m", "lo", "hi")).alias("wanted")))
    texts = likely(docs, "key", wanted.select("key")).dropDuplicates(["key"]).join(wanted, "key").select("key", "text", "wanted")
    sorted_ = (
        texts.mapInArrow(partial(_spans, width=width), SPAN)
        .repartition("h", "part")
        .sortWithinPartitions("h", "part")
        .mapInArrow(partial(_repeated, width=width), "key long, lo int, hi int")
    )
    return stored(covered.unionByName(sorted_).distinct())


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with key, a hash that stands for one text, and the keys of texts with more than HOT copies. Where two texts
    share a hash, which a second one tells, the others' keys are made anew."""
    hashed = docs.withColumn("key", F.xxhash64("text")).withColumn("also", F.xxhash64(F.lit("also"), "text"))
    keys = hashed.groupBy("key").agg(F.min("also").alias("a"), F.max("also").alias("b"), F.count("*").alias("copies"))
    keys = stored(keys.where((F.col("a") < F.col("b")) | (F.col("copies") > HOT)))
    hot = keys.where(F.col("copies") > HOT).select("key")
    shared = keys.where("a < b").select("key", "a")
    if shared.limit(1).count() == 0:
        return hashed.drop("also"), hot
    anew = F.when(F.col("also") > F.col("a"), F.xxhash64("also", "key")).otherwise(F.col("key"))
    return hashed.join(shared, "key", "left").withColumn("key", F.coalesce(anew, F.col("key"))).drop("also", "a"), hot


def _with_runs(docs: DataFrame, runs: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the runs of their text (some have none), and docs whose texts surely have none. Texts without runs are
    not shuffled, nor are those with many copies while their runs are few enough to be sent. What has runs meets them
    in a shuffle at every size: the bitmap's lookup and what cuts then run in different stages, and a task has one
    Python worker, not two that both stay."""
    many = stored(runs.join(hot, "key", "left_semi"))
    of_many = None
    if 0 < (many.agg(F.sum(F.size("runs"))).first()[0] or 0) <= SENT:
        sent = docs.join(F.broadcast(many.withColumnRenamed("runs", "of_many")), "key", "left")
        of_many = sent.where("of_many IS NOT NULL").withColumnRenamed("of_many", "runs")
        docs = sent.where("of_many IS NULL").drop("of_many")
    marked = likely(docs, "key", runs.select("key"), rest=True)
    joined = marked.where("likely").drop("likely").join(runs.hint("merge"), "key", "left")
    return joined if of_many is None else joined.unionByName(of_many), marked.where("NOT likely").drop("likely")


def cut_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: Sequence[str] = (), as_text: bool = False
) -> DataFrame:
    """doc_id, the columns to carry along, kept (binary: the bytes that are left), n_bytes, n_removed and n_spans
    of each row. as_text: kept is text, without the characters of which only some bytes are left.

    A byte goes if a string of `width` bytes over it also starts anywhere else, in the same text or another;
    all strings are judged on the input. Texts are whole UTF-8 (null: empty); shorter ones than `width` keep
    all. Equal texts repeat one another, repeated rows too. Ids may be null or repeated: a row for each row.
    An empty table gives an empty table; other columns are not looked at.
    """
    if width < GRAM:
        raise ValueError(f"strings of {width} bytes are too short: {GRAM} at least")
    own = [f"carried_{i}" for i in range(len(carry))]
    docs = columns(df, doc_id=id_col, text=text_col, **dict(zip(own, carry, strict=True)))
    docs, hot = _keyed(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    runs = repeated_runs(docs.select("key", "text").where(F.octet_length("text") >= width), width)
    runs = stored(runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs")))
    kinds = ", ".join(f"{x} {docs.schema[x].dataType.simpleString()}" for x in ("doc_id", *own))
    given, whole = _with_runs(docs, runs, hot)

    def cut(parts):
        for batch in parts:
            kept, spans = [], []
            for text, met in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                left, n = _cut(text, [(x["lo"], x["hi"] + width) for x in met or ()])
                kept.append(left)
                spans.append(n)
            size = pc.binary_length(batch.column("text").cast(pa.binary())).cast(pa.int64())
            kept = pa.array(kept, pa.binary())
            gone = pc.subtract(size, pc.binary_length(kept).cast(pa.int64()))
            if as_text:
                kept = pa.array([x.decode(errors="ignore") for x in kept.to_pylist()], pa.string())
            same = ("doc_id", *own)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, same), kept, size, gone, pa.array(spans, pa.int64())], [*same, "kept", "n_bytes", "n_removed", "n_spans"]
            )

    kind = "string" if as_text else "binary"
    found = given.select("doc_id", *own, "text", "runs").mapInArrow(cut, f"{kinds}, kept {kind}, n_bytes long, n_removed long, n_spans long")
    size, none = F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    found = found.unionByName(whole.select("doc_id", *own, F.col("text").cast(kind).alias("kept"), size, none.alias("n_removed"), none.alias("n_spans")))
    return found.withColumnsRenamed(dict(zip(own, carry, strict=True)))
