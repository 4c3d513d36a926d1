"""Operators 1 and 2: packing token ids into sequences of fixed capacity.

A task packs windows of documents as it reads them, so nothing is shuffled, a window's memory is
bounded (WINDOW tokens and one document), and a lost task is done again alone. Each window is filled
to its last sequence, so padding is under one sequence a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import columns
from .tokens import encoder

#: Tokens that are packed together.
WINDOW = 1 << 21
#: Share of padding that cost-balanced packing may use to leave documents whole.
SLACK = 0.01


def _windows(parts: Iterator[pa.RecordBatch], path: str, end_id: int | None, window: int):
    """Lists of (id, ids) with about `window` tokens each."""
    encode = encoder(path)
    end = np.array([] if end_id is None else [end_id], "<u4")
    docs, held = [], 0
    for batch in parts:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.concatenate([encode(text.as_py()), end])
            docs.append((doc_id.as_py(), ids))
            held += len(ids)
            if held >= window:
                yield docs
                docs, held = [], 0
    if docs:
        yield docs


def _numbers() -> Iterator[int]:
    """Sequence ids that no other task gives: the task's partition, then a running number."""
    first = TaskContext.get().partitionId() << 33
    while True:
        yield first
        first += 1


class CapacityTree:
    """Segment tree over the open bins by remaining capacity: the best fit is the smallest remaining
    capacity that holds a piece, found on one way down from the root."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)  # bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room of at least `length`, removed, and that room."""
        node = self.size + length
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (document, start, length). Overlong documents are cut at the capacity, losslessly;
    the pieces go, longest first, each into the open bin that it fills best."""
    pieces = [(min(capacity, n - at), d, at) for d, n in enumerate(lengths) for at in range(0, n, capacity)]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    tree, bins = CapacityTree(capacity), []
    for length, d, at in pieces:
        found = tree.take(length)
        if found is None:
            bins.append([])
            found = len(bins) - 1, capacity
        bin_, room = found
        bins[bin_].append((d, at, length))
        if room > length:
            tree.put(room - length, bin_)
    return bins


def cost_balanced(lengths: list[int], capacity: int, linear: float, quadratic: float, slack: float = 0.0) -> list[list[tuple[int, int, int]]]:
    """As many bins as the tokens and a share `slack` of padding need (fewer if some stay empty), of (document,
    start, length).

    Overlong documents fill whole bins; what is left of them waits. The other documents go in descending order of
    cost (linear * n + quadratic * n * n), each to the bin of lowest cost so far among those with room for it, then
    the waiting rests in the same way. What fits nowhere is cut: its head fills the roomiest bin, the lower cost
    first, and so on with the rest. So documents that fit a bin are cut only when no rest is there to be cut."""
    n_bins = math.ceil(sum(lengths) * (1 + slack) / capacity)
    bins: list[list[tuple[int, int, int]]] = []
    order = sorted(range(len(lengths)), key=lambda d: (-lengths[d], d))
    rests = []
    for d in order:
        if lengths[d] > capacity:
            whole = lengths[d] // capacity
            bins += [[(d, i * capacity, capacity)] for i in range(whole)]
            if lengths[d] > whole * capacity:
                rests.append((lengths[d] - whole * capacity, d, whole * capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    open_: list[list[tuple[int, int, int]]] = [[] for _ in range(n_bins - len(bins))]
    room, cost = np.full(len(open_), capacity, np.int64), np.zeros(len(open_))
    for n, d, at in [*((lengths[d], d, 0) for d in order if lengths[d] <= capacity), *rests]:
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room == room.max())
            bin_ = int(fits[np.argmin(cost[fits])])
            part = min(n, int(room[bin_]))
            open_[bin_].append((d, at, part))
            room[bin_] -= part
            cost[bin_] += linear * part + quadratic * part * part
            n, at = n - part, at + part
    return bins + [x for x in open_ if x]


PIECE = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, sequence_cost double"
)


def _cost_balanced_pieces(parts, path, capacity, end_id, linear, quadratic, slack, window, kind):
    numbers = _numbers()
    for docs in _windows(parts, path, end_id, window):
        rows: dict[str, list] = {k: [] for k in ("doc_id", *(x.split()[0] for x in PIECE.split(", ")))}
        for pieces in cost_balanced([len(ids) for _, ids in docs], capacity, linear, quadratic, slack):
            number, offset = next(numbers), 0
            tokens = sum(n for _, _, n in pieces)
            cost = sum(linear * n + quadratic * n * n for _, _, n in pieces)
            for d, at, n in pieces:
                doc_id, ids = docs[d]
                row = (doc_id, at, n, ids[at : at + n].tobytes(), len(ids), number, offset, tokens, cost)
                for values, value in zip(rows.values(), row, strict=True):
                    values.append(value)
                offset += n
        types = (kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))


def pack_cost_balanced(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int | None = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    slack: float = SLACK,
    window: int = WINDOW,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (gapless within the sequence), sequence_tokens and sequence_cost.

    Each document's ids, then end_id if given, lie in exactly one piece each. Null and empty texts are
    the end id alone (without end_id: no row). Ids may be null or repeated: each row is a document of
    its own. An empty table gives an empty table; other columns are not looked at. Sequence ids are
    unique within the result and follow the input's partitions.
    """
    docs = columns(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run = partial(
        _cost_balanced_pieces, path=path, capacity=capacity, end_id=end_id, linear=linear, quadratic=quadratic, slack=slack, window=window, kind=to_arrow_type(kind)
    )
    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECE}")


SEQUENCE = (
    "sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "starts array<long>"
)


def _best_fit_sequences(parts, path, capacity, end_id, pad_id, window, kind):
    numbers = _numbers()
    for docs in _windows(parts, path, end_id, window):
        rows: list[tuple] = []
        for pieces in best_fit([len(ids) for _, ids in docs], capacity):
            ids, positions = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
            ends = [0]
            for d, at, n in pieces:
                a = ends[-1]
                ids[a : a + n] = docs[d][1][at : at + n]
                positions[a : a + n] = np.arange(n)
                ends.append(a + n)
            rows.append((next(numbers), ends[-1], ids.tobytes(), ends, positions.tobytes(), [at for _, at, _ in pieces], [docs[d][0] for d, _, _ in pieces]))
            if len(rows) == 1024:
                yield _sequence_batch(rows, kind)
                rows = []
        if rows:
            yield _sequence_batch(rows, kind)


def _sequence_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(kind))
    names = [*(x.split()[0] for x in SEQUENCE.split(", ")), "doc_ids"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def pack_best_fit(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int | None = 50256,
    pad_id: int = 50256,
    window: int = WINDOW,
) -> DataFrame:
    """One row for each sequence: sequence_id, n_tokens (without padding), input_ids and position_ids
    (each `capacity` little-endian unsigned 32-bit numbers; positions start at 0 with each segment),
    cu_seqlens (0, then the end of each segment), and the segments' doc_ids and starts.

    Overlong documents are cut at the capacity and nothing is lost: a document's ids are its segments'
    in order of start. Null and empty texts are the end id alone (without end_id: in no sequence). Ids
    may be null or repeated: each row is a document of its own. An empty table gives an empty table;
    other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = columns(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType
    run = partial(_best_fit_sequences, path=path, capacity=capacity, end_id=end_id, pad_id=pad_id, window=window, kind=to_arrow_type(kind))
    return docs.mapInArrow(run, f"{SEQUENCE}, doc_ids array<{kind.simpleString()}>")


def write_packed(sequences: DataFrame, path: str, rows: int = 4096) -> None:
    """Packed sequences as Parquet: fixed-width id and position rows, so that a file's column, read as
    one buffer, is the id matrix; `rows` sequences a file at most. No sequences make a folder without rows; a folder
    that is there already is an error, nothing is overwritten."""
    sequences.write.option("maxRecordsPerFile", rows).parquet(path)


def unpacked(sequences: DataFrame) -> DataFrame:
    """doc_id, start and ids (binary) of every segment: the way back, for checks. Documents without ids, by null text and
    no end id, come back in no row; null and repeated doc_ids come as they were given."""

    def run(parts):
        for batch in parts:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["input_ids"], "<u4")
                for d, at, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                    rows.append((d, at, ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], batch.schema.field("doc_ids").type.value_type), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())],
                ["doc_id", "start", "ids"],
            )

    kind = sequences.schema["doc_ids"].dataType.elementType.simpleString()
    return sequences.mapInArrow(run, f"doc_id {kind}, start long, ids binary")

