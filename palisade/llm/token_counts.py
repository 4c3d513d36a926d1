"""Operator 7: token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the frequent pre-tokens (white-space delimited) and their numbers of
tokens; tier two is a bounded cache in each worker, filled by the library. No pre-token is shuffled:
the only rows that move are each task's few most frequent pre-tokens, while the table is made.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns
from .tokens import special_strings, tokenizer

#: Bounds of the broadcast table: entries, and characters of an entry.
TABLE = 32_768
TABLE_CHARS = 32
#: Bounds of a worker's cache: entries beside the table, and characters of an entry.
CACHED = 600_000
LONGEST_CACHED = 64
PIECES = re.compile("[^ \t\n\r\v\f]+")
#: Pre-tokens that a task reports, and that it counts before it forgets the rare ones.
REPORTED = 2_048
COUNTED = 200_000


def _frequent(parts):
    counts: Counter = Counter()
    for batch in parts:
        for text in batch.column(0).to_pylist():
            counts.update((text or "").split())
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 4)))
    top = [(k, n) for k, n in counts.most_common(REPORTED) if len(k) <= TABLE_CHARS]
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top]), pa.array([n for _, n in top])], ["piece", "n"])


def frequent_lengths(texts: DataFrame, path: str, entries: int = TABLE) -> dict[str, int]:
    """The most frequent pre-tokens of all texts and their numbers of tokens; `entries` at most.

    A pre-token that no task saw often may be missing: it then costs a cache entry, no exactness."""
    top = (
        texts.mapInArrow(_frequent, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(entries)
        .toPandas()["piece"]
        .tolist()
    )
    tok = tokenizer(path)
    return {k: len(e.ids) for k, e in zip(top, tok.encode_batch(top, add_special_tokens=False), strict=True)}


class Lengths(dict):
    """Second tier: numbers of tokens of pre-tokens; the frequent ones come with it and stay."""

    def __init__(self, frequent: dict[str, int], tok):
        super().__init__(frequent)
        self.frequent, self.tok = frequent, tok

    def __missing__(self, piece: str) -> int:
        n = len(self.tok.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


_LENGTHS: dict[tuple[str, int], Lengths] = {}


def _worker_lengths(path: str, table) -> Lengths:
    """The cache outlives a task, as worker processes do; there is one at a time."""
    key = (path, id(table.value))
    if key not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[key] = Lengths(table.value, tokenizer(path))
    return _LENGTHS[key]


def count_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, entries: int = TABLE
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row.

    path: a tokenizers JSON file, present on every machine, whose pre-tokenizer splits at white space.
    Null texts count as empty (0 tokens); null or repeated ids stay as they are, a row for each row;
    an empty table gives an empty table; other columns are not looked at.
    """
    docs = columns(df, doc_id=id_col, text=text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select("text"), path, entries))

    def make():
        lengths = _worker_lengths(path, table)
        tok = lengths.tok
        special = special_strings(tok)

        def count(text: str | None) -> int:
            if not text:
                return 0
            if any(x in text for x in special):
                return len(tok.encode(text, add_special_tokens=False).ids)
            # not split(): it also splits at characters that the library may keep
            return sum(map(lengths.__getitem__, PIECES.findall(text)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = batch.column("text")
            n = pa.array([count(x.as_py()) for x in text], pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(docs, make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

