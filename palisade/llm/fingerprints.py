"""Operator 4: document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring words (a lone word: itself), lower-cased in A-Z, known by a 64-bit hash
and weighted by how often they occur. For each of SAMPLES hash functions and each term, r and c are
gamma(2, 1) and b uniform, all derived from the term alone; with weight w

    t = floor(ln w / r + b),  ln a = ln c - r * (t - b) - r,

and the sample is the term with the smallest a, with its t. Two texts give the same sample with the probability
of their generalised Jaccard similarity sum(min(w, w')) / sum(max(w, w')), so the share of equal samples estimates
it. A fingerprint keeps 16 bits of each sample. Nothing depends on other texts or on the machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, mixed, stored
from .shingles import word_hashes

SAMPLES = 64
EMPTY = bytes(2 * SAMPLES)
#: Terms that are drawn for together: their numbers stay in a processor's cache.
BLOCK = 256


def _levels() -> np.ndarray:
    """The middles of 2 ** 16 equal parts between 0 and 1."""
    return (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma_quantiles() -> np.ndarray:
    """gamma(2, 1) at each level: 1 - (1 + x) exp(-x) turned round by Newton's method."""
    p = _levels()
    x = np.where(p < 0.5, np.sqrt(2 * p), -np.log1p(-p) + 1.0)
    for _ in range(60):
        x = np.maximum(x - (-np.expm1(-x) - x * np.exp(-x) - p) / (x * np.exp(-x)), x / 8)
    return x


#: What 16 random bits stand for: an exponential number, and a gamma(2, 1) one.
_EXPONENTIAL = (-np.log(_levels())).astype(np.float32)
_GAMMA = _gamma_quantiles().astype(np.float32)
_OF_SAMPLE = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c and b of each term (rows) and sample (columns), from 64 bits for each; c is a sum of two exponentials,
    so that its small values are as fine as they have to be."""
    x = mixed(terms.astype(np.uint64)[:, None] ^ _OF_SAMPLE)
    part = [((x >> np.uint64(shift)) & np.uint64(0xFFFF)).view(np.int64) for shift in (0, 16, 32, 48)]
    c = _EXPONENTIAL.take(part[0], mode="clip") + _EXPONENTIAL.take(part[1], mode="clip")
    b = (part[3].astype(np.float32) + np.float32(0.5)) * np.float32(1 / (1 << 16))
    return _GAMMA.take(part[2], mode="clip"), c, b


class Samples:
    """For each sample the least ln a so far, its term and its t; of equal values the smaller term's counts."""

    def __init__(self):
        self.least = np.full(SAMPLES, np.inf, np.float32)
        self.term = np.zeros(SAMPLES, np.uint64)
        self.t = np.zeros(SAMPLES, np.int64)

    def add(self, terms: np.ndarray, weights: np.ndarray | None = None) -> Samples:
        """Takes in sorted terms; without weights all weigh one, so that t is 0."""
        every = np.arange(SAMPLES)
        for at in range(0, len(terms), BLOCK):
            own = terms[at : at + BLOCK]
            r, c, b = draws(own)
            t = None if weights is None else np.floor(np.log(weights[at : at + BLOCK].astype(np.float32))[:, None] / r + b)
            b -= np.float32(1) if t is None else t + np.float32(1)
            ln_a = np.log(c, out=c)
            ln_a += np.multiply(r, b, out=b)
            best = ln_a.argmin(axis=0)
            self._meet(ln_a[best, every], own[best], np.zeros(SAMPLES, np.int64) if t is None else t[best, every].astype(np.int64))
        return self

    def _meet(self, least: np.ndarray, term: np.ndarray, t: np.ndarray) -> None:
        better = (least < self.least) | ((least == self.least) & (term < self.term))
        self.least, self.term, self.t = (np.where(better, x, y) for x, y in ((least, self.least), (term, self.term), (t, self.t)))

    def joined(self, other: Samples) -> Samples:
        self._meet(other.least, other.term, other.t)
        return self

    def fingerprint(self) -> bytes:
        if not np.isfinite(self.least).any():
            return EMPTY
        return (mixed(mixed(self.term) + self.t.astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes()


Weighted = tuple[np.ndarray, np.ndarray]


def weighted_terms(text: str) -> Weighted:
    """Distinct 64-bit terms, sorted, and how often each occurs."""
    ids = word_hashes(text)
    if len(ids) > 1:
        ids = mixed(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])
    return np.unique(ids, return_counts=True)


def weighted_sample(terms: np.ndarray, weights: np.ndarray) -> bytes:
    """The fingerprint of distinct sorted terms with whole weights; none: EMPTY."""
    light = weights == 1
    return Samples().add(terms[light]).add(terms[~light], weights[~light]).fingerprint()


def both_samples(one: Weighted, other: Weighted) -> tuple[bytes, bytes]:
    """Both fingerprints; terms that weigh one in both are drawn for once."""
    (p, v), (q, w) = one, other
    in_both = np.intersect1d(p[v == 1], q[w == 1], assume_unique=True)
    common, found = Samples().add(in_both), []
    for terms, weights in (one, other):
        rest = ~np.isin(terms, in_both, assume_unique=True)
        light = weights == 1
        own = Samples().add(terms[rest & light]).add(terms[~light], weights[~light])
        found.append(own.joined(common).fingerprint())
    return found[0], found[1]


def fingerprint(text: str) -> bytes:
    return weighted_sample(*weighted_terms(text))


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal samples; an empty text is like empty texts alone."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _compared(text: str, own: bytes, edited: str, of_edited: bytes, its: bytes) -> tuple:
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), own, of_edited, likeness(own, of_edited), likeness(own, its)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (binary), near_edited and
    near_next of each row.

    The next row is the one with the next id (null first; ties by the text's hash; after the last the first, which
    may be the row itself). A text's edited form has its last n_chars // 4 code points replaced by as many from the
    next text's start, or all of it. Null texts count as empty; texts without a word have the fingerprint EMPTY,
    which is like itself alone. An empty table gives an empty table; other columns are not looked at.

    Rows are sorted by range once; what crosses a range, one text a range, is settled after.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = columns(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType
    result = [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]]) for x in RESULT.split(", ")]
    id_field = ("doc_id", to_arrow_type(kind))
    full = pa.schema([id_field, *result, ("edge", pa.int32()), ("h", pa.int64()), ("text", pa.string())])
    nothing = (None,) * len(result)

    def within(parts):
        """A row is done when the next is known, and waits for its own successor's fingerprint."""
        first = last = waiting = None
        for batch in parts:
            rows = []
            for doc_id, text, h in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "h")), strict=True):
                if last:
                    edited = _edited(last[1], text)
                    own, of_edited = both_samples(weighted_terms(last[1]), weighted_terms(edited))
                    if waiting:
                        rows.append((waiting[0], *_compared(*waiting[1:], own), 0, None, None))
                    waiting = (last[0], last[1], own, edited, of_edited)
                last = (doc_id, text, h)
                first = first or last
            if rows:
                yield _batch(rows, full)
        if last:
            rows = [(waiting[0], *_compared(*waiting[1:], fingerprint(last[1])), 0, None, None)] if waiting else []
            yield _batch(rows + [(x[0], *nothing, edge, x[2], x[1]) for x, edge in ((first, 1), (last, 2))], full)

    kind_name = kind.simpleString()
    done = stored(docs.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(within, f"doc_id {kind_name}, {RESULT}, edge int, h long, text string"))

    # Of each range the last row (edge 2) and the first row (edge 1) of the next: ids alone are ordered.
    edges = done.where("edge > 0").select("doc_id", "h", "edge", "text")
    order = Window.orderBy("doc_id", "h", "edge")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = F.struct("doc_id", "h")
    after = edges.select("doc_id", "h", "edge").withColumn("next", F.coalesce(F.lead(key).over(order), F.first(key).over(whole))).where("edge = 2")
    e, a, n = edges.where("edge = 2").alias("e"), after.alias("a"), edges.where("edge = 1").alias("n")
    same = F.col("e.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("e.h") == F.col("a.h"))
    follows = F.col("a.next.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("a.next.h") == F.col("n.h"))
    pairs = e.join(a, same).join(n, follows).select("e.doc_id", F.col("e.text").alias("text"), F.col("n.text").alias("after"))
    small = pa.schema([id_field, *result])

    def across(parts):
        for batch in parts:
            rows = []
            for i, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edited = _edited(t, x)
                rows.append((i, *_compared(t, fingerprint(t), edited, fingerprint(edited), fingerprint(x))))
            if rows:
                yield _batch(rows, small)

    return done.where("edge = 0").select("doc_id", *(x for x, _ in result)).unionByName(pairs.mapInArrow(across, f"doc_id {kind_name}, {RESULT}"))
