"""Operator 8: language identification by prediction by partial matching.

Each language has a context tree over bytes: contexts of up to ORDER bytes, with counts of the byte that follows.
A byte costs its share at the longest known context, after the escapes from longer known ones (method C: escape
d / (n + d), where n counts of d different bytes were seen); below the empty context all 256 bytes are alike.
The counts are frozen once trained, so a byte's code length after a known context
is a constant for each language: the trees are laid out as one table from context and byte to the code lengths in
all languages, and a text's exact code lengths are sums of table rows. Bytes beyond the table go down the shorter
contexts in the same way, escapes added.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, batches, columns, slices, small_batches
from .hashing import Table

ORDER = 4
#: Bounds of the labelled rows that the models are fitted on: of a language, and of all together (with more languages
#: than TRAIN_DOCS fit in, each has fewer rows, one at least).
TRAIN_DOCS = 100
TRAIN_ROWS = 2000
UNKNOWN = "und"
#: What stands before a text's first byte.
BEGIN = b" " * ORDER
#: Any character of a word that isn't a digit or an underscore: a cheap first look for letters.
MAYBE_LETTER = re.compile(r"[^\W\d_]")


def _pieces(texts: list[bytes], size: int = SLICE):
    """Lists of (text's number, ORDER bytes before, bytes), some `size` bytes together: long texts come in pieces."""
    held, n = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), size):
            before = text[at - ORDER : at] if at else BEGIN
            held.append((i, before + text[at : at + size]))
            n += len(held[-1][1])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte after the first ORDER of each piece with the ORDER bytes before it, as a number; where each
    piece's end."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    grams = np.zeros(max(0, len(data) - ORDER), np.int64)
    for j in range(ORDER + 1):
        grams = (grams << 8) | data[j : j + len(grams)]
    sizes = np.fromiter((len(x) - ORDER for x in pieces), np.int64, len(pieces))
    keep = np.ones(len(grams), bool)
    gaps = np.cumsum(sizes + ORDER)[:-1] - ORDER
    for j in range(ORDER):
        keep[gaps + j] = False
    return grams[keep], np.cumsum(sizes)


def _tagged(m: int, gram: np.ndarray, context: bool = False) -> np.ndarray:
    """Numbers of m bytes apart from those of other lengths, and contexts from contexts with a byte."""
    return ((m + 8 * context) << 8 * (ORDER + 1)) | gram


class _Tree:
    """One language: for m = 1 to ORDER + 1 the known contexts of m - 1 bytes and those with a byte."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.bits, self.escape = {}, {}
        for m in range(1, ORDER + 2):
            own, at = np.unique(gram & ((1 << 8 * m) - 1), return_inverse=True)
            c = np.bincount(at, count)
            context, where = np.unique(own >> 8, return_inverse=True)
            n, d = np.bincount(where, c), np.bincount(where)
            self.escape[m] = context, -np.log2(d / (n + d))
            self.bits[m] = own, -np.log2(c / (n + d)[where])

    @staticmethod
    def _find(pair: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = pair
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, np.where(hit, values[at], 0.0)

    def escapes(self, context: np.ndarray, m: int) -> np.ndarray:
        return self._find(self.escape[m], context)[1]

    def code_length(self, gram: np.ndarray, m: int) -> np.ndarray:
        """Of the last byte after the m - 1 before it."""
        if m == 0:
            return np.full(len(gram), 8.0)
        hit, bits = self._find(self.bits[m], gram)
        rest = self.escapes(gram >> 8, m) + self.code_length(gram & ((1 << 8 * (m - 1)) - 1), m - 1)
        return np.where(hit, bits, rest)


class Models:
    """The frozen trees of all languages as one table of code lengths."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        trees = [_Tree(*counts[x]) for x in self.names]
        keys, rows = [], []
        for m in range(1, ORDER + 2):
            for part, context in (("bits", False), ("escape", True)):
                own = np.unique(np.concatenate([getattr(t, part)[m][0] for t in trees])) if trees else np.empty(0, np.int64)
                keys.append(_tagged(m, own, context))
                rows.append(np.stack([t.escapes(own, m) if context else t.code_length(own, m) for t in trees], axis=1) if trees else np.empty((0, 0)))
        keys = np.concatenate(keys)
        self.table = Table(keys, np.arange(len(keys), dtype=np.int32), -1)
        self.rows = np.concatenate(rows).astype(np.float32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """In bits: a row for each text, a column for each language."""
        sums = np.zeros((len(texts), len(self.names)))
        for pieces in _pieces(texts):
            grams, ends = _grams([x for _, x in pieces])
            own = np.add.reduceat(self._each(grams), np.r_[0, ends[:-1]], axis=0, dtype=np.float64)
            np.add.at(sums, [i for i, _ in pieces], own)
        return sums

    def _each(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros((len(grams), len(self.names)), np.float32)
        left = np.arange(len(grams))
        for m in range(ORDER + 1, 0, -1):
            own = grams[left] & ((1 << 8 * m) - 1)
            at = self.table.get(_tagged(m, own))
            hit = at >= 0
            total[left[hit]] += self.rows[at[hit]]
            left, own = left[~hit], own[~hit]
            escape = self.table.get(_tagged(m, own >> 8, True))
            known = escape >= 0
            total[left[known]] += self.rows[escape[known]]
        total[left] += np.float32(8.0)
        return total


def has_letter(text: str) -> bool:
    found = MAYBE_LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(unicodedata.category(c)[0] == "L" for c in text))


def _counted(parts):
    for batch in parts:
        own: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own.setdefault(lang, []).append(text.encode())
        for lang, texts in own.items():
            for pieces in _pieces(texts):
                gram, n = np.unique(_grams([x for _, x in pieces])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, rows: int = TRAIN_ROWS
) -> Models:
    """Models of all languages from the whole texts of a bounded sample: the `docs` documents of each language with
    the smallest hash of id and text, `rows` of all languages together (but one of each). Rows with a null text or
    language teach nothing. The table is read twice, however many languages there are: for the hashes, of which
    each task keeps the smallest, and for the sample's texts. The models' size grows with the sample alone."""
    given = columns(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")
    hashed = given.withColumn("h", F.xxhash64("doc_id", "text"))
    first = hashed.select("lang", "h").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= docs)
    hashes = {r["lang"]: sorted(r["hs"]) for r in first.groupBy("lang").agg(F.collect_list("h").alias("hs")).collect()}
    if not hashes:
        return Models({})
    own = max(1, min(docs, rows // len(hashes)))
    # as an Arrow table: of a list Spark makes an RDD that Python workers of another kind have to read, which then stay
    last = pa.table({"lang": pa.array(hashes, pa.string()), "last": pa.array([hs[:own][-1] for hs in hashes.values()], pa.int64())})
    last = labelled.sparkSession.createDataFrame(last)
    sample = hashed.join(F.broadcast(last), "lang").where("h <= last").select("lang", "text")  # a row for each language is sent
    found = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = found.column("lang").combine_chunks().dictionary_encode(), found.column("gram").to_numpy(), found.column("n").to_numpy()
    code = lang.indices.to_numpy()
    order = np.lexsort((gram, code))
    code, gram, n = code[order], gram[order], n[order]
    cuts = np.searchsorted(code, np.arange(len(lang.dictionary) + 1))
    return Models({name: (gram[a:b], n[a:b]) for name, a, b in zip(lang.dictionary.to_pylist(), cuts, cuts[1:], strict=False)})


def predictions(models: Models, texts: pa.Array) -> list[tuple[str, float, float | None]]:
    """(language, score, bits a byte) of each text."""
    found: list = []
    for part in slices(texts):
        for raw, total in zip(part, models.code_lengths(part), strict=True):
            if not models.names or not has_letter(raw.decode()):
                found.append((UNKNOWN, 0.0, None))
                continue
            best = int(total.argmin())
            score = 1 / np.exp2(np.maximum(total[best] - total, -1000.0)).sum()
            found.append((models.names[best], float(score), float(total[best] / len(raw))))
    return found


def identify(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of each row.

    lang_pred has the shortest code length for the whole text (a tie: the first name); score is its
    posterior probability with all languages alike beforehand. Null texts, texts without a letter and
    any text when there is no model are UNKNOWN with score 0. Ids may be null or repeated: a row for
    each row. An empty table gives an empty table; other columns are not looked at.
    """
    docs = columns(df, doc_id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, bits = zip(*predictions(sent.value, batch.column("text")), strict=True) if batch.num_rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
            ["doc_id", "lang_pred", "score", "bits_per_byte"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(docs, lambda: work, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_identified(df: DataFrame, models: Models, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """df's rows, with all their columns, whose language is known with a score of `least` or more: null texts and
    texts without a letter go, and those that two languages explain equally well. Without any model nothing can be
    told and all rows stay. Only texts and verdicts pass through Python."""
    if not models.names:
        return df
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("boolean")
    def identified(texts: pa.Array) -> pa.Array:
        return pa.array([lang != UNKNOWN and score >= least for lang, score, _ in predictions(sent.value, texts)], pa.bool_())

    return df.where(identified(F.col(f"`{text_col}`")))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
