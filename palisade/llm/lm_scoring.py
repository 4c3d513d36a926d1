"""Log probabilities of texts under a causal self-attention model that all executors train together."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import attention
from .attention import HEAD, WINDOW, Frame, Model, Trainer, packed, unpacked
from .common import columns, mixed, most_frequent, slices, small_batches, stored
from .hashing import SPACE, Table, hashed_words

#: Rounds of training: each window of ids of every training text is trained on in one of them.
ROUNDS = 2
#: Words whose counts are sent to every task: the most frequent. Counts of others are joined.
SENT = 1 << 19
#: Words that a worker remembers (those met lately, up to twice as many); different words, and rare pairs of ids, counted
#: before they are given on; ids whose pairs a task counts in a square table; ids scored at a time; bytes of a
#: long text that are split at a time, and of texts that are read together.
WORDS, HELD, SQUARE, TOKENS, SLICE, READ = 1 << 18, 1 << 18, 2048, 1 << 15, 1 << 20, 1 << 19
#: Rows that trained weights are summed to before the driver takes their mean.
SUMS = 64
_PAIR = 20
#: White space that may stand inside a word.
_ODD = re.compile(r"[^\S ]")
#: Keys of words: a base for the places of ids in a word, and the key of the end.
_BASE, END_KEY = np.uint64(0x9E3779B97F4A7C15), 0


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 1. Rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Vocabulary:
    """Subword ids of lower-cased words, each with a space before it: a text's ids give its words back, as only a word's
    first id begins with a space."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.begins = np.zeros(self.end + 1, np.bool_)
        self.begins[[i for x, i in ranks.items() if x[:1] == b" "]] = True
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # the same of words by their hashes
        self.met: dict[int, bytes] = {}
        self.once: dict[int, bytes] = {}
        self.marks = {x: self._ids(x.decode()) for x in (b".", b",")}

        # keys are made of these: an odd number for each id, and the powers of a base for the places in a word
        self.mixed = mixed(np.arange(1, self.end + 2, dtype=np.uint64)) | np.uint64(1)
        self.powers = np.cumprod(np.full(64, _BASE, np.uint64), dtype=np.uint64)

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.kind).tobytes()

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of words. Together they are one text, which has no white space but what parts them: then nothing that the
        tokenizer does reaches from one to the next, and each word is what stands from one id that begins with a space to
        the next. Words with white space of another kind go one by one."""
        text = " " + b" ".join(words).decode()
        if _ODD.search(text):
            odd = {i for i, w in enumerate(words) if _ODD.search(w.decode())}
            if len(odd) < len(words):
                found = iter(self._encoded([w for i, w in enumerate(words) if i not in odd]))
                return [self._ids(" " + w.decode()) if i in odd else next(found) for i, w in enumerate(words)]
        else:
            ids = np.array(self.encoding.encode_ordinary(text), self.kind)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(words):
                raw, ends = ids.tobytes(), [*(first[1:] * self.kind.itemsize).tolist(), len(ids) * self.kind.itemsize]
                return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]
        return [self._ids(" " + w.decode()) for w in words]

    def _learn(self, words: list[bytes], found: list) -> None:
        new, old, marks, lost = self.new, self.old, self.marks, {}
        for i, x in enumerate(found):
            if x is None:
                word = words[i]
                # a mark after a letter is a piece of its own
                mark = marks.get(word[-1:]) if word[-2:-1].isalpha() else None
                stem = word[:-1] if mark else word
                own = new.get(stem) or old.get(stem)
                if own is None:
                    lost.setdefault(stem, []).append((i, mark or b""))
                else:
                    new[stem], found[i] = own, own + mark if mark else own
                    if mark:
                        new[word] = found[i]
        if lost:
            for (stem, at), own in zip(lost.items(), self._encoded(list(lost))):
                for i, mark in at:
                    found[i] = own + mark
                    if len(stem) <= 64:
                        new[words[i]] = found[i]
                if len(stem) <= 64:
                    new[stem] = own

    def ids(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.new.get, words))
        if not all(found):
            self._learn(words, found)
            if len(self.new) > WORDS:
                self.old, self.new = self.new, {}
        return np.frombuffer(b"".join(found), self.kind)

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Words of a lower-cased text: where they begin, which of its different words each is, the ids of those, and how
        many ids each of those has."""
        words, starts, ends = hashed_words(raw)
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        own = distinct.tolist()
        runs = list(map(self.met.get, own))
        if not all(runs):
            new = [i for i, x in enumerate(runs) if x is None]
            lost = []
            for i in new:
                runs[i] = self.once.get(own[i])
                if runs[i] is None:
                    lost.append(i)
            at = first[lost]
            found = self._encoded([raw[lo:hi] for lo, hi in zip(starts[at].tolist(), ends[at].tolist())]) if lost else []
            for i, x in zip(lost, found):
                runs[i] = x
            self.met.update((own[i], runs[i]) for i in new if len(runs[i]) <= 128)
            if len(self.met) > WORDS:
                self.once, self.met = self.met, {}
        return starts, which, runs, np.fromiter(map(len, runs), np.int64, len(runs)) // self.kind.itemsize

    def texts(self, raws: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of short lower-cased texts; of their different words the ids in a row, and how often each comes in each
        text: text and word together as text * number of words + word, one for each word as it comes."""
        starts, which, runs, sizes = self.read(b" ".join(raws))
        ids = np.frombuffer(b"".join(runs), self.kind)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat((np.cumsum(sizes) - sizes)[which] - ends + lengths, lengths)
        whole = ids[at]
        texts = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1))
        cuts = np.concatenate([[0], ends])[texts]
        return np.split(whole, cuts[:-1]), ids, np.repeat(np.arange(len(raws)), np.diff(texts, prepend=0)) * max(1, len(runs)) + which

    def keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """63 bits for each word of runs of ids, made of its ids and their order, never END_KEY; and where words begin."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.flatnonzero(self.begins[ids])
        sizes = np.diff(np.append(first, len(ids)))
        place = np.arange(len(ids)) - np.repeat(first, sizes)
        if sizes.max() > len(self.powers):
            self.powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64), dtype=np.uint64)
        sums = np.add.reduceat(self.mixed[ids] * self.powers[place], first)
        return (mixed(sums) >> np.uint64(1)).astype(np.int64) | 1, first


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def split(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased (A-Z), a bounded part at a time. bytes.split() parts at just the contract's spaces."""
    if len(text) <= SLICE:
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


class _Pairs:
    """Counts of ids next to each other: those of the first SQUARE - 1 ids that a task meets in a square table, others
    sorted."""

    def __init__(self, size: int):
        self.slot, self.ids, self.table = np.zeros(size, np.int32), [-1], np.zeros((SQUARE, SQUARE), np.int32)
        self.rest: list[np.ndarray] = []
        self.n = 0

    def add(self, chain: np.ndarray) -> None:
        slots = self.slot[chain]
        if not slots.all() and len(self.ids) < SQUARE:
            fresh = np.unique(chain[slots == 0])[: SQUARE - len(self.ids)]
            self.slot[fresh] = np.arange(len(self.ids), len(self.ids) + len(fresh))
            self.ids += fresh.tolist()
            slots = self.slot[chain]
        a, b = slots[:-1], slots[1:]
        # places and the one that is added are of the kinds that need no conversion one by one
        np.add.at(self.table.reshape(-1), a.astype(np.intp) * SQUARE + b, np.int32(1))
        lost = np.flatnonzero((a == 0) | (b == 0))
        if len(lost):
            self.rest.append(chain[lost].astype(np.int64) << _PAIR | chain[lost + 1])
            self.n += len(lost)

    def given(self, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.n >= least:
            yield np.unique(np.concatenate(self.rest), return_counts=True)
            self.rest, self.n = [], 0

    def square(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = np.array(self.ids, np.int64)
        for a in range(1, len(ids), 64):
            rows, b = np.nonzero(self.table[a : a + 64, 1:])
            if len(b):
                yield ids[a + rows] << _PAIR | ids[b + 1], self.table[a + rows, b + 1].astype(np.int64)


def encoded(docs: DataFrame, path: str, held: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Texts read and split once, stored: rows of documents (row, doc_id, held, ids as bytes), and of what tasks count in
    those not held (kind 0: words by key, the end included; kind 1: ids next to each other, before * 2^20 + after; key,
    n). Null texts are empty; held keeps a document from the counts, and from training."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(held if held is not None else F.lit(False), F.lit(False)).alias("held"), F.col("`text`").alias("text"))
    rows = columns(rows, doc_id="doc_id", held="held", text="text")
    names = ["row", "doc_id", "held", "ids", "kind", "key", "n"]
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, held boolean, ids binary, kind int, key long, n long"
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def counts(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            own, m = keys[k : k + (1 << 16)], n[k : k + (1 << 16)]
            none = [pa.nulls(len(own), t) for t in (pa.int64(), id_type, pa.bool_(), pa.binary())]
            yield pa.record_batch([*none, pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(m)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, row, ends = vocabulary(path), TaskContext.get().partitionId() << 40, 0
        pairs, end, held_words, size = _Pairs(know.end + 1), np.array([know.end], know.kind), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([x for x, _ in held_words]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held_words]), len(keys)).astype(np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            if held_words:
                yield from counts(0, *summed())
            held_words.clear()

        def read(raws: list[bytes], counted: np.ndarray) -> list[np.ndarray]:
            """Ids of texts; the words of those that are counted are."""
            nonlocal size
            found, ids, of = know.texts(raws)
            keys, _ = know.keys(ids)
            if len(keys):
                n = np.bincount(of[counted[of // len(keys)]] % len(keys), minlength=len(keys))
                held_words.append((keys[n > 0], n[n > 0]))
                size += len(held_words[-1][0])
            return found

        for batch in parts:
            made, counted = [], ~np.array(batch.column("held").to_pylist(), bool)
            for raws in slices(batch.column("text"), READ):
                own = counted[len(made) : len(made) + len(raws)]
                found = read([x.lower() if len(x) <= SLICE else b"" for x in raws], own)
                for i, x in enumerate(raws):
                    if len(x) > SLICE:
                        found[i] = np.concatenate([read([b" ".join(part)], own[i : i + 1])[0] for part in split(x)])
                if own.any():
                    # an end stands before each text and after the last
                    pairs.add(np.concatenate([end, *(x for ids, is_own in zip(found, own.tolist()) if is_own for x in (ids, end))]))
                    ends += int(own.sum())
                made += [x.tobytes() for x in found]
                if size > HELD:
                    held_words[:] = [summed()]
                    size = len(held_words[0][0])
                    if size > HELD // 2:
                        yield from flushed()
                        size = 0
                for part in pairs.given(HELD):
                    yield from counts(1, *part)
            n = len(made)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.record_batch([pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held"), pa.array(made, pa.binary()), *none], names)
            row += n
        yield from flushed()
        if ends:
            yield from counts(0, np.array([END_KEY]), np.array([ends]))
        for found in chain(pairs.given(), pairs.square()):
            yield from counts(1, *found)

    return stored(rows.mapInArrow(run, schema))


def _frame(counts: DataFrame, path: str) -> Frame:
    """Tables of the model from counts of pairs. What the driver gets has a row for each id, then one for each two
    leaves at most, whatever the corpus."""
    spark, pairs = counts.sparkSession, counts.where("kind = 1")
    end = vocabulary(path).end
    unigrams = np.zeros(end + 1)
    seen = pairs.groupBy(F.expr(f"key % {1 << _PAIR}").alias("id")).agg(F.sum("n").alias("n")).toArrow()
    unigrams[seen.column("id").to_numpy()] = seen.column("n").to_numpy()
    frame = Frame(unigrams, end)
    own = np.flatnonzero(frame.leaf_of < HEAD - 1)
    leaves = spark.createDataFrame(pa.table({"id": pa.array(own, pa.int64()), "leaf": pa.array(frame.leaf_of[own], pa.int32())}))
    for name, id in (("a", f"key div {1 << _PAIR}"), ("b", f"key % {1 << _PAIR}")):
        pairs = pairs.join(F.broadcast(leaves.withColumnRenamed("leaf", name)), F.expr(id) == F.col("id"), "left").drop("id").fillna(HEAD - 1, [name])
    met = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    frame.fit(*(met.column(x).to_numpy() for x in ("a", "b", "n")))
    return frame


def _round_of(windows: np.ndarray, seed: int) -> np.ndarray:
    return (windows * 2654435761 + seed >> 12) % ROUNDS


def _round(docs: DataFrame, path: str, frame, weights: np.ndarray, nth: int) -> tuple[np.ndarray, int]:
    """One round: each task trains on its own texts from the same weights; their mean, by windows, is the next. And how
    many windows there were."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, own = vocabulary(path), Trainer(Model(frame.value, unpacked(sent.value)))
        leaf_of, end = frame.value.leaf_of, np.array([know.end], know.kind)
        for batch in parts:
            for ids in batch.column("ids"):
                ids = ids.as_py()
                # which round a window is taken in follows from the text alone
                seed, ids = zlib.crc32(ids), np.concatenate([end, np.frombuffer(ids, know.kind), end])
                windows = np.arange(-(-(len(ids) - 1) // WINDOW))
                own.feed_windows(leaf_of[ids], np.flatnonzero(_round_of(windows, seed) == nth))
        own.step()
        if own.windows:
            flat = packed(own.model.w) * np.float64(own.windows)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([own.windows], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["slot", "n", "weights"])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat = 0, np.zeros(len(sent.value))
        for batch in parts:
            for more, own in zip(batch.column("n").to_pylist(), batch.column("weights")):
                n, flat = n + more, flat + np.frombuffer(own.as_py(), np.float64)
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "weights"])

    trained = docs.select("ids").mapInArrow(run, "slot int, n long, weights binary").repartition(SUMS, "slot")
    sums = trained.select("n", "weights").mapInArrow(total, "n long, weights binary").collect()
    n = sum(r["n"] for r in sums)
    return sum((np.frombuffer(r["weights"], np.float64) for r in sums), np.zeros(len(weights))) / n if n else weights, n


@dataclass
class LanguageModel:
    """A trained model. counts: stored counts of the corpus; tokens and distinct: of its words, ends included; windows: how
    many it was trained on."""

    path: str
    frame: Frame
    weights: np.ndarray
    counts: DataFrame
    tokens: int
    distinct: int
    windows: int = 0


def train(texts: DataFrame, path: str) -> LanguageModel:
    """From encoded texts. Counts cover all that are not held, and all their windows are
    trained on, each in one round."""
    counted = texts.where("kind IS NOT NULL").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stored(counted)
    tokens, distinct = counts.where("kind = 0").agg(F.sum("n"), F.count("*")).first()
    frame, weights = _frame(counts, path), packed(attention.initial())
    sent = texts.sparkSession.sparkContext.broadcast(frame)
    windows = 0
    for nth in range(ROUNDS):
        weights, n = _round(texts.where("kind IS NULL AND NOT held"), path, sent, weights, nth)
        windows += n
    return LanguageModel(path, frame, weights.astype(np.float32), counts, tokens or 0, distinct, windows)


def score(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document of encoded texts: doc_id, held, n_tokens (words and the end), n_known (those that training has),
    train_tokens, base_score (log10, words by their counts) and score (log10 probability of the text's subword ids under
    the model, the end included). Null and repeated ids are rows like others; an empty table stays empty."""
    spark, path = texts.sparkSession, model.path
    words = model.counts.where("kind = 0").select("key", "n")
    divisor = model.tokens + 0.5 * (model.distinct + 1)
    common = most_frequent(words, "n", SENT)
    known = words.where(common).toArrow()  # SENT rows at most
    table = Table(known.column("key").to_numpy(), np.log10((known.column("n").to_numpy() + 0.5) / divisor), np.nan)
    sent = spark.sparkContext.broadcast((model.frame, model.weights, table))
    rows = texts.where("kind IS NULL").select("row", "doc_id", "held", "ids")
    names = ["row", "doc_id", "held", "n_tokens", "n_known", "base_score", "score", "key", "n"]
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, held boolean, n_tokens long, n_known long, base_score double, score double, key long, n long"
    small_batches(spark)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, weights, table = sent.value
        know, lm = vocabulary(path), Model(frame, unpacked(weights))
        end, end_key = np.array([know.end], know.kind), np.array([END_KEY], np.int64)
        end_log = float(table.get(end_key)[0])

        def told(batch: pa.RecordBatch, lo: int, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Documents from place lo of a batch, and their words that the table doesn't have."""
            n, own = len(texts), batch.slice(lo, len(texts))
            keys, first = know.keys(np.concatenate(texts))
            logs, of = table.get(keys), np.searchsorted(np.cumsum([len(x) for x in texts]), first, "right")
            lost = np.isnan(logs)
            base = np.bincount(of, np.where(lost, 0, logs), n)
            known, words = np.bincount(of, ~lost, n).astype(np.int64), np.bincount(of, minlength=n)
            if np.isnan(end_log):
                rare_of, rare = np.append(of[lost], np.arange(n)), np.append(keys[lost], np.full(n, END_KEY))
            else:
                base, known, rare_of, rare = base + end_log, known + 1, of[lost], keys[lost]
            scores = lm.score([np.concatenate([x, end]) for x in texts])
            none = [pa.nulls(n, pa.int64())] * 2
            yield pa.record_batch([*(own.column(x) for x in names[:3]), pa.array(words + 1), pa.array(known), pa.array(base), pa.array(scores), *none], names)
            if len(rare):
                order = np.lexsort((rare, rare_of))
                rare_of, rare = rare_of[order], rare[order]
                starts = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])])
                at = own.column("row").to_numpy()[rare_of[starts]]
                none = [pa.nulls(len(at), t) for t in (batch.column("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.record_batch([pa.array(at), *none, pa.array(rare[starts]), pa.array(np.diff(np.append(starts, len(rare))))], names)

        for batch in parts:
            held, size, lo = [], 0, 0
            for i, ids in enumerate(batch.column("ids")):
                held.append(np.frombuffer(ids.as_py(), know.kind))
                size += len(held[-1])
                if size > TOKENS:
                    yield from told(batch, lo, held)
                    held, size, lo = [], 0, i + 1
            if held:
                yield from told(batch, lo, held)

    made = stored(rows.mapInArrow(run, schema))
    # counts of words that few texts have meet those texts' rows
    rare = made.where("key IS NOT NULL").select("row", "key", "n").join(words.where(~common).withColumnRenamed("n", "c"), "key", "left").fillna(0, ["c"])
    rare = rare.groupBy("row").agg(F.sum(F.expr("if(c > 0, n, 0)")).alias("more"), F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(float(divisor)))).alias("rest"))
    found = made.where("key IS NULL").drop("key", "n").join(rare, "row", "left").fillna(0, ["more", "rest"])
    return found.select("doc_id", "held", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("rest")).alias("base_score"), "score")


def score_texts(docs: DataFrame, path: str, held: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """score() of a table's texts, by a model of those that are not held."""
    texts = encoded(docs, path, held, id_col)
    return score(texts, train(texts, path))
