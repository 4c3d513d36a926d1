"""Tokens of two tokenizers aligned: inverted bitmaps of documents for each id pair, counted, and scored by posting."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, most_frequent, stored
from .tokens import DOUBTFUL, _byte_of, _ranked, specified, tokenizer

#: Documents of a block, whose bitmaps have a bit for each, and postings after which a block closes earlier.
DOCS = 1 << 16
POSTINGS = 1 << 21
#: Chunks of text that a worker remembers (those met lately, up to twice as many), the longest of them, and links that
#: are counted together.
CHUNKS = 1 << 18
CHUNK = 128
LINKS = 1 << 18
#: Pairs whose scores are sent to every task: those in the most documents. Others are joined.
SENT = 1 << 16
#: Where a text may be cut: nothing that either tokenizer does reaches over such a place.
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")
CUT_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Letters that a stop or comma can be cut from.
LATIN = frozenset(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and c not in "ªº")


class Aligner:
    """Ids of both tokenizers over a chunk of text, and the groups between places where tokens of both end."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.fast = tokenizer(path_a), _ranked(specified(path_a))
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        vocabulary = {i: k for k, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(byte_of[c] for c in k) if all(c in byte_of for c in k) else k.encode() for k in map(vocabulary.get, range(len(vocabulary)))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.spelled = [b"%d%s" % (i, x) for n, y in ((len(self.bytes_a), b"|"), (len(pieces), b";")) for i in range(n) for x in (b",", y)]
        # pieces that hold a space after something else, or a newline, would reach over a cut
        reaching = any(re.search("[^▁]▁", p) for p in pieces)
        self.cut = None if reaching else CUT_SPACE if any("\n" in p for p in pieces) else CUT
        # what is put before a chunk without a space of its own, and the ids that this makes
        self.guard = self.b.encode("\n") if self.cut is CUT else []
        # marks that no piece joins to a letter before them
        joined = any(re.search(f"[{''.join(LATIN)}][.,]", p) for p in pieces)
        self.tails = {} if joined or self.cut is not CUT or self.fast is None else dict(zip(".,", self([".", ","])))

    def chunks(self, text: str) -> list[str]:
        """Parts of space+text that can be encoded each on their own."""
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def _ids_a(self, chunk: str) -> list[int]:
        if self.fast is None or DOUBTFUL.search(chunk):
            return self.a.encode(chunk, add_special_tokens=False).ids
        return self.fast.encode_ordinary(chunk)

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        # the library adds a space in front; where a chunk has none, what the guard makes goes again
        ids = self.b.encode([x[1:] if x[0] == " " else "\n" + x for x in chunks], num_threads=1)
        return [y if x[0] == " " else y[len(self.guard) :] for x, y in zip(chunks, ids)]

    def __call__(self, chunks: list[str]) -> list[tuple[bytes, int, bytes] | None]:
        """Per chunk: its groups as text, the numbers of ids (A's * 2^32 + B's), and its links as 64-bit pairs (A's id *
        2^32 + B's). None where bytes of either differ from the chunk's. Tokens end together where a group ends, and
        only there, so a group has one link: of its last ids."""
        ids_a, ids_b = list(map(self._ids_a, chunks)), self._ids_b(chunks)
        raws = [x.encode() for x in chunks]
        if b"".join(map(self.bytes_a.__getitem__, chain.from_iterable(ids_a))) != (whole := b"".join(raws)) or b"".join(map(self.bytes_b.__getitem__, chain.from_iterable(ids_b))) != whole:
            return [self([x])[0] for x in chunks] if len(chunks) > 1 else [None]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        shared_a, shared_b = ends_b[at] == ends_a, np.zeros(len(b), np.bool_)
        at = at[shared_a]
        shared_b[at] = True
        links = a[shared_a] << 32 | b[at]
        per_chunk = np.searchsorted(ends_a[shared_a], np.cumsum([len(x) for x in raws]), "right").tolist()
        # the text of a group: A's ids, then B's, each with what stands behind it
        order = np.argsort(np.concatenate([2 * (np.cumsum(shared_a) - shared_a), 2 * (np.cumsum(shared_b) - shared_b) + 1]), kind="stable")
        spelled = np.concatenate([2 * a + shared_a, 2 * (b + len(self.bytes_a)) + shared_b])[order].tolist()
        spelled, raw_links, made, k, m = list(map(self.spelled.__getitem__, spelled)), links.tobytes(), [], 0, 0
        for x, y, n in zip(ids_a, ids_b, per_chunk):
            end = k + len(x) + len(y)
            made.append((b"".join(spelled[k:end])[:-1], len(x) << 32 | len(y), raw_links[8 * m : 8 * n]))
            k, m = end, n
        return made


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


def _plain(part: str) -> bool:
    """Whether what a split at spaces gives is a chunk: a word, or a newline and a word."""
    own = part[1:] if part[:1] == "\n" else part
    return own != "" and not own[0].isspace() and not own[-1].isspace()


class Memory:
    """What is known of chunks, of those met lately."""

    def __init__(self, align: Aligner):
        self.align = align
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def text(self, text: str) -> list[tuple[bytes, int, bytes]] | None:
        """The chunks of space+text; None where bytes of either tokenizer differ."""
        # where nothing but single spaces and newlines stand between words, a split at spaces finds the chunks
        parts = text.replace("\n", " \n").split(" ") if self.align.cut is CUT else [" "]
        found = list(map(self.new.get, parts))
        if not all(found) and not self._learn(parts, found):
            parts = [x[1:] if x[0] == " " and x[1:2] != "\n" and _plain(x[1:]) else x for x in self.align.chunks(text)]
            found = list(map(self.new.get, parts))
            self._learn(parts, found, True)
        if len(self.new) > CHUNKS:
            self.old, self.new = self.new, {}
        return found if all(found) else None

    def _learn(self, parts: list[str], found: list, any_form: bool = False) -> bool:
        """Fills the gaps in found; False where a part is no chunk. A word with a stop or comma behind it is made of
        the word's entry and the mark's own, and not kept."""
        new, old, tails, lost, ended = self.new, self.old, self.align.tails, {}, []
        for i, x in enumerate(found):
            if x is None:
                part = parts[i]
                if not any_form and not _plain(part):
                    return False
                if part[-1] in tails and part[-2:-1] in LATIN:
                    ended.append(i)
                    part = part[:-1]
                x = new.get(part) or old.get(part)
                if x is None:
                    lost.setdefault(part, []).append(i)
                else:
                    found[i] = new[part] = x
        if lost:
            # words go with their space
            for (part, at), x in zip(lost.items(), self.align([x if x[0] in " \n" else " " + x for x in lost])):
                for i in at:
                    found[i] = x
                if x and len(part) <= CHUNK:
                    new[part] = x
        for i in ended:
            if found[i]:
                (text, n, links), (text_end, n_end, links_end) = found[i], tails[parts[i][-1]]
                found[i] = (text + b";" + text_end, n + n_end, links + links_end)
        return True


def bitmap(places: np.ndarray, size: int) -> bytes:
    """A set of places below size: sorted 16-bit places or a bit for each, whichever is smaller. The first byte tells."""
    if 16 * len(places) <= size:
        return b"s" + places.astype("<u2").tobytes()
    bits = np.zeros(size, np.bool_)
    bits[places] = True
    return b"d" + np.packbits(bits, bitorder="little").tobytes()


def opened(bits: bytes) -> np.ndarray:
    """The places of a bitmap, ascending."""
    if bits[:1] == b"s":
        return np.frombuffer(bits, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, offset=1), bitorder="little"))


def popcount(bits: bytes) -> int:
    if bits[:1] == b"s":
        return (len(bits) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(bits, np.uint8, offset=1)).sum())


def merged(planes: list[bytes]) -> bytes:
    """The planes' union: all documents of a posting."""
    if len(planes) == 1:
        return planes[0]
    if all(x[:1] == b"s" for x in planes):
        return b"s" + np.unique(np.concatenate([np.frombuffer(x, "<u2", offset=1) for x in planes])).tobytes()
    n = max(len(x) for x in planes if x[:1] == b"d") - 1
    bits = np.zeros(n, np.uint8)
    for x in planes:
        own = np.frombuffer(x, np.uint8, offset=1)
        if x[:1] == b"s":
            at = np.zeros(8 * n, np.bool_)
            at[opened(x)] = True
            own = np.packbits(at, bitorder="little")
        bits[: len(own)] |= own
    return b"d" + bits.tobytes()


class Block:
    """Postings of some documents that follow each other in a task."""

    def __init__(self, number: int):
        self.number, self.docs, self.n = number, 0, 0
        self.pairs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.times.append(times)
        self.places.append(np.full(len(pairs), self.docs, np.uint16))
        self.docs, self.n = self.docs + 1, self.n + len(pairs)

    @property
    def full(self) -> bool:
        return self.docs == DOCS or self.n >= POSTINGS

    def planes(self) -> Iterator[tuple[int, list[bytes]]]:
        """Each pair's documents: plane k has those whose number of links has bit k set."""
        if not self.n:
            return
        pairs = np.concatenate(self.pairs)
        order = np.argsort(pairs, kind="stable")  # documents stay in order
        pairs, places, times = pairs[order], np.concatenate(self.places)[order], np.concatenate(self.times)[order]
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        tops = np.maximum.reduceat(times, starts)
        sparse = places.astype("<u2").tobytes()
        for lo, hi, top in zip(starts.tolist(), [*starts[1:].tolist(), len(pairs)], tops.tolist()):
            if top == 1 and 16 * (hi - lo) <= self.docs:
                yield int(pairs[lo]), [b"s" + sparse[2 * lo : 2 * hi]]
                continue
            own, times_own = places[lo:hi], times[lo:hi]
            yield int(pairs[lo]), [bitmap(own[times_own >> k & 1 == 1], self.docs) for k in range(top.bit_length())]


ROWS = 4096
DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, planes array<binary>"


def _counted(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs and how often they come, counted a bounded part at a time."""
    pairs, times = np.unique(links[:LINKS], return_counts=True)
    for k in range(LINKS, len(links), LINKS):
        own, n_own = np.unique(links[k : k + LINKS], return_counts=True)
        every, inverse = np.unique(np.concatenate([pairs, own]), return_inverse=True)
        pairs, times = every, np.bincount(inverse, np.concatenate([times, n_own])).astype(np.int64)
    return pairs, times


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds, stored once: documents (block, place, doc_id and their numbers), and postings (block, pair:
    A's id * 2^32 + B's, planes: bitmaps over the places of a block). Texts are read in chunks that a worker remembers."""
    rows = columns(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, place int, doc_id {kind}, {DOC}, {POSTING}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = Memory(aligner(path_a, path_b))
        block, first = None, TaskContext.get().partitionId() << 32
        empty = np.empty(0, np.int64)
        for batch in parts:
            ids = batch.column("doc_id")
            out, held_ids, done = [], [], 0

            def flush(to: int) -> pa.RecordBatch:
                n = len(out)
                cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                return pa.record_batch([*cols[:2], ids.slice(done, to - done), *cols[2:], pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary()))], names)

            for at, text in enumerate(batch.column("text")):
                block = block or Block(first)
                text = text.as_py() or ""
                found = know.text(text) if text else None
                if not found:
                    out.append((block.number, block.docs, 0, 0, 0, 0, ""))
                    block.add(empty, empty)
                else:
                    links = np.frombuffer(b"".join([x[2] for x in found]), np.int64)
                    n = sum([x[1] for x in found])
                    sha = hashlib.sha256(b";".join([x[0] for x in found])).hexdigest()
                    out.append((block.number, block.docs, n >> 32, n & 0xFFFFFFFF, len(links), len(links), sha))
                    block.add(*_counted(links))
                if block.full:
                    yield flush(at + 1)
                    out, done = [], at + 1
                    yield from _posted(block)
                    block, first = None, first + 1
            if out:
                yield flush(len(ids))
        if block:
            yield from _posted(block)

    names = ["block", "place", "doc_id", *(x.split()[0] for x in DOC.split(", ")), "pair", "planes"]
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def _posted(block: Block) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            n = len(held)
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string())]
            return pa.record_batch([pa.array([block.number] * n, pa.int64()), *none, pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.list_(pa.binary()))], names)

        for x in block.planes():
            held.append(x)
            size += sum(map(len, x[1]))
            if len(held) == ROWS or size > 1 << 20:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    return stored(rows.mapInArrow(run, schema))


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, n_docs (documents that hold it linked), n_links (how often): popcounts of the union and of each plane."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            planes = batch.column("planes").to_pylist()
            n_docs = [popcount(merged(x)) for x in planes]
            n_links = [sum(popcount(y) << k for k, y in enumerate(x)) for x in planes]
            yield pa.record_batch([batch.column("pair"), pa.array(n_docs, pa.int64()), pa.array(n_links, pa.int64())], ["pair", "n_docs", "n_links"])

    counts = postings.select("pair", "planes").mapInArrow(run, "pair long, n_docs long, n_links long")
    return counts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def _scored(postings: DataFrame) -> DataFrame:
    """block, place, n_best and count_sum, from postings with their pair's n_links and best. Sums of a block's documents
    are given on when the next block comes, so few blocks' sums are held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def made() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.record_batch([pa.array(np.full(len(at), number, np.int64)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["block", "place", "n_best", "count_sum"])

        for batch in parts:
            cols = (batch.column(x).to_pylist() for x in ("block", "planes", "n_links", "best"))
            for block, planes, n_links, is_best in zip(*cols):
                if block != number:
                    if number is not None:
                        yield made()
                    number, best, total = block, np.zeros(DOCS, np.int64), np.zeros(DOCS, np.int64)
                for k, plane in enumerate(planes):
                    at = opened(plane)
                    total[at] += n_links << k
                    if is_best:
                        best[at] += 1 << k
        if number is not None:
            yield made()

    return postings.select("block", "planes", "n_links", "best").mapInArrow(run, "block long, place int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, as in the contract of op11. Null
    and empty texts, and those that either tokenizer does not give back byte by byte, have zeros and an empty
    groups_sha256. Repeated rows and null ids are rows like others; an empty table stays empty; further columns are not
    looked at.

    Texts are read once. Each task makes blocks of postings: for each pair of ids the documents that link it, as
    compressed bitmaps, one for each bit of how often. Popcounts of these are summed to counts over the corpus. Scores
    of the pairs in the most documents are sent to the postings where they lie; other postings are joined with theirs,
    and go by block."""
    made = aligned(docs, path_a, path_b)
    postings, rows = made.where("pair IS NOT NULL").select("block", "pair", "planes"), made.where("pair IS NULL").drop("pair", "planes")
    counts = stored(pair_counts(postings)).withColumn("b", F.expr("pair & 4294967295"))
    # a row for each of B's ids at most: bounded by its vocabulary
    best = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    scores = counts.join(F.broadcast(best), "b").select("pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))
    common = most_frequent(counts, "n_docs", SENT)
    sent = scores.where(common).drop("n_docs")
    here = _scored(postings.join(F.broadcast(sent), "pair"))
    other = postings.join(F.broadcast(sent.select("pair")), "pair", "left_anti").join(scores.where(~common).drop("n_docs"), "pair")
    there = _scored(other.select("block", "planes", "n_links", "best").repartition("block").sortWithinPartitions("block"))
    sums = here.unionByName(there).groupBy("block", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = rows.join(sums, ["block", "place"], "left").fillna(0, ["n_best", "count_sum"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of the vocabularies: id_a, id_b, n_docs, n_links of each pair that any text links."""
    counts = pair_counts(aligned(docs, path_a, path_b).where("pair IS NOT NULL"))
    return counts.select(F.expr("shiftright(pair, 32)").alias("id_a"), F.expr("pair & 4294967295").alias("id_b"), "n_docs", "n_links")
