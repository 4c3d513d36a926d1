"""A trie of conversations' common beginnings: burst into containers over Spark, which are sorted and swept into nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, stored

#: Different sequences that a container may hold; a fuller one is burst.
CONTAINER = 256
#: Ids that are joined into one text before they go to the task that hashes them.
JOINED = 1 << 14
#: Rows of a batch that Python gives back.
ROWS = 2048
#: A key stands for all turns up to some depth (128 bits); this one for none.
ROOT = hashlib.md5(b"").digest()


def turn_id(role: str = "role", text: str = "text") -> Column:
    """128 bits that stand for a turn's role and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns (id, size: code points) in order, without texts. Turns of one number come in the order of
    their ids, those without a number first. Null roles and texts are empty; rows without a conv_id belong to no
    conversation."""
    rows = columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text").fillna("", ["role", "text"])
    rows = rows.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.expr("turn IS NOT NULL").alias("numbered"), "turn", turn_id().alias("id"), F.length("text").cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(t)), x -> struct(x.id AS id, x.size AS size))").alias("turns"))


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % block (none if there is none), where h
    is crc32 of c in decimals, modulo `most`, and goes on with its own turns after the first h. No more than `block`
    conversations share a beginning, so this join has no hot key."""
    h = F.expr(f"cast(crc32(cast(cast(conv_id AS string) AS binary)) % {most} AS int)")
    first = turns.where(f"conv_id % {block} = 0").select(F.col("conv_id").alias("base"), F.expr(f"slice(turns, 1, {most - 1})").alias("head"))
    own = turns.withColumn("h", h).withColumn("base", F.expr(f"conv_id - conv_id % {block}"))
    both = F.expr("concat(if(head IS NULL OR h = 0, array(), slice(head, 1, h)), if(size(turns) > h, slice(turns, h + 1, size(turns)), array()))")
    return own.join(first, "base", "left").select("conv_id", both.alias("turns"))


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sequence's keys, one for each depth from 0 on, and the sizes of their last turns."""
    for batch in parts:
        ids, keys, sizes = batch.column("conv_id"), [], []
        for turns in batch.column("turns").to_pylist():
            own = [ROOT]
            for t in turns:
                own.append(hashlib.md5(own[-1] + t["id"]).digest())
            keys.append(own)
            sizes.append([0, *(t["size"] for t in turns)])
        yield pa.record_batch([ids, pa.array([x[-1] for x in keys], pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "last", "keys", "sizes"])


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids that end at one key, each as one text. Rows come sorted by key and id."""
    key, first, held, out = None, None, [], []
    for batch in parts:
        for last, conv_id in zip(batch.column("last").to_pylist(), batch.column("conv_id").to_pylist()):
            if last != key or len(held) == JOINED:
                if held:
                    out.append((key, first, ",".join(held)))
                key, first, held = last, conv_id, []
            held.append(str(conv_id))
            if len(out) == ROWS:
                yield _rows(out, ("last", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))
                out = []
    if held:
        out.append((key, first, ",".join(held)))
    yield _rows(out, ("last", "first", "ids"), (pa.binary(), pa.int64(), pa.string()))


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, which come as texts in order: nothing is held but the hash's state."""
    key, state, out = None, None, []
    for batch in parts:
        for last, ids in zip(batch.column("last").to_pylist(), batch.column("ids").to_pylist()):
            if last != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = last, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
            if len(out) == ROWS:
                yield _rows(out, ("last", "sha"), (pa.binary(), pa.string()))
                out = []
    if state:
        out.append((key, state.hexdigest()))
    yield _rows(out, ("last", "sha"), (pa.binary(), pa.string()))


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))


NODE = "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, above array<binary>"


class _Container:
    """Sequences under one head, fed in order: a stack of open nodes, each added to the one above when it closes."""

    def __init__(self, at: int, keys: list[bytes], sizes: list[int]):
        self.at, self.above, self.last = at, keys[:at], keys[: at + 1]
        self.nodes: list[list] = []
        self.stack: list[int] = []
        self._open(at, keys, sizes)

    def _open(self, depth: int, keys: list[bytes], sizes: list[int]) -> None:
        # key, depth, size, smallest member, members, children, leaves, saved, sequences' copies that end here, node above
        self.nodes.append([keys[depth], depth, sizes[depth], None, 0, 0, 0, 0, 0, self.stack[-1] if self.stack else None])
        self.stack.append(len(self.nodes) - 1)

    def _close(self) -> None:
        x = self.nodes[self.stack.pop()]
        x[6] = x[6] or 1
        x[7] += (x[4] - 1) * x[2]
        if self.stack:
            self._add(self.nodes[self.stack[-1]], x[3], x[4])
            up = self.nodes[self.stack[-1]]
            up[5], up[6], up[7] = up[5] + 1, up[6] + x[6], up[7] + x[7]

    @staticmethod
    def _add(node: list, conv_id: int, copies: int) -> None:
        node[3] = conv_id if node[3] is None else min(node[3], conv_id)
        node[4] += copies

    def feed(self, keys: list[bytes], sizes: list[int], conv_id: int, copies: int) -> None:
        same = self.at
        while same + 1 < min(len(keys), len(self.last)) and keys[same + 1] == self.last[same + 1]:
            same += 1
        while len(self.stack) > same - self.at + 1:
            self._close()
        for depth in range(same + 1, len(keys)):
            self._open(depth, keys, sizes)
        end = self.nodes[self.stack[-1]]
        self._add(end, conv_id, copies)
        end[8], self.last = copies, keys

    def close(self) -> list[tuple]:
        while self.stack:
            self._close()
        return [(x[0], x[1], x[3], None if x[9] is None else self.nodes[x[9]][3], *x[4:9], self.above if x[9] is None else None) for x in self.nodes]


def _swept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers, whose sequences come sorted. Only one container's nodes are held."""
    kinds = (pa.binary(), *[pa.int64()] * 8, pa.list_(pa.binary()))
    names = [x.split()[0] for x in NODE.split(", ")]
    head, held, out = None, None, []
    for batch in parts:
        for r in batch.to_pylist():
            if held is None or r["head"] != head:
                out += held.close() if held else []
                head, held = r["head"], _Container(r["at"], r["keys"], r["sizes"])
                if len(out) >= ROWS:
                    yield _rows(out, names, kinds)
                    out = []
            held.feed(r["keys"], r["sizes"], r["conv_id"], r["copies"])
    yield _rows(out + (held.close() if held else []), names, kinds)


def prefix_trie(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of sequences (conv_id, and turns: array of (id binary, size long)): a row for each different beginning,
    the empty one included, with conv_id (the smallest that begins so), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (over its subtree: sizes of last turns, for each sequence but the first)
    and ends_sha256 (of the ids that end there, in order). conv_ids are different and not null. No sequences: no nodes.

    Equal sequences become one with a number of copies. A beginning that more than `container` different ones share is
    a trie head: its container is burst by the next turn. All heads come from one count of beginnings, not from a round
    for each depth. Each container is sorted and swept in one task; heads sum up what the containers below them give.
    A row holds 24 bytes a turn, no text."""
    convs = stored(sequences.mapInArrow(_keyed, "conv_id long, last binary, keys array<binary>, sizes array<long>"))
    grouped = convs.groupBy("last").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    seqs = stored(grouped)

    # heads: beginnings of too many different sequences
    begun = seqs.select("last", "conv_id", "copies", F.expr("explode(transform(keys, (k, i) -> struct(i AS depth, k AS key, sizes[i] AS size))) AS x"))
    begun = begun.select("last", "conv_id", "copies", "x.*")
    counted = begun.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("last").alias("one"))
    heads = stored(counted.where(F.col("n") > container).drop("n"))

    deepest = begun.join(heads.select("key"), "key").groupBy("last").agg(F.max("depth").alias("under"))
    placed = seqs.join(deepest, "last", "left").withColumn("at", F.expr("cast(coalesce(under + 1, 0) AS long)"))
    held = placed.where("at < size(keys)").withColumn("head", F.expr("keys[cast(at AS int)]"))
    held = held.select("head", "at", "keys", "sizes", "conv_id", "copies").repartition("head").sortWithinPartitions("head", "keys")
    nodes = stored(held.mapInArrow(_swept, NODE))

    # what lies above containers: their tops' sums go to all heads above, a head's own to itself and those above
    tops = nodes.where("above IS NOT NULL AND size(above) > 0")
    paths = heads.join(seqs.select(F.col("last").alias("one"), "keys"), "one").withColumn("own", F.expr("slice(keys, 1, cast(depth AS int) + 1)"))
    gifts = tops.select(F.explode("above").alias("key"), "n_leaves", "saved_tokens")
    gifts = gifts.unionByName(paths.select(F.explode("own").alias("key"), F.lit(0).cast("long").alias("n_leaves"), F.expr("(n_convs - 1) * size").alias("saved_tokens")))
    sums = gifts.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = paths.withColumn("parent", F.expr("if(depth > 0, keys[cast(depth AS int) - 1], null)"))
    below = tops.select(F.element_at("above", -1).alias("key")).unionByName(above.where("parent IS NOT NULL").select(F.col("parent").alias("key"))).groupBy("key").agg(F.count("*").alias("n_children"))
    ended = placed.where("at >= size(keys)").select(F.col("last").alias("key"), F.col("copies").alias("ended"))
    upper = above.join(sums, "key").join(below, "key").join(ended, "key", "left").select("key", F.col("depth").cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ended", F.lit(0)).alias("ended"), "parent")

    rows = nodes.withColumn("parent", F.expr("if(above IS NOT NULL AND size(above) > 0, element_at(above, -1), null)")).drop("above").unionByName(upper)
    hung = rows.where("parent IS NOT NULL").drop("parent_conv_id").join(heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    rows = rows.where("parent IS NULL").unionByName(hung)

    # ids that end at a node: in ranges they become texts, which few rows carry to the task that hashes them
    listed = convs.select("last", "conv_id").join(seqs.where("copies > 1").select("last"), "last", "left_semi")
    listed = listed.repartitionByRange("conv_id").sortWithinPartitions("last", "conv_id").mapInArrow(_joined, "last binary, first long, ids string")
    shas = listed.repartition("last").sortWithinPartitions("last", "first").mapInArrow(_hashed, "last binary, sha string")
    one = F.when(F.col("ended") == 0, F.sha2(F.lit("").cast("binary"), 256))
    simple = rows.where("ended = 0").withColumn("ends_sha256", one)
    # the one sequence that ends at a node of one copy may belong to any of its members
    single = rows.where("ended = 1").join(seqs.where("copies = 1").select(F.col("last").alias("key"), F.col("conv_id").alias("ender")), "key").withColumn("ends_sha256", F.sha2(F.col("ender").cast("string").cast("binary"), 256)).drop("ender")
    several = rows.where("ended > 1").join(shas.withColumnRenamed("last", "key"), "key").withColumnRenamed("sha", "ends_sha256")
    found = simple.unionByName(single).unionByName(several)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """prefix_trie of rebuilt conversations. See turns_of() for nulls and ties; equal rows are turns each. An empty
    table has no nodes; columns beyond conv_id, turn, role and text are not looked at."""
    return prefix_trie(rebuilt(stored(turns_of(conversations))), container)
