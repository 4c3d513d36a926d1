"""Operator 6: exact n-gram Jaccard join through a token-group matrix.

1. Sets: every text becomes its set of shingle hashes once, stored with the set's identity; equal sets are one node
   throughout. Shingles that many sets of a task hold are counted, and the most frequent of all, a table of fixed size,
   come last in the order of shingles; all others come first, by hash.
2. Prefixes: sets with similarity >= s share a shingle among the first n - ceil(s * n) + 1 of each, in any
   common order. Only prefixes are shuffled, and of those only shingles that several sets hold go on.
3. Groups: in two rounds each set is compared with one other, which shares its prefix shingles most often: the leader
   of a shingle, then a set of the largest group around it. Verified links make groups of similar sets; large
   groups are dealt into groups of some CHUNK sets.
4. Token-group matrix: the union of each group's shingles is stored, and for each prefix shingle that groups share,
   which groups hold it in sets of which size, and how near the start. A set and a group meet by shingle
   and band of sizes, and only where sizes and places allow the similarity.
5. The overlap of set and union bounds the similarity with all of the group's sets. Only groups that the bound lets
   in are opened, and their sets compared one by one up to the first link, as all of a group's sets are connected
   already. Nothing is lost: links between groups are all found, links within groups are known.

No step makes all pairs of a group. What many sets hold in common is dealt by salt: rows of frequent shingles, sets
of large groups, queries of groups that many sets ask for.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, likely, most_frequent, slices, stored
from .graph import components
from .hashing import Table
from .shingles import WIDTH, shingles

#: Shingles whose frequency is known to all tasks: the table's bound.
FREQUENT = 1 << 20
#: Shingles that a task counts together, and how many sets of those have to hold one for it to count.
COUNTED = 2_000_000
OFTEN = 2
#: Sets that a task knows to have met.
SEEN = 100_000
#: Sets of a group that are opened together, and queries that are held against them together.
CHUNK = 128
QUERIES = 512
#: Shingles of this magnitude or more are dealt to several tasks.
HOT = 12
#: Keys with many rows that are sent to all tasks at most.
SENT = 1_000_000


def _node(own: np.ndarray) -> tuple[int, int]:
    """A set's identity: the 128-bit hash of its sorted shingles, in two signed parts."""
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist())


MADE = "n_shingles long, node long, check long, shingles binary, token long, times long"


def _sets(parts, width, kind):
    """A row for each text, with the set itself where it is new to the task, and rows of shingles met often."""
    seen: set = set()
    held: list[np.ndarray] = []
    n = 0
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["doc_id", *(x.split()[0] for x in MADE.split(", "))]

    def often():
        every = np.concatenate(held)
        held.clear()
        every.sort()
        # most occur once: they go before anything as long as the array is made of it
        same = every[1:] == every[:-1]
        some = np.zeros(len(every), bool)
        some[1:] |= same
        some[:-1] |= same
        values, times = np.unique(every[some], return_counts=True)
        values, times = values[times >= OFTEN], times[times >= OFTEN]
        none = [pa.nulls(len(values), t) for t in types[:5]]
        return pa.RecordBatch.from_arrays([*none, pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], names)

    for batch in parts:
        at = 0
        for texts in slices(batch.column("text")):
            rows = []
            for raw in texts:
                own = shingles(raw, width)
                if not len(own):
                    rows.append((0, None, None, None))
                    continue
                node = _node(own)
                both = node[0] << 64 ^ node[1]
                new = both not in seen
                if new:
                    seen.add(both)
                    held.append(own)
                    n += len(own)
                rows.append((len(own), *node, own.tobytes() if new else None))
            if len(seen) > SEEN:
                seen.clear()
            ids = batch.column("doc_id").slice(at, len(rows))
            at += len(rows)
            values = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types[1:5], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *values, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names)
            if n > COUNTED:
                yield often()
                n = 0
    if held:
        yield often()


def _told_apart(made: DataFrame) -> DataFrame:
    """made with nodes that stand for one set each: a node that two sets share is made anew for all but one."""
    shared = made.where("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b")
    shared = stored(shared.select("node", "a"))
    if shared.limit(1).count() == 0:
        return made
    other = F.when(F.col("check") > F.col("a"), F.xxhash64("check", "node")).otherwise(F.col("node"))
    return made.join(shared, "node", "left").withColumn("node", F.coalesce(other, F.col("node"))).select(made.columns)


def _needed(n, share: float):
    """The least overlap with anything similar: ceil(share * n), exactly for hundredths."""
    return -(-n * round(share * 100) // 100)


def _unpacked(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _prefixes(parts, table, share):
    """A row for each prefix shingle of each set: its magnitude and 56 bits of its hash as token."""
    levels = table.value
    for batch in parts:
        tokens, nodes, sizes, places, salts = [], [], [], [], []
        for node, own in zip(batch.column("node").to_pylist(), map(_unpacked, batch.column("shingles")), strict=True):
            n = len(own)
            level = levels.get((own >> np.uint64(1)).astype(np.int64)).astype(np.uint64)
            first = np.sort((level << np.uint64(56)) | (own >> np.uint64(8)))[: n - _needed(n, share) + 1]
            tokens.append(first)
            nodes.append(np.full(len(first), node, np.int64))
            sizes.append(np.full(len(first), n, np.int32))
            places.append(np.arange(len(first), dtype=np.int32))
            deal = np.uint64(1) << np.maximum(first >> np.uint64(56), np.uint64(HOT)) - np.uint64(HOT)
            salts.append((np.uint64(node & 0xFFFFFFFFFFFFFFFF) % deal).astype(np.int32))
        if tokens:
            tokens = np.concatenate(tokens).astype(np.int64)
            rest = map(np.concatenate, (nodes, sizes, places, salts))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, *rest)], ["token", "node", "n", "place", "salt"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


UNIT = ["goal", "chunk", "part"]


def _meetings(parts):
    """From rows (goal, chunk, part, asks, node, shingles) sorted by unit, those that don't ask first: for each row that
    asks its unit, node and set, and the unit's other nodes and sets."""
    unit, nodes, sets = None, [], []
    for batch in parts:
        values = (batch.column(x).to_pylist() for x in (*UNIT, "asks", "node"))
        for *at, asks, node, own in zip(*values, map(_unpacked, batch.column("shingles")), strict=True):
            if at != unit:
                unit, nodes, sets = at, [], []
            if asks:
                yield unit, node, own, nodes, sets
            elif not nodes or nodes[-1] != node:
                # a set that several tasks have seen comes several times
                nodes.append(node)
                sets.append(own)


def _rows(found, types, names, most=10_000):
    """Rows in batches of `most`."""
    held = []
    for row in found:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _bounded(parts, percent):
    """Queries (goal, chunk, part, node) that the group's union lets in; a group of one set is settled here, its set
    being the union: `one` is the link."""

    def found():
        for unit, node, own, nodes, sets in _meetings(parts):
            # the union is the unit's only row: its node tells the set, if there is but one
            if nodes[0] is not None:
                if _linked(own, sets[0], percent):
                    yield (*unit, node, nodes[0])
            elif 100 * _overlap(own, sets[0]) >= percent * len(own):
                yield (*unit, node, None)

    yield from _rows(found(), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], [*UNIT, "node", "one"])


def _opened(parts, percent):
    """The first link of each query among its unit's sets."""

    def found():
        for _, node, own, nodes, sets in _meetings(parts):
            hit = next((other for other, its in zip(nodes, sets, strict=True) if _linked(own, its, percent)), None)
            if hit is not None:
                yield node, hit

    yield from _rows(found(), [pa.int64(), pa.int64()], ["a", "b"])


def _unions(parts):
    """From rows (goal, chunk, node, shingles) sorted by group: the group's sorted shingles, and its node if it has
    one alone."""

    def whole(group, nodes, sets):
        return (*group, next(iter(nodes)) if len(nodes) == 1 else None, (sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))).tobytes())

    def found():
        group, nodes, sets = None, set(), []
        for batch in parts:
            for goal, chunk, node, own in zip(*(batch.column(x).to_pylist() for x in ("goal", "chunk", "node")), map(_unpacked, batch.column("shingles")), strict=True):
                if (goal, chunk) != group:
                    if sets:
                        yield whole(group, nodes, sets)
                    group, nodes, sets = (goal, chunk), set(), []
                if node not in nodes:
                    nodes.add(node)
                    sets.append(own)
        if sets:
            yield whole(group, nodes, sets)

    yield from _rows(found(), [pa.int64(), pa.int32(), pa.int64(), pa.binary()], ["goal", "chunk", "node", "shingles"], 100)


def _counted(rows: DataFrame, key: str | list[str], per: int) -> DataFrame:
    """rows with `parts`: how many parts of `per` rows or so all rows with their key make. Only keys with several are
    looked up; they are at most one for each `per` rows, and sent to all tasks up to SENT."""
    key = [key] if isinstance(key, str) else key
    big = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > per).select(*key, F.ceil(F.col("n") / per).cast("int").alias("parts"))
    big = stored(big)
    few = big.count() <= SENT
    return rows.join(F.broadcast(big) if few else big, key, "left").na.fill({"parts": 1})


class _Sets:
    """The stored sets by node."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (with node) and their shingles; sets of no row are turned away before the join."""
        rows = stored(rows)
        return rows.join(likely(self.sets, "node", rows.select("node").distinct()), "node")

    def _met(self, rows: DataFrame, work, schema: str) -> DataFrame:
        ordered = rows.select(*UNIT, "asks", "node", "shingles").repartition(*UNIT).sortWithinPartitions(*UNIT, "asks", "node")
        return ordered.mapInArrow(partial(work, percent=self.percent), schema)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = _counted(stored(pairs.select("a", F.col("b").alias("goal"))), "goal", QUERIES)
        asking = pairs.select("goal", F.pmod(F.hash("a"), "parts").alias("part"), F.lit(True).alias("asks"), F.col("a").alias("node"))
        asked = asking.select("goal", "part", F.lit(False).alias("asks"), F.col("goal").alias("node")).distinct()
        units = asking.unionByName(asked).withColumn("chunk", F.lit(0))
        return stored(self._met(self.of(units), _opened, "a long, b long"))

    def opened(self, candidates: DataFrame, members: DataFrame) -> DataFrame:
        """Verified links of candidates (node, goal, chunk) into groups, members (node, goal, chunk)."""
        group = ["goal", "chunk"]
        asking = stored(_counted(candidates, group, QUERIES).select(*group, F.pmod(F.hash("node"), "parts").alias("part"), F.lit(True).alias("asks"), "node"))
        units = stored(asking.select(*UNIT).distinct())
        members = stored(members.join(units.select(*group).distinct(), group, "left_semi"))
        unions = self.of(members).select(*group, "node", "shingles").repartition(*group).sortWithinPartitions(*group, "node")
        unions = stored(unions.mapInArrow(_unions, "goal long, chunk int, node long, shingles binary"))
        bounds = unions.join(units, group).withColumn("asks", F.lit(False)).unionByName(self.of(asking))
        let_in = stored(self._met(bounds, _bounded, "goal long, chunk int, part int, node long, one long"))
        settled = let_in.where("one IS NOT NULL").select(F.col("node").alias("a"), F.col("one").alias("b"))
        let_in = let_in.where("one IS NULL").select(*UNIT, F.lit(True).alias("asks"), "node")
        inside = members.join(let_in.select(*UNIT).distinct(), group).select(*UNIT, F.lit(False).alias("asks"), "node")
        return stored(settled.unionByName(self._met(self.of(inside.unionByName(let_in)), _opened, "a long, b long")))


def join_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: float = 0.75) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each row.

    Rows link when their sets of distinct shingles have Jaccard similarity >= share (whole hundredths).
    Texts without a word, empty and null ones have an empty set and link with nothing: their component is
    their own id. Rows with equal sets are one class, repeated ids or not. A row without an id has its class's
    component, or null if none of the class has an id. An empty table gives an empty table; other columns
    are not looked at.
    """
    docs = columns(df, doc_id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind, percent = docs.schema["doc_id"].dataType, round(share * 100)
    made = stored(docs.mapInArrow(partial(_sets, width=width, kind=to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {MADE}"))
    often = stored(made.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")))
    made = _told_apart(made.where("token IS NULL"))
    known = made.select("doc_id", "n_shingles", "node")
    sets = _Sets(made.where("shingles IS NOT NULL").select("node", "shingles"), percent)
    shared = _shared(sets.sets, often, share)

    # Of the prefix, the part that two sets have to share to be compared: a guess, as comparing is no condition.
    enough = 2 * F.col("times") >= F.col("n") - F.ceil(F.col("n") * share)
    # Round one: sets and leaders.
    met = shared.where("node <> leader").groupBy("node", F.col("leader").alias("other"), "n").agg(F.count("*").alias("times"))
    found = sets.verified(_best(met.where(enough)))
    held = _straddling(shared.drop("leader"), components(found))
    # Round two: sets and a set of the largest group around them.
    met = held.where("goal <> top").groupBy("node", F.col("top_node").alias("other"), "n").agg(F.count("*").alias("times"))
    found = found.unionByName(sets.verified(_best(met.where(enough))))
    grouped = components(found)
    held = _straddling(held.select("token", "node", "n", "place"), grouped)

    candidates = stored(_candidates(held, percent))
    members = _chunked(grouped).select("node", "goal", "chunk")
    alone = candidates.select(F.col("goal").alias("node")).distinct().join(grouped, "node", "left_anti").select("node", F.col("node").alias("goal"), F.lit(0).alias("chunk"))
    whole = components(found.unionByName(sets.opened(candidates, members.unionByName(alone))))

    named = known.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.where("node IS NOT NULL").groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return named.join(least, named["component"] == least["of"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _shared(sets: DataFrame, often: DataFrame, share: float) -> DataFrame:
    """token, node, n, place, leader: prefix shingles that several sets hold. The leader of a shingle is the set that
    has it earliest in its order: it has the fewest shingles of its own, as the original of a family of copies does."""
    frequent = often.where(most_frequent(often, "times", FREQUENT)).toArrow()
    # 63 bits of the hash are the key
    key, times = (frequent.column(x).to_numpy() for x in ("token", "times"))
    key, level = (key.view(np.uint64) >> np.uint64(1)).astype(np.int64), np.log2(times).astype(np.uint8) if len(times) else np.zeros(0, np.uint8)
    key, first = np.unique(key, return_index=True)
    levels = sets.sparkSession.sparkContext.broadcast(Table(key, level[first], 0))
    rows = sets.mapInArrow(partial(_prefixes, table=levels, share=share), "token long, node long, n int, place int, salt int")
    alike = Window.partitionBy("token", "salt")
    return stored(
        rows.withColumn("leader", F.min_by("node", "place").over(alike))
        .withColumn("least", F.min("node").over(alike))
        .withColumn("last", F.max("node").over(alike))
        .where((F.col("least") < F.col("last")) | (F.shiftright("token", 56) > HOT))
        .select("token", "node", "n", "place", "leader")
        .dropDuplicates(["token", "node"])
    )


def _best(met: DataFrame) -> DataFrame:
    """a, b: the other that a node meets most often."""
    return met.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("times", "other")).alias("best")).select("a", F.col("best.other").alias("b"))


def _chunked(grouped: DataFrame) -> DataFrame:
    """node, goal, chunk and chunks from grouped (node, component): large groups are dealt by hash into groups of CHUNK
    sets or so."""
    dealt = _counted(grouped.withColumnRenamed("component", "goal"), "goal", CHUNK)
    return dealt.select("node", "goal", F.pmod(F.hash("node", F.lit(1)), "parts").alias("chunk"), F.col("parts").alias("chunks"))


def _deal(most: int = 10) -> Column:
    """How many tasks a shingle's rows are dealt to: several where it is frequent."""
    level = F.greatest(F.shiftright("token", 56) - HOT, F.lit(0))
    return F.pow(F.lit(2.0), F.least(level, F.lit(most))).cast("int")


def _straddling(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """rows (token, node, n, place) whose token several groups hold, with the group (goal, the node itself if it has
    none), its chunk and how many it has, and the token's largest group (top) with one of its nodes."""
    held = rows.join(_chunked(grouped), "node", "left").withColumn("goal", F.coalesce("goal", "node")).na.fill({"chunk": 0, "chunks": 0})
    held = stored(held.withColumn("salt", F.pmod(F.hash("node"), _deal())))
    tokens = held.groupBy("token").agg(F.min("goal").alias("a"), F.max("goal").alias("b"), F.max(F.struct("chunks", "goal", -F.col("place"), "node")).alias("t"))
    tokens = tokens.where("a < b").select("token", F.col("t.goal").alias("top"), F.col("t.node").alias("top_node"))
    tokens = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), _deal() - 1)))
    return stored(held.join(tokens, ["token", "salt"]).drop("salt"))


def _band(n: Column) -> Column:
    """Sets that can link are in the same band of sizes or in neighbouring ones, at shares down to 0.5."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _candidates(held: DataFrame, percent: int) -> DataFrame:
    """node, goal, chunk: sets and groups that the matrix lets meet, the larger group being asked.

    Sets of n and m shingles link only if overlap >= percent / (100 + percent) * (n + m). A set and a group are let
    through by two bounds. At their first common shingle the overlap is at most n - place on either side: so a place
    bounds the sizes that can be met through it, and rows meet by shingle and band of sizes; frequent shingles
    are dealt by salt. And what two prefixes have in common, with all that comes after the prefix that ends first, is
    the most that the sets can have in common: so sizes ask for a number of shingles, which are then counted."""
    all_ = 100 + percent
    deal = _deal()
    reach = F.max(all_ * (F.col("n") - F.col("place")) - percent * F.col("n"))
    matrix = held.groupBy("token", F.col("goal").alias("other"), F.col("chunk").alias("other_chunk"), _band(F.col("n")).alias("band")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), reach.alias("reach"), F.max("chunks").alias("other_chunks")
    )
    matrix = stored(matrix)
    # the sizes that can be met at all, and up to which here
    low, high = F.ceil(percent * F.col("n") / 100), F.floor(100 * F.col("n") / percent)
    here = F.floor((all_ * (F.col("n") - F.col("place")) - percent * F.col("n")) / percent)
    asking = held.select("token", "node", "n", "goal", "chunks", low.alias("low"), F.least(high, here).alias("here")).where("low <= here")
    asking = asking.withColumn("band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("here"))))).withColumn("deal", F.pmod(F.hash("node"), deal))
    smaller = F.struct(F.col("chunks"), F.col("goal")) < F.struct(F.col("other_chunks"), F.col("other"))
    near = (F.col("least") <= F.col("here")) & (F.col("most") >= F.col("low")) & (F.col("reach") >= percent * F.col("n"))
    dealt = matrix.withColumn("deal", F.explode(F.sequence(F.lit(0), deal - 1)))
    group = [F.col("other").alias("goal"), F.col("other_chunk").alias("chunk"), "band"]
    pairs = stored(asking.join(dealt, ["token", "band", "deal"]).where(near & smaller).select("node", "n", *group).distinct())
    # what each pair has in common, by shingle
    common = pairs.join(held.select("node", "token"), "node").join(matrix.select("token", *group, "least", "most"), ["token", "goal", "chunk", "band"])
    common = common.groupBy("node", "n", "goal", "chunk", "band").agg(F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most"))
    after = lambda m: F.ceil(percent * m / 100) - 1
    needed = lambda m: F.ceil(percent * (F.col("n") + m) / all_) - F.greatest(after(F.col("n")), after(m))
    # over the sizes of a group the number is least at one of the ends
    enough = F.col("common") >= F.least(*(needed(F.greatest(F.least(F.col(x), high), low)) for x in ("least", "most")))
    return common.where(enough).select("node", "goal", "chunk").distinct()
