"""Operator 10: mixing sources to target weights by entropy balancing, in DataFrame operations only.

The rates r of documents minimise sum(d * (r * ln r - r + 1)), d = size + mean size of the source, under
each source's token constraint sum(r * size) = target and r <= CAP. The solution is an exponential tilt,
r = min(CAP, exp(lambda * size / d)), with one lambda for each source, found by Newton's method on the
dual. A rate depends on source and size alone, so documents are first counted by both and the iterations
run on those counts. Rates become whole copies by cumulative rounding, then the last tokens are settled
with the smallest documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, stored

CAP = 2
#: Documents of one source and size that are ranked together.
RANKED = 1000
#: Newton steps after which the mix is given up: with halved intervals, some 60 suffice.
ITERATIONS = 100
#: Strata (source and size) that are sent to all tasks; more are joined, dealt by hash.
SENT = 200_000
SALTS = 16


def word_count(text: str = "text") -> Column:
    pattern = WORD.replace("\\", "\\\\")
    return F.coalesce(F.expr(f"regexp_count({text}, '{pattern}')"), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, by the source's code points (null last): parts of the range are ranked on their own
    and moved by the rows before them, so that no task holds all sources."""
    key = F.col("source").cast("binary").asc_nulls_last()
    parts = stored(sizes.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    # one row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.groupBy("part").agg(F.count("*").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("moved"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("nth", nth).join(moved, "part").withColumn("rank", F.col("moved") + F.col("nth")).drop("part", "moved", "nth")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = CAP) -> DataFrame:
    """source, source_size, target from source, source_size: `share` of all sizes by weight, in order of
    the source's code points (null last) with repeating weights; a target stops at cap * source_size and
    the excess goes to the rest by weight. One row for each source."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    most = cap * F.col("source_size")
    weighed = stored(_ranked(sizes).select("source", "source_size", weight.alias("weight"), most.cast("double").alias("most")))
    # The level is what a unit of weight gets. Sources that it takes over their cap are full; what they leave raises
    # it for the others, until no more are full.
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("most")
        of_full, of_rest = F.when(over, F.col("most")).otherwise(0.0), F.when(over, 0.0).otherwise(F.col("weight"))
        now = weighed.agg(F.sum("source_size").alias("total"), F.count_if(over).alias("full"), F.sum(of_full).alias("held"), F.sum(of_rest).alias("weight")).first()
        if now["full"] == full or not now["weight"]:
            break
        full, level = now["full"], (share * now["total"] - now["held"]) / now["weight"]
    return weighed.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def _rate(z: Column, tilt: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt * z, F.lit(50.0))))


def tilts(counts: DataFrame, wanted: DataFrame, cap: float = CAP, iterations: int = ITERATIONS, close: float = 1e-9) -> DataFrame:
    """source, target, mean_size, tilt: the dual's solution from counts (source, size, n).

    Newton's step is kept inside the interval known to hold the solution (its middle is taken where the
    step leaves it), so that it converges from any start; targets at the cap have all rates at the cap."""
    base = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    state = stored(
        wanted.join(base, wanted["source"].eqNullSafe(base["source"]))
        .select(wanted["source"], "source_size", "target", "mean_size")
        .withColumn("tilt", F.lit(0.0))
        .withColumn("low", F.lit(-2000.0))
        .withColumn("high", F.lit(2000.0))
        .withColumn("off", F.lit(1.0))
    )
    for _ in range(iterations):
        s, c = state.alias("s"), counts.alias("c")
        z = F.col("size") / (F.col("size") + F.col("mean_size"))
        rate = _rate(z, F.col("tilt"), cap)
        tokens = F.col("size") * F.col("n")
        sums = (
            c.where("size > 0")
            .join(s, F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("c.source").alias("of"))
            .agg(F.sum(tokens * rate).alias("got"), F.sum(F.when(rate < cap, tokens * z * rate).otherwise(0.0)).alias("slope"))
        )
        gap = F.coalesce("got", F.lit(0.0)) - F.col("target")
        step = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        inside = (step > low) & (step < high)
        state = stored(
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
            .select(
                "source", "source_size", "target", "mean_size",
                F.when(gap == 0, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), step).otherwise((low + high) / 2).alias("tilt"),
                low.alias("low"), high.alias("high"),
                F.when(F.col("target") >= cap * F.col("source_size"), 0.0).otherwise(F.abs(gap) / F.greatest("target", F.lit(1.0))).alias("off"),
            )
        )
        off = state.agg(F.max("off")).first()[0] or 0.0
        if off <= close:
            return state
    raise RuntimeError(f"no tilt found in {iterations} steps: a source's tokens are off their target by a share of {off}")


def copies(counts: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """source, size, n, copies: how many copies all n documents of a source and size get together.

    Rates are summed from the largest size down and the sums' whole parts give the copies; what is then
    missing to the target is added, or what is too much taken away, among the smallest sizes."""
    s, c = solved.alias("s"), counts.alias("c")
    z = F.col("size") / (F.col("size") + F.col("mean_size"))
    rate = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(_rate(z, F.col("tilt"), cap))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.floor(F.sum(F.col("n") * F.col("rate")).over(down) + 0.5)
    rated = c.where("size > 0").join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select(F.col("c.source").alias("source"), "size", "n", "target", rate.alias("rate"))
    first = (
        rated.withColumn("upto", whole)
        .withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
        .withColumn("k", F.greatest(F.lit(0), F.least(F.col("k"), cap * F.col("n"))))
        .withColumn("miss", F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(Window.partitionBy("source"))).cast("long"))
    )
    # Room of the stratum in copies, then greedily from the smallest size: all of it while it fits.
    room = F.when(F.col("miss") > 0, cap * F.col("n") - F.col("k")).otherwise(F.col("k"))
    spare = F.coalesce(F.sum(F.col("room") * F.col("size")).over(up), F.lit(0))
    return (
        first.withColumn("room", room)
        .withColumn("left", F.abs("miss") - spare)
        .withColumn("moved", F.when(F.col("left") > 0, F.least(F.col("room"), F.floor(F.col("left") / F.col("size")))).otherwise(0))
        .select("source", "size", "n", (F.col("k") + F.signum("miss").cast("long") * F.col("moved")).cast("long").alias("copies"))
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = CAP,
) -> DataFrame:
    """doc_id, source, size (words), source_size, target (of the source), copies (0 to cap) and taken
    (copies * size) of each row; sum(taken) of a source comes within a small document of its target.

    Documents of a source and size share its copies by a hash of the id, so reruns agree. Null texts and
    texts without a word have size 0 and no copies. Null sources are a source of their own, the last in
    order; null ids are hashed as such; repeated rows are documents of their own (their copies may differ
    when ids tie). An empty table gives an empty table; other columns are not looked at.
    """
    docs = stored(columns(df, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", word_count().alias("size")))
    counts = stored(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = stored(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    given = copies(counts, tilts(counts, wanted, cap), cap)
    # Large strata are dealt into parts by hash; each part gets its share of copies by cumulative rounding
    # and ranks its documents alone.
    given, sized = stored(given), docs.where("size > 0")
    salts = 1 if given.count() <= SENT else SALTS
    if salts == 1:
        given = F.broadcast(given.withColumn("salt", F.lit(0)))
    else:
        given = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.size") == F.col("g.size")) & (F.col("d.salt") == F.col("g.salt"))
    part = F.pmod(F.xxhash64("d.doc_id"), F.ceil(F.col("g.n") / RANKED))
    dealt = (
        sized.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(salts)).cast("int"))
        .alias("d")
        .join(given.alias("g"), same)
        .select("d.doc_id", "d.source", "d.size", "g.n", F.col("g.copies").alias("of_all"), part.alias("part"))
    )
    stratum = Window.partitionBy("source", "size").orderBy("part")
    shares = (
        dealt.groupBy("source", "size", "part", "n", "of_all")
        .agg(F.count("*").alias("m"))
        .withColumn("before", F.sum("m").over(stratum))
        .withColumn("upto", F.expr("(of_all * before) div n"))
        .withColumn("mine", F.col("upto") - F.coalesce(F.lag("upto").over(stratum), F.lit(0)))
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.lit("rank"), "doc_id"), "doc_id"))
    d, p, w = dealt.withColumn("rank", rank).alias("d"), shares.alias("p"), wanted.alias("w")
    extra = (F.col("rank") <= F.col("mine") % F.col("m")).cast("long")
    same_part = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.part") == F.col("p.part"))
    taken = d.join(p, same_part).select("d.doc_id", "d.source", "d.size", (F.floor(F.col("mine") / F.col("m")) + extra).cast("long").alias("copies"))
    without = docs.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copies"))
    return (
        taken.unionByName(without)
        .alias("d")
        .join(w, F.col("d.source").eqNullSafe(F.col("w.source")))
        .select("d.doc_id", "d.source", "d.size", "w.source_size", "w.target", "copies", (F.col("copies") * F.col("d.size")).alias("taken"))
    )
