"""Findings as intervals of their texts: which overlap, what they cover together, what another rule set changes, and
how many different values there are, by sketches that can be united."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.scan import findings
from palisade.plans.rules import Rule

#: Bytes of a bin at the finest level, how much coarser each further level is, and levels: spans of up to 2^30 bytes.
FINEST, COARSER, LEVELS = 64, 16, 7


def _level(length: Column) -> Column:
    """The finest level whose bins a span of so many bytes spans two of at most."""
    found = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        found = F.when(length <= FINEST * COARSER**k, k).otherwise(found)
    return found.cast("int")


def _binned(spans: DataFrame, key: str, side: str, others: Sequence[int], visits: str, hosts: str) -> DataFrame:
    """Each span under its bins: at home at its own level, and as a visitor of coarser levels that the other side has
    spans at. `pair` keeps visitors from meeting each other: those are a finer level's business."""
    own = _level(F.col("end") - F.col("offset"))
    levels = F.array(*(F.lit(k).cast("int") for k in sorted(others)))
    home = F.array(F.struct(own.alias("level"), F.lit("home").alias("pair")), F.struct(own.alias("level"), F.lit(hosts).alias("pair")))
    away = F.transform(F.filter(levels, lambda k: k > own), lambda k: F.struct(k.alias("level"), F.lit(visits).alias("pair")))
    rows = spans.where(F.col("end") > F.col("offset")).select(F.col(key).alias("key"), F.struct(*(c for c in spans.columns if c != key)).alias(side), "offset", "end", F.explode(F.concat(home, away)).alias("at"))
    size = F.element_at(F.array(*(F.lit(FINEST * COARSER**k) for k in range(LEVELS))), F.col("at.level") + 1)
    bins = F.sequence(F.expr("offset") - F.pmod("offset", size), F.col("end") - 1, size)
    return rows.select("key", side, "at", F.explode(bins).alias("bin"))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left, right: all pairs of spans (offset, end, and what else there is) of one key that share a byte. Empty
    spans share none.

    An equi-join on bins: spans meet in bins about as long as the longer of them, so what is compared and comes to
    nothing stays within a fixed multiple of the spans, and a text with very many findings is dealt over its bins. A pair
    that meets in two bins counts in the later one of their beginnings."""
    levels = [r[0] for r in left.select(_level(F.col("end") - F.col("offset")).alias("k")).union(right.select(_level(F.col("end") - F.col("offset")))).distinct().collect()]  # LEVELS rows at most
    a = _binned(left, key, "left", levels, visits="left visits", hosts="right visits")
    b = _binned(right, key, "right", levels, visits="right visits", hosts="left visits")
    size = F.element_at(F.array(*(F.lit(FINEST * COARSER**k) for k in range(LEVELS))), F.col("at.level") + 1)
    later = F.greatest("left.offset", "right.offset")
    met = a.join(b, ["key", "at", "bin"]).where((F.col("bin") == later - F.pmod(later, size)) & (later < F.least("left.end", "right.end")))
    return met.select(F.col("key").alias(key), "left", "right")


def overlapping_rules(found: DataFrame, key: str) -> DataFrame:
    """Pairs of findings of different rules that overlap, each pair once: the rule that comes first by name is on the left.
    Findings are kept while both sides read them, so texts are scanned once; a lost executor's part is made anew."""
    found = found.persist()
    return overlapping(found, found, key).where("left.rule_id < right.rule_id")


def covered(found: DataFrame, key: str) -> DataFrame:
    """key, offset, end, n: the stretches that findings cover together, and how many lie in each. Findings that only touch
    stand apart. A text's findings are swept in order, with the furthest end so far: no more than a row is held."""
    order = Window.partitionBy(key).orderBy("offset", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("fresh", F.coalesce(F.col("offset") >= reached, F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.count("*").alias("n")).drop("run")


def changes(df: DataFrame, key: str, text: str, before: Sequence[Rule], after: Sequence[Rule]) -> DataFrame:
    """key, rule_id, offset, end, change: what `after` finds and `before` doesn't ("gained"), the reverse ("lost"), and
    findings that keep their rule and beginning but end elsewhere ("moved"; with the new end). Texts are scanned once for
    both sets; keys may repeat, and then findings count as often as their rows."""
    sides = [replace(r, id=f"{side}{r.id}") for side, which in (("-", before), ("+", after)) for r in which]
    found = findings(df, key, text, sides).withColumn("sign", F.when(F.col("rule_id").startswith("+"), 1).otherwise(-1))
    found = found.withColumn("rule_id", F.expr("substring(rule_id, 2)"))
    left = found.groupBy(key, "rule_id", "offset", "end").agg(F.sum("sign").alias("more")).where("more <> 0")
    one = left.groupBy(key, "rule_id", "offset").agg(F.collect_list(F.struct("end", "more")).alias("ends"))
    # a beginning has few ends: one for each pattern of the rule's id
    repeated = lambda given: F.flatten(F.transform(given, lambda x: F.array_repeat(x["end"], F.abs(x["more"]).cast("int"))))
    gained, lost = repeated(F.filter("ends", lambda x: x["more"] > 0)), repeated(F.filter("ends", lambda x: x["more"] < 0))
    paired = one.select(key, "rule_id", "offset", F.array_sort(gained).alias("gained"), F.array_sort(lost).alias("lost"))
    row = lambda x, say: F.struct(x.alias("end"), F.lit(say).alias("change"))
    told = F.concat(
        F.transform("gained", lambda x, i: F.when(i < F.size("lost"), row(x, "moved")).otherwise(row(x, "gained"))),
        F.transform(F.filter("lost", lambda x, i: i >= F.size("gained")), lambda x: row(x, "lost")),
    )
    return paired.select(key, "rule_id", "offset", F.explode(told).alias("m")).select(key, "rule_id", "offset", "m.end", "m.change")


def sketched(found: DataFrame, by: Sequence[str], value: str = "digest", log2_size: int = 12) -> DataFrame:
    """A sketch of the different values of each group, some 1.6 % off at size 2^12: 2.5 KB at most, whatever there is.
    Sketches can be kept by source and day, and united for any report."""
    return found.groupBy(*by).agg(F.hll_sketch_agg(value, log2_size).alias("sketch"))


def united(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, different: the estimate for coarser groups, from sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias("different"))
