"""Scanning: texts in, findings out. One projection, no shuffle, no value of a finding kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.matching import may_match, spans
from palisade.functions.validators import before, passes
from palisade.plans.rules import Rule, rules

WITHHELD = "(a name that is withheld)"


def digest(rule_id: Column | str, value: Column) -> Column:
    """A finding's key: 16 hex digits of the hash of rule and value bytes, which it doesn't reveal."""
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return F.substring(F.sha2(F.concat(F.encode(rule, "UTF-8"), F.unhex(F.lit("00")), F.encode(value, "ISO-8859-1")), 256), 1, 16)


def found_in(raw: Column, which: Sequence[Rule], check: bool = True, lines: bool = False) -> Column:
    """array<struct<rule_id, rule_order, offset, end, line, value>> of candidates in a text or binary content that pass
    the checks of their rule (or all of them), rule by rule; line is null unless lines are asked for."""
    which = list(which)
    met = spans(which, raw, lines)
    if check:
        # a condition for each kind of rule: those of one kind have the same checks, and differ in what entropy they ask for
        kinds: dict[tuple, list[int]] = {}
        for i, rule in enumerate(which):
            kinds.setdefault((rule.validators, rule.labels), []).append(i)
        floors = F.array(*(F.lit(float(r.entropy)) for r in which))

        def stays(m: Column) -> Column:
            tests = F.lit(True)
            for (checks, _), own in kinds.items():
                if checks:
                    passed = passes(which[own[0]], m["value"], m["near"], m["bits"], F.element_at(floors, m["rule_order"] + 1))
                    tests = F.when(m["rule_order"].isin(own), passed).otherwise(tests)
            return tests

        met = F.filter(met, stays)
    ids = F.array(*(F.lit(r.id) for r in which))
    names = ("rule_order", "offset", "end", "line", "value")
    return F.transform(met, lambda m: F.struct(F.element_at(ids, m["rule_order"] + 1).alias("rule_id"), *(m[x].alias(x) for x in names)))


def _exploded(df: DataFrame, found: str) -> DataFrame:
    """df with a row for each member of its column `found`, as m."""
    # explode_outer: for explode, the optimizer would look for matches once more, to see whether there are any
    return df.withColumn("m", F.explode_outer(found)).where(F.col("m").isNotNull())


def candidates(df: DataFrame, key: str, text: str, which: Sequence[Rule]) -> DataFrame:
    """key, rule_id, rule_order, offset, end, value, before (the bytes before it): all matches, unchecked."""
    likely = T.small_batches(df).where(may_match(which, F.col(text).cast("string"))).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = likely.withColumn("found", found_in(F.col("text"), which, check=False)).withColumn("view", T.byte_view("text"))
    near = F.transform("found", lambda m: m.withField("before", before(F.col("view"), m["offset"])))
    return _exploded(found.select("key", near.alias("found")), "found").select(F.col("key").alias(key), "m.*").drop("line")


def findings(df: DataFrame, key: str, text: str, which: Sequence[Rule] | None = None, line: bool = False) -> DataFrame:
    """key, rule_id, offset, end (bytes of the text's UTF-8), digest, and the line, if asked for. Rules are independent:
    findings may overlap. Checks run where the text is, so rows of findings are small."""
    which = list(which if which is not None else rules())
    likely = T.small_batches(df).where(may_match(which, F.col(text).cast("string"))).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = _exploded(likely.select("key", found_in(F.col("text"), which, lines=line).alias("found")), "found")
    lines = ["m.line"] if line else []
    return found.select(F.col("key").alias(key), "m.rule_id", "m.offset", "m.end", digest(F.col("m.rule_id"), F.col("m.value")).alias("digest"), *lines)


def scan_content(df: DataFrame, key: str, content: str, which: Sequence[Rule] | None = None, include_binary: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings and skips of binary content, whatever its encoding: (key, rule_id, offset, end, digest) with places
    in the content, and (key, skip) of what could not be read or was read raw. Nothing unread goes unsaid. Places are
    translated in the row of their content, so keys may repeat."""
    which = list(which if which is not None else rules())
    judged = T.small_batches(df).select(F.col(key).alias("key"), F.col(content).alias("content")).withColumn("skip", T.skipped("content", include_binary))
    readable = judged.where(F.col("skip").isin(T.READ, T.READ_RAW)).select("key", T.encoding("content").startswith("utf-16").alias("wide"), T.decoded("content").alias("text"))
    likely = readable.where(may_match(which, F.col("text").cast("string")))
    scanned = likely.withColumn("found", found_in(F.col("text"), which))
    places = F.array_sort(F.array_distinct(F.concat(F.col("found.offset"), F.col("found.end"))))
    placed = scanned.withColumn("places", F.when(F.col("wide"), places)).withColumn("place", T.utf16_places(F.when(F.col("wide"), F.col("text")), F.col("places"))).drop("text")
    one = _exploded(placed, "found")
    at = lambda x: F.when(F.col("wide"), F.element_at("place", F.col(f"m.{x}"))).otherwise(F.col(f"m.{x}")).alias(x)
    found = one.select(F.col("key").alias(key), "m.rule_id", at("offset"), at("end"), digest(F.col("m.rule_id"), F.col("m.value")).alias("digest"))
    return found, judged.where(F.col("skip") != T.READ).select(F.col("key").alias(key), "skip")


def withheld(name: Column, which: Sequence[Rule] | None = None) -> Column:
    """A name as it may be shown: one that holds a finding itself, as it is or with spaces for underscores, or a
    control character is withheld."""
    which = list(which if which is not None else rules())
    odd, spaced = name.rlike(r"[\x00-\x1f\x7f]"), F.translate(name, "_", " ")
    # only what the looks leave open goes through the rules, and no name twice as it is
    looked = ((~odd, name), (~odd & name.contains("_"), spaced))
    hit = reduce(lambda a, b: a | b, (F.size(found_in(F.when(open_ & may_match(which, x), x), which)) > 0 for open_, x in looked))
    return F.when(odd | hit, WITHHELD).otherwise(name)
