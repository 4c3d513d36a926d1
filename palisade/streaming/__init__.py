"""Scanning streams of texts as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.matching import may_match
from palisade.operators.scan import digest, found_in
from palisade.plans.rules import Rule, rules


def stream_findings(stream: DataFrame, key: str, text: str, time: str, which: Sequence[Rule] | None = None, late: str = "10 minutes") -> DataFrame:
    """key, time, rule_id, offset, end, digest of a stream of texts; the same value under the same rule is reported
    once within `late`, after which its state is dropped. The stream is read once for all rules."""
    which = list(which if which is not None else rules())
    likely = stream.where(may_match(which, F.col(text))).withWatermark(time, late)
    found = likely.select(F.col(key), F.col(time), F.explode_outer(found_in(F.col(text), which)).alias("m")).where("m IS NOT NULL")
    found = found.select(key, time, "m.rule_id", "m.offset", "m.end", digest(F.col("m.rule_id"), F.col("m.value")).alias("digest"))
    return found.dropDuplicatesWithinWatermark(["rule_id", "digest"])


def counts_by_window(found: DataFrame, time: str, width: str = "5 minutes") -> DataFrame:
    """window, rule_id, n."""
    return found.groupBy(F.window(time, width), "rule_id").agg(F.count("*").alias("n"))
