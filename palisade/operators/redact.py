"""What findings are used for: redaction, listings, clean and flagged texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.matching import may_match, spliced
from palisade.functions.text import byte_view, line_number, small_batches
from palisade.operators.scan import found_in
from palisade.plans.rules import Rule, rules

LISTED = 5


def _hidden(text: Column, spans: Column) -> Column:
    """A text with spans (offset, rule_id, end), in any order, hidden; null where the spans are. Only texts with spans go
    through Python, where splicing is linear; rules that start alike go by id."""
    return F.decode(spliced(F.when(spans.isNotNull(), text.cast("binary")), F.array_sort(spans)), "UTF-8")


def redacted(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """key, redacted (text): each finding's bytes replaced by a marker that names its rule. Texts without findings
    come unchanged. A finding that starts where another does goes first by rule id. For findings that come from
    elsewhere, by key; redact() scans and hides in one pass."""
    spans = found.groupBy(key).agg(F.collect_list(F.struct("offset", "rule_id", "end")).alias("spans"))
    joined = small_batches(df).select(F.col(key), F.col(text).alias("text")).join(spans, key, "left")
    return joined.select(key, F.coalesce(_hidden(F.col("text"), F.col("spans")), F.col("text")).alias("redacted"))


def _judged(df: DataFrame, text: str, which: Sequence[Rule] | None, check: bool) -> tuple[DataFrame, Column]:
    """df with what is found in each text, in the row itself; null where no rule can match."""
    which = list(which if which is not None else rules())
    likely = F.when(may_match(which, F.col(text)), F.col(text))
    return small_batches(df).withColumn("__found", found_in(likely, which, check)), F.coalesce(F.size("__found") > 0, F.lit(False))


def redact(df: DataFrame, key: str, text: str, which: Sequence[Rule] | None = None, check: bool = True) -> DataFrame:
    """key, redacted: what redacted() gives for the texts' own findings, without a shuffle. check=False hides all
    candidates."""
    judged, any_ = _judged(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", which, check)
    spans = F.transform("__found", lambda m: F.struct(m["offset"].alias("offset"), m["rule_id"].alias("rule_id"), m["end"].alias("end")))
    return judged.select(F.col("key").alias(key), F.coalesce(_hidden(F.col("text"), F.when(any_, spans)), F.col("text")).alias("redacted"))


def without_findings(df: DataFrame, text: str, which: Sequence[Rule] | None = None) -> DataFrame:
    """df's rows in whose text nothing is found, unchanged and without a shuffle."""
    judged, any_ = _judged(df, text, which, True)
    return judged.where(~any_).drop("__found")


def with_findings(df: DataFrame, text: str, which: Sequence[Rule] | None = None) -> DataFrame:
    """df's other rows."""
    judged, any_ = _judged(df, text, which, True)
    return judged.where(any_).drop("__found")


def with_lines(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """Findings with the line that they start on."""
    return found.join(df.select(F.col(key), byte_view(text).alias("view")), key).withColumn("line", line_number(F.col("view"), F.col("offset"))).drop("view")


def listing(found: DataFrame, key: str, most: int = LISTED) -> DataFrame:
    """key, listed (the first `most` findings by place), more (how many are not listed)."""
    every = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("offset", "rule_id"))).alias("every"))
    return every.select(key, F.slice("every", 1, most).alias("listed"), F.greatest(F.size("every") - most, F.lit(0)).cast("long").alias("more"))


def flagged(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return df.join(found.select(key), key, "left_semi")


def clean(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Texts without a finding pass unchanged; the others not at all."""
    return df.join(found.select(key), key, "left_anti")
