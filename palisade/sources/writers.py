"""Sinks: the coverage log, clean texts, redacted texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from palisade.operators.redact import clean, redact, redacted, without_findings
from palisade.plans.rules import Rule

#: Records of a log file before the next is begun.
ROTATED = 20_000


def append_coverage(records: DataFrame, path: str) -> None:
    records.write.mode("append").option("maxRecordsPerFile", ROTATED).json(path)


def write_clean(df: DataFrame, found: DataFrame, key: str, path: str) -> None:
    """Texts without a finding, unchanged; the others not at all. For findings that come from elsewhere, by key."""
    clean(df, found, key).write.parquet(path)


def write_redacted(df: DataFrame, found: DataFrame, key: str, text: str, path: str) -> None:
    """For findings that come from elsewhere, by key."""
    redacted(df, found, key, text).write.parquet(path)


def scan_and_write_clean(df: DataFrame, text: str, path: str, which: Sequence[Rule] | None = None) -> None:
    """Rows in whose text nothing is found, unchanged: scanned where they lie, without a shuffle."""
    without_findings(df, text, which).write.parquet(path)


def scan_and_write_redacted(df: DataFrame, key: str, text: str, path: str, which: Sequence[Rule] | None = None) -> None:
    """Every row's key and its text without what is found in it, without a shuffle."""
    redact(df, key, text, which).write.parquet(path)
