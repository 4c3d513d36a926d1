"""Rule documents as rows: everything that is wrong with each, and ids that several documents use."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.plans.rules import RuleError, load


def problems_of(text: str | None) -> list[str]:
    """One line for each problem; none for a document that loads."""
    try:
        load(text or "")
    except RuleError as e:
        return str(e).split("\n")
    return []


def ids_of(text: str | None) -> list[str]:
    """The ids of a document that loads."""
    return [] if problems_of(text) else [r["id"] for r in json.loads(text)["rules"]]


#: Documents that a worker remembers, of this many characters at most.
HELD, SHORT = 1024, 1 << 14


@lru_cache(HELD)
def _known(f: Callable[[str | None], list[str]], text: str | None) -> list[str]:
    return f(text)


def _each(text: Column, f) -> Column:
    """f of each document: of one that comes again and again, once."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_known(f, x) if len(x or "") <= SHORT else f(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def problems(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, nth, problem: all problems of each document, in the loader's order. Null documents are empty ones."""
    found = documents.select(key, F.posexplode(_each(F.col(text), problems_of)).alias("nth", "problem"))
    return found.select(key, F.col("nth").cast("long").alias("nth"), "problem")


def loaded_ids(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, rule_id: the rules of documents that load."""
    return documents.select(key, F.explode(_each(F.col(text), ids_of)).alias("rule_id"))


def shared_ids(documents: DataFrame, key: str, text: str) -> DataFrame:
    """rule_id, documents, first: ids that several documents that load use, so that they can't be used together."""
    used = loaded_ids(documents, key, text).groupBy("rule_id").agg(F.count_distinct(key).alias("documents"), F.min(key).alias("first"))
    return used.where("documents > 1")
