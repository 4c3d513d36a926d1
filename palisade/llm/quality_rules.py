"""Operator 9: quality rules whose cutoffs carry a guarantee on false rejections.

A text's signals are the shares of symbols, repeated lines and repeated words. A ladder of cutoffs goes from
lenient to strict; a text's rung is the first at which any signal exceeds its cutoff. Labelled texts are dealt
into two halves by a hash of their id. On the holdout half each stratum (language) is tested from the lenient
end on: rung after rung, the hypothesis that more than RISK of good texts are rejected is tested by the exact
binomial tail, and testing stops at the first rung that keeps it. A fixed sequence needs no correction among
rungs; strata are corrected for by dividing MISS by their number (Bonferroni). Among the rungs that passed, the
tuning half picks the one that rejects most bad texts for the good ones it costs. A stratum without enough labels
passes no rung and rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, columns, stored
from .quality_features import FEATURES, of_batch

#: Rungs of the ladder: cutoffs of the shares, lenient to strict.
SYMBOLS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02)
LINES = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45)
WORDS = (0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3)
NEVER = len(SYMBOLS)
RISK = 0.05
MISS = 0.05
#: How many bad texts must go for each good one.
PRICE = 5.0


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly from k down."""
    if k >= n:
        return 1.0
    if k >= n * p:
        return 0.5  # no less: such a count speaks for no rate below p
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, j = term, k
    while j and term > total * 1e-17:
        term *= j / (n - j + 1) * (1 - p) / p
        total, j = total + term, j - 1
    return total


def chosen_rungs(counts: list[tuple], risk: float = RISK, miss: float = MISS) -> dict:
    """stratum -> rung (-1: none) from counts (stratum, holdout, good, rung, n)."""
    strata = {x[0] for x in counts}
    found = {}
    for stratum in strata:
        own = [x for x in counts if x[0] == stratum]

        def rejected(holdout: bool, good: bool, rung: int, own=own) -> int:
            return sum(n for _, h, g, r, n in own if (h, g) == (holdout, good) and r <= rung)

        n = rejected(True, True, NEVER)
        best, gain = -1, 0.0
        for rung in range(NEVER):
            if not n or binomial_tail(rejected(True, True, rung), n, risk) > miss / len(strata):
                break
            bad, good = (rejected(False, x, NEVER) for x in (False, True))
            here = rejected(False, False, rung) / max(bad, 1) - PRICE * rejected(False, True, rung) / max(good, 1)
            if here > gain + 1e-12:
                best, gain = rung, here
        found[stratum] = best
    return found


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _rung() -> Column:
    """The first rung at which a signal exceeds its cutoff; NEVER if none does."""
    rung = F.lit(NEVER)
    for i in reversed(range(NEVER)):
        over = (_share("n_symbols", "word_chars") > SYMBOLS[i]) | (_share("n_dup_lines", "n_lines") > LINES[i])
        rung = F.when(over | (_share("n_repeat_words", "n_words") > WORDS[i]), i).otherwise(rung)
    return rung


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, stratum) with FEATURES, base_failed and rung instead of the text."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *of_batch(batch.column("text"))], ["doc_id", "stratum", *FEATURES])

        return work

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    counted = batches(docs, make, f"doc_id {kinds['doc_id']}, stratum {kinds['stratum']}, " + ", ".join(f"{x} long" for x in FEATURES))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", base).withColumn("rung", _rung())


def apply_rules(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    risk: float = RISK,
    miss: float = MISS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and stratum of each row.

    labels: id_col and label_col (1 good, 0 bad); of several labels of an id the worst counts, null ones don't.
    In each stratum the chance that more than `risk` of good texts that pass the base rules are rejected is at
    most `miss`, over all strata together. Null texts have no words and fail the base rules; null strata are a
    stratum of their own; ids may be null (they have no label) or repeated. An empty table gives an empty table,
    empty labels base rules alone; other columns are not looked at.
    """
    docs = stored(measured(columns(df, doc_id=id_col, text=text_col, stratum=stratum_col)))
    known = columns(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    holdout = F.crc32(F.concat(F.lit("rules "), F.col("doc_id").cast("string")).cast("binary")) % 2 == 0
    counts = (
        docs.where("NOT base_failed")
        .join(known, "doc_id")
        .groupBy("stratum", holdout.alias("holdout"), (F.col("label") > 0).alias("good"), "rung")
        .count()
        .collect()
    )
    rungs = chosen_rungs([tuple(x) for x in counts], risk, miss)
    # as many literals as strata: languages, not documents
    chosen = F.lit(-1)
    for stratum, rung in rungs.items():
        chosen = F.when(F.col("stratum").eqNullSafe(F.lit(stratum)), rung).otherwise(chosen)
    kept = ~F.col("base_failed") & (F.col("rung") > chosen)
    return docs.select("doc_id", *FEATURES[:5], "base_failed", kept.alias("kept"), "stratum")
