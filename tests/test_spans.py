"""Intervals of findings against all pairs, another rule set against two scans, sketches against counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palisade.operators import scan, spans
from palisade.plans.rules import BY_ID, Rule

SCHEMA = "doc long, rule_id string, offset long, end long, lang string"


def some_spans(n=400, seed=1):
    """Spans from none to very many bytes, in few texts, with equal ones, some that only touch, and null texts."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        lo, size = r.randint(0, 3000), r.choice([0, 1, 3, 12, 63, 64, 65, 700, 1024, 20_000, 300_000, 9_000_000])
        rows.append((r.choice([1, 1, 1, 2, 3, None]), r.choice("abc"), lo, lo + size, "x"))
    return rows + rows[:20] + [(9, "a", 0, 10, "x"), (9, "b", 10, 20, "x"), (9, "c", 9, 11, "x")]


def test_overlapping_pairs_equal_all_pairs(spark):
    left, right = some_spans(seed=1), some_spans(seed=2)
    want = Counter((x[0], x[1:4], y[1:4]) for x in left for y in right if x[0] is not None and x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    a, b = (spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (left, right))
    got = Counter((r["doc"], tuple(r["left"])[:3], tuple(r["right"])[:3]) for r in spans.overlapping(a, b, "doc").collect())
    assert got == want and len(want) > 1000


def test_rules_that_overlap_in_one_table(spark):
    rows = some_spans(120)
    want = Counter((x[0], x[1:4], y[1:4]) for x in rows for y in rows if x[0] is not None and x[0] == y[0] and x[1] < y[1] and max(x[2], y[2]) < min(x[3], y[3]))
    got = Counter((r["doc"], tuple(r["left"])[:3], tuple(r["right"])[:3]) for r in spans.overlapping_rules(spark.createDataFrame(rows, SCHEMA), "doc").collect())
    assert got == want


def test_a_text_with_very_many_findings_is_no_row_product(spark):
    """100,000 findings of one text, each of which meets two of the other rule: rows compared stay in proportion."""
    n = 100_000
    a = spark.range(n).select(F.lit(1).alias("doc"), F.lit("a").alias("rule_id"), (F.col("id") * 10).alias("offset"), (F.col("id") * 10 + 8).alias("end"))
    b = spark.range(n).select(F.lit(1).alias("doc"), F.lit("b").alias("rule_id"), (F.col("id") * 10 + 5).alias("offset"), (F.col("id") * 10 + 13).alias("end"))
    assert spans.overlapping(a, b, "doc").count() == 2 * n - 1


def test_no_spans(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spans.overlapping(none, none, "doc").count() == 0 and spans.covered(none, "doc").count() == 0


def test_covered_stretches(spark):
    rows = [x for x in some_spans() if x[3] > x[2]]
    want = []
    for doc in {x[0] for x in rows}:
        own = sorted(x[2:4] for x in rows if x[0] == doc)
        for lo, hi in own:
            if want and want[-1][0] == doc and lo < want[-1][2]:
                want[-1][2:] = [max(want[-1][2], hi), want[-1][3] + 1]
            else:
                want.append([doc, lo, hi, 1])
    got = [[r["doc"], r["offset"], r["end"], r["n"]] for r in spans.covered(spark.createDataFrame(rows, SCHEMA), "doc").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def brute_changes(before, after):
    """From two scans: the difference as multisets, then what shares key, rule and beginning is paired."""
    gained, lost = after - before, before - after
    out = Counter()
    for at in {x[:3] for x in (*gained, *lost)}:
        g = sorted(x[3] for x in gained.elements() if x[:3] == at)
        n_lost = sorted(x[3] for x in lost.elements() if x[:3] == at)
        for i, end in enumerate(g):
            out[(*at, end, "moved" if i < len(n_lost) else "gained")] += 1
        for end in n_lost[len(g) :]:
            out[(*at, end, "lost")] += 1
    return out


def test_changes_of_a_rule_set(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["1.2.3.4", "8.8.8.8", "10.0.0.1", "tok_abc", "tok_abcdef", "x"]) for _ in range(r.randint(0, 8))) for _ in range(60)]
    rows = [*enumerate(texts), (3, texts[3]), (4, "another 8.8.8.8 under one key"), (None, "8.8.4.4"), (7, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    short, long = Rule("tok", "pii", "t", r"\b(tok_[a-z]{3})", True, 1), Rule("tok", "pii", "t", r"\b(tok_[a-z]{3,9})", True, 1)
    before, after = [BY_ID["ipv4-public"], short], [Rule("ipv4-public", "pii", "any", BY_ID["ipv4-public"].regex, True, 1), long]
    scanned = [Counter((x["id"], x["rule_id"], x["offset"], x["end"]) for x in scan.findings(docs, "id", "text", which).collect()) for which in (before, after)]
    got = Counter(tuple(x) for x in spans.changes(docs, "id", "text", before, after).select("id", "rule_id", "offset", "end", "change").collect())
    assert got == brute_changes(*scanned) and {x[4] for x in got} == {"gained", "moved"}
    back = Counter(tuple(x) for x in spans.changes(docs, "id", "text", after, before).select("id", "rule_id", "offset", "end", "change").collect())
    assert {x[4] for x in back} == {"lost", "moved"} and spans.changes(docs, "id", "text", after, after).count() == 0


@pytest.mark.parametrize("n", [10, 500, 40_000])
def test_united_sketches_are_near_the_count(spark, n):
    """Sketches of days, united for the whole: the same estimate as one sketch of all, a few per cent off."""
    found = spark.range(3 * n).select((F.col("id") % 7).alias("day"), F.sha2((F.col("id") % n).cast("string"), 256).alias("digest"))
    kept = spans.sketched(found, ["day"])
    got = spans.united(kept.withColumn("all", F.lit(1)), ["all"]).first()["different"]
    whole = spans.united(spans.sketched(found.withColumn("all", F.lit(1)), ["all"]), ["all"]).first()["different"]
    assert abs(got - n) <= max(1, 0.06 * n) and abs(got - whole) <= max(1, 0.03 * n)
