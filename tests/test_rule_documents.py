"""Rule documents as rows, checks from outside, the log's bad lines, and sinks that scan."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.functions import validators
from palisade.operators import rule_documents, scan
from palisade.plans.rules import BY_ID, Rule, RuleError, load
from palisade.sources import coverage_log, scan_and_write_clean, scan_and_write_redacted
from palisade.sources.readers import LONGEST_LINE

RULE = {"id": "a", "family": "pii", "description": "d", "regex": r"\d+", "enabled": True}


def document(*rules):
    return json.dumps({"rules": [RULE | r for r in rules]})


def test_all_problems_of_all_documents(spark):
    texts = [document({}), document({"family": "x", "entropy": -1}, {"id": "b", "enabled": None}), "{", None, "", document({}, {}), document({"id": "c"}), document({})]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, doc string").repartition(3)
    got = {}
    for r in rule_documents.problems(docs, "k", "doc").orderBy("k", "nth").collect():
        got.setdefault(r["k"], []).append(r["problem"])
    for k, text in enumerate(texts):
        try:
            load(text or "")
            want = []
        except RuleError as e:
            want = str(e).split("\n")
        assert got.get(k, []) == want
    assert len(got[1]) >= 3 and got[5] == ["a: id is used twice"]
    assert sorted(map(tuple, rule_documents.shared_ids(docs, "k", "doc").collect())) == [("a", 2, 0)]
    assert sorted(map(tuple, rule_documents.loaded_ids(docs, "k", "doc").collect())) == [(0, "a"), (6, "c"), (7, "a")]


def test_a_check_from_outside(spark):
    given = document({"id": "own", "regex": r"\b(\d{3})\b", "group": 1, "validators": ["not-seven"]})
    with pytest.raises(RuleError, match="unknown validator not-seven"):
        load(given)
    unknown = Rule("own", "pii", "d", r"\b(\d{3})\b", True, 1, (), (), 0.0, ("not-seven",))
    docs = spark.createDataFrame([(0, "123 777 999")], "id long, text string")
    with pytest.raises(KeyError):
        scan.findings(docs, "id", "text", [unknown])
    validators.register("not-seven", lambda v: F.when(v != "999", ~v.contains("7")))
    try:
        # a check that can't tell drops the candidate
        assert [r["offset"] for r in scan.findings(docs, "id", "text", load(given)).collect()] == [0]
        with pytest.raises(ValueError):
            validators.register("luhn", lambda v: F.lit(True))
        with pytest.raises(ValueError):
            validators.register("", lambda v: F.lit(True))
    finally:
        validators.REGISTRY.pop("not-seven")
        validators.REGISTERED.discard("not-seven")


def test_lines_of_a_log(spark, tmp_path):
    (tmp_path / "log.1").write_text(json.dumps({"reason": "first", "other": 1}) + "\n\nno json\n[1]\n{}\n")
    (tmp_path / "log").write_text(json.dumps({"reason": "x" * LONGEST_LINE}) + "\n" + json.dumps({"reason": "last", "operands": ["a"]}) + '\n{"reason": "cut')
    records, bad = coverage_log(spark, [str(tmp_path / "log.1"), str(tmp_path / "log")])
    assert sorted(str(r["reason"]) for r in records.collect()) == ["None", "first", "last"] and bad.first()["bad_lines"] == 4


def test_sinks_that_scan(spark, tmp_path):
    docs = spark.createDataFrame([(0, "to 8.8.8.8", "e"), (1, "none", "f"), (1, "none", "f"), (None, None, None)], "id long, text string, extra string")
    which = [BY_ID["ipv4-public"]]
    scan_and_write_clean(docs, "text", str(tmp_path / "clean"), which)
    scan_and_write_redacted(docs, "id", "text", str(tmp_path / "red"), which)
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(str(tmp_path / "clean")).collect()))) == ["(1, 'none', 'f')", "(1, 'none', 'f')", "(None, None, None)"]
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(str(tmp_path / "red")).collect()))) == ["(0, 'to [REDACTED:ipv4-public]')", "(1, 'none')", "(1, 'none')", "(None, None)"]
