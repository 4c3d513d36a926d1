"""Anchored matching: what the analysis claims, and that it changes no finding."""

import random
import re
import time

import pytest

from palisade.functions import matching as M
from palisade.operators import redact, scan
from palisade.plans.anchors import anchor, gate_is_implied, is_deep
from palisade.plans.patterns import for_python
from palisade.plans.rules import RULES, Rule, load

OWN = [
    r"id=(\d{4});", r"zz(\d+)?y", r"(?:ab|ac)(x+)(y?)", r"\b((?:ab|cd)+)\b", r"k(?:a(b+)c)d", r"(?:u(v)|w)z", r"pre([^;]*);", r"([0-9]{2})-(?:[0-9]{2})",
    r"a.{2}(é+)b", r"\b(tok_(?:live|test)_[a-z]{3,9})\b", r"x(a|b(c)?)+y", r"[ab]c(\d)",
]


def own_rules():
    for i, regex in enumerate(OWN):
        for group in range(re.compile(for_python(regex)).groups + 1):
            yield Rule(f"own-{i}-{group}", "pii", "own", regex, True, group)


def some_texts(n=250, seed=3):
    r = random.Random(seed)
    parts = ["id=", "1234", ";", "zz", "12", "y", "ab", "ac", "xx", "cd", "ka", "bb", "c", "d", "uv", "w", "z", "pre", "é", "日", " ", "\n", "tok_live_", "tok_test_", "abc", "x", "a", "b", "-", "3"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["x id=1234; y", "a zzy b", ""]


def full(rule, text):
    """By the plain engine over all bytes; absent groups give nothing."""
    raw = text.encode().decode("latin-1")
    return [m.span(rule.group) for m in re.finditer(for_python(rule.regex), raw) if m.span(rule.group)[0] >= 0]


def test_any_group_of_any_rule_is_placed_as_by_the_plain_engine(spark):
    texts, which = some_texts(), list(own_rules())
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in scan.findings(docs, "id", "text", which).collect():
        got.setdefault((r["id"], r["rule_id"]), []).append((r["offset"], r["end"]))
    for i, text in enumerate(texts):
        for rule in which:
            assert got.get((i, rule.id), []) == full(rule, text), (rule.regex, rule.group, text)


def test_redaction_hides_all_of_a_group(spark):
    docs = spark.createDataFrame([(0, "x id=1234; y"), (1, "a zzy b zz77y"), (2, "none"), (3, None)], "id long, text string")
    which = [Rule("mid", "pii", "own", OWN[0], True, 1), Rule("maybe", "pii", "own", OWN[1], True, 1)]
    got = {r["id"]: r["redacted"] for r in redact.redact(docs, "id", "text", which).collect()}
    assert got == {0: "x id=[REDACTED:mid]; y", 1: "a zzy b zz[REDACTED:maybe]y", 2: "none", 3: None}


@pytest.mark.parametrize("regex", [*(r.regex for r in RULES), *OWN])
def test_openings_and_reach_hold(regex):
    own, r = anchor(regex), random.Random(5)
    if own is None:
        return
    for text in some_texts(400, r.random()) + [x.decode("latin-1") + "A" * 100 for x in own.openings]:
        raw = text.encode()
        for m in re.finditer(for_python(regex).encode("latin-1"), raw):
            assert any(m[0].startswith(x) for x in own.openings) and (own.reach is None or len(m[0]) <= own.reach)


def test_which_rules_are_anchored():
    by_id = {r.id: r for r in RULES}
    anchored = {r.id for r in RULES if anchor(r.regex)}
    assert anchored == {r.id for r in RULES if r.family == "credential"}
    assert all(gate_is_implied(by_id[i].regex, by_id[i].keywords) for i in anchored)
    assert anchor(by_id["aws-access-key-id"].regex).openings == (b"ABIA", b"ACCA", b"AKIA", b"ASIA")
    assert anchor(by_id["openai-api-key"].regex).reach == 171 and anchor(by_id["private-key-block"].regex).reach is None
    assert anchor(r"(?i)abc") is None and anchor(r"\d{4}") is None and anchor(r"a?") is None
    assert not gate_is_implied(r"\b(id-\d+)", ("internal",)) and not gate_is_implied(r"(sk-\d+)", ("sk-",))


def test_openings_change_no_finding(spark):
    """Each rule at its openings alone, against all bytes; extents included."""
    r = random.Random(11)
    parts = ["AKIA", "ABCDEFGHIJKLMNOP", "ghp_", "a" * 36, "xoxb-", "sk-", "sk-ant-api03-", "T3BlbkFJ", "eyJ", "eyJhbGciOiJI", ".eyJzdWIiOiIx", ".abcdefghijkl", "-", "_", " ", "\n", "é", "AIza", "b" * 35, "123-45-6789", "1.2.3.4", "4111 1111 1111 1111"]
    for _ in range(1500):
        raw = "".join(r.choice(parts) for _ in range(r.randint(0, 14))).encode()
        for rule in RULES:
            compiled = M._Rule(0, rule, False)
            at_openings = list(compiled.spans(raw))
            compiled.openings = ()
            assert at_openings == list(compiled.spans(raw)), (rule.id, raw)


def test_gate_of_own_keywords_is_kept(spark):
    """A pattern that doesn't show its keyword is held to it, as a word's beginning, whatever its case."""
    rule = Rule("own", "credential", "own", r"\b(id-\d+)", True, 1, ("internal",))
    docs = spark.createDataFrame(list(enumerate(["id-1", "Internal id-22", "xinternal id-3", "_internal id-4", "id-5 INTERNAL"])), "id long, text string")
    assert {(r["id"], r["offset"]) for r in scan.findings(docs, "id", "text", [rule]).collect()} == {(1, 9), (4, 0)}


def test_deep_patterns_run_on_megabytes(spark):
    assert [is_deep(x) for x in (OWN[3], OWN[10], OWN[0], r"(?:ab){2,30}")] == [True, True, False, False]
    text = "abcd" * 250_000
    docs = spark.createDataFrame([(0, text), (1, "ab cd")], "id long, text string")
    for regex in (OWN[3], r"((?:[a-c]|d)+)"):
        got = {(r["id"], r["offset"], r["end"]) for r in scan.findings(docs, "id", "text", [Rule("deep", "pii", "own", regex, True, 1)]).collect()}
        assert got == {(0, 0, len(text)), (1, 0, 2), (1, 3, 5)}


def test_findings_and_redaction_are_linear(spark):
    rule = Rule("n", "pii", "own", r"\b(\d{6})\b", True, 1)
    seconds = []
    for n in (20_000, 80_000):
        text = " ".join(f"{i:06d}" for i in range(n))
        docs = spark.createDataFrame([(0, text)], "id long, text string")
        began = time.time()
        assert redact.redact(docs, "id", "text", [rule]).first()["redacted"] == " ".join(["[REDACTED:n]"] * n)
        seconds.append(time.time() - began)
    assert seconds[1] < 30


def test_hostile_tokens_are_linear():
    text = b"-eyJ" * 100_000
    began = time.time()
    rule = next(r for r in RULES if r.id == "jwt")
    assert list(M._Rule(0, rule, True).spans(text)) == [] and time.time() - began < 5


def test_patterns_over_bytes_are_not_looked_for_by_characters(spark):
    """Two bytes of one character are two for the rule."""
    docs = spark.createDataFrame([(0, "qéq"), (1, "qabq")], "id long, text string")
    got = {r["id"] for r in scan.findings(docs, "id", "text", [Rule("two", "pii", "own", r"q..q", True)]).collect()}
    assert got == {0, 1}


def test_loaded_rules_need_no_code():
    document = '{"rules": [{"id": "mid", "family": "pii", "description": "d", "regex": "id=(\\\\d{4});", "group": 1, "enabled": true}]}'
    assert [x.group for x in load(document)] == [1]
