import json

from pyspark.sql import functions as F

from palisade.operators import coverage, paths, prompts, verdict
from palisade.sources import append_coverage, coverage_log, files, payloads, write_clean


def values(spark, items, f, kind="string"):
    return [r[0] for r in spark.createDataFrame(list(enumerate(items)), f"i long, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_at_tokens(spark):
    got = values(spark, ["@a b @c/d", "me@x.org", "x @e", "﻿@f", "@", "@a@b", "a\n@g,"], prompts.at_tokens)
    assert got == [["a", "c/d"], [], ["e"], ["f"], [], ["a@b"], ["g,"]]
    assert values(spark, ["a.b).", "/", "..."], prompts.token_candidates) == [["a.b).", "a.b)", "a.b"], ["/"], ["...", "..", "."]]


def test_named_files(spark):
    p = spark.createDataFrame([(1, "see @x.txt, and @d @x.txt", "/w"), (2, "@/w/none", "/w")], "id long, prompt string, cwd string")
    inventory = spark.createDataFrame([("/w/x.txt", "file", b"hi"), ("/w/d", "dir", None), ("/w/d/b", "file", b""), ("/w/d/a", "file", b"")], "path string, kind string, content binary")
    got = {(r["id"], r["path"]): bytes(r["content"]) for r in prompts.named_files(p, "id", "prompt", inventory, "cwd").collect()}
    assert got == {(1, "/w/x.txt"): b"hi", (1, "/w/d"): b"a\nb"}


def test_paths(spark):
    assert values(spark, ["/a/.env", ".env.local", "x/.env.dist", "/h/.aws/credentials", "credentials", "_netrc", "a.kubeconfig", ".kube/config", "config"], paths.guarded_class) == [
        "dotenv", "dotenv", None, "AWS credentials", None, "netrc", "kubeconfig", "kubeconfig", None,
    ]
    assert values(spark, ["~/a", "/x/../y//z", "b/./c", ""], lambda v: paths.resolved(v, F.lit("/w"), F.lit("/h"))) == ["/h/a", "/y/z", "/w/b/c", "/w"]


def test_reason_class(spark):
    got = values(spark, [r'reading "a \"grep\" file"', r'x \"/a/b\" y', "at /tmp/a/b, twice", 'plain "q"', "one /tmp only"], coverage.reason_class)
    assert got == ['reading a "grep" file', 'x "…" y', 'at "…", twice', "plain q", "one /tmp only"]


def test_versions(spark):
    order = ["v1.0.0-alpha", "1.0.0-alpha.1", "v1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1+build"]
    bad = ["1.0", "dev", "1.0.0-", "01.0.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order + bad)], "i long, v string").withColumn("k", coverage.version_key(F.col("v")))
    assert [r["i"] for r in df.where("k IS NOT NULL").orderBy("k").collect()] == list(range(len(order)))


def test_log_round_trip(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-02 00:00:00' AS time, 'e' AS event, 'v1.2.0' AS version, 'at /a/b/c' AS reason UNION ALL SELECT timestamp'2026-01-03 00:00:00', 'e', 'dev', 'at /x/y'")
    append_coverage(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "more.json").write_text("not json\n")
    log, bad = coverage_log(spark, [str(tmp_path / "log")])
    assert log.count() == 2 and bad.first()["bad_lines"] == 1
    assert [(r["reason"], r["n"], r["percent"]) for r in coverage.summary(log).collect()] == [('at "…"', 2, 100.0)]
    kept, rest = coverage.since(log, "2026-01-03")
    assert kept.count() == 1 and rest.first().asDict() == {"older": 1, "unversioned": 0}
    kept, rest = coverage.since(log, "v1.0.0")
    assert kept.count() == 1 and rest.first().asDict() == {"older": 0, "unversioned": 1}


def test_verdict_order(spark):
    calls = [(0, "PreToolUse", None, False), (1, "PreToolUse", "", False), (2, "PreToolUse", "why", False), (3, "PreToolUse", "why", True), (4, "UserPromptSubmit", None, False), (5, "PreToolUse", None, False), (6, "PreToolUse", None, False), (7, "PreToolUse", None, False)]
    calls = spark.createDataFrame(calls, "call_id long, event string, override string, bypass boolean")
    found = spark.createDataFrame([(i, "r") for i in (0, 2, 3, 4)], "call_id long, rule_id string")
    skips = spark.createDataFrame([(5, "utf-32"), (6, "binary"), (0, "utf-32")], "call_id long, skip string")
    none = spark.createDataFrame([(2, None, "refused")], "call_id long, gap string, refusal string")
    decided = verdict.verdicts(calls, found, skips, none)
    assert {r["call_id"]: r["verdict"] for r in decided.collect()} == {0: "deny", 1: "deny", 2: "ask", 3: "deny", 4: "deny", 5: "abstain", 6: "notice", 7: "allow"}
    out = {r["call_id"]: json.loads(r["output"]) for r in verdict.as_json(decided).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 6} and out[4]["decision"] == "block" and out[2]["hookSpecificOutput"]["permissionDecision"] == "ask"


def test_payloads_and_targets(spark):
    def call(tool, **given):
        return json.dumps({"hook_event_name": "PreToolUse", "cwd": "/w", "tool_name": tool, "tool_input": given, "unknown": 1})

    raw = [call("Read", file_path="/w/.env"), call("Read", file_path="a"), call("Read", file_path="/w/f"), call("Bash", command="ls"), call("Grep", pattern="x"), call("Grep", pattern="x", output_mode="content"), call("Other"), "not json", "{}"]
    df = spark.createDataFrame(list(enumerate(raw)), "id long, raw string")
    calls, refused = payloads(df, "id", "raw")
    assert {r["call_id"] for r in refused.collect()} == {7, 8}
    inventory = spark.createDataFrame([("/w/.env", "file", b"A"), ("/w/f", "file", b"B"), ("/w", "dir", None)], "path string, kind string, content binary")
    sent, troubles = verdict.targets(calls, inventory)
    assert {(r["call_id"], r["label"]) for r in sent.collect()} == {(0, "<file_path>"), (1, "<file_path>"), (2, "<file_path>"), (2, "/w/f"), (3, "<command>"), (4, "<pattern>"), (5, "<pattern>")}
    got = {r["call_id"]: (r["gap"] is not None, r["refusal"] is not None) for r in troubles.collect()}
    assert got == {0: (False, True), 1: (True, False), 3: (True, False), 5: (False, True)}


def test_files_and_clean_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"8.8.8.8")
    read = files(spark, str(tmp_path / "in"), "*.txt")
    assert [(r["size"], bytes(r["content"])) for r in read.collect()] == [(7, b"8.8.8.8")]
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    write_clean(docs, spark.createDataFrame([(1,)], "id long"), "id", str(tmp_path / "out"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
