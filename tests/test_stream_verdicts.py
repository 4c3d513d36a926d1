"""Calls as streams of buffers, in any order and over several batches."""

import itertools
from datetime import datetime, timedelta

from palisade.functions.text import BINARY, UTF32
from palisade.plans.rules import BY_ID
from palisade.streaming.verdicts import EXPIRED, expired_records, finished, stream_verdicts

SCHEMA = "call_id string, part int, parts int, time timestamp, text string, skip string, override string"
START = datetime(2026, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, folder, batches):
    """All rows that come of files which are read one a batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    return finished(stream_verdicts(stream, which=[BY_ID["ipv4-public"]], deadline_seconds=60, late="10 seconds"))


def buffers(call, parts, *rows, override=None):
    return [(call, part, parts, at(s), text, skip, override) for part, s, text, skip in rows]


def test_verdicts_by_order_of_arrival(spark, tmp_path):
    one = buffers("clean", 2, (1, 2, "b", None)) + buffers("hit", 3, (2, 3, "to 8.8.8.8 and 9.9.9.9", None)) + buffers("asked", 1, (0, 1, "8.8.8.8", None), override="checked")
    two = buffers("clean", 2, (0, 4, "a", None), (0, 5, "a", None)) + buffers("hit", 3, (0, 6, "to 8.8.4.4", None)) + buffers("lost", 2, (0, 6, "x", None)) + buffers("dark", 1, (0, 7, None, UTF32)) + buffers("blob", 1, (0, 7, None, BINARY))
    three = buffers("tick", 1, (0, 500, "later", None))
    four = buffers("lost", 2, (1, 510, "8.8.8.8 too late", None)) + buffers("tack", 1, (0, 1000, "", None))
    decided = run(spark, tmp_path, [one, two, three, four])
    got = {r["call_id"]: r for r in decided.collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"clean": "allow", "hit": "deny", "asked": "ask", "lost": "abstain", "dark": "abstain", "blob": "notice", "tick": "allow", "tack": "allow"}
    assert (got["hit"]["reason"], got["hit"]["seen"], got["hit"]["missing"]) == ("2 found: ipv4-public", 1, 2)
    assert (got["lost"]["reason"], got["lost"]["expired"], got["lost"]["missing"]) == (EXPIRED, True, 1)
    assert decided.count() == 8
    assert [r["session_id"] for r in expired_records(decided, "call_id", "v1").collect()] == ["lost"]


def test_any_order_of_buffers_in_one_batch(spark, tmp_path):
    rows = []
    for i, order in enumerate(itertools.permutations(range(3))):
        rows += buffers(f"c{i}", 3, *((p, k, "8.8.8.8" if p == 1 else "x", None) for k, p in enumerate(order)))
        rows += buffers(f"d{i}", 3, *((p, k, "x", None) for k, p in enumerate(order)))
    got = {r["call_id"]: r["verdict"] for r in run(spark, tmp_path, [rows]).collect()}
    assert got == {**{f"c{i}": "deny" for i in range(6)}, **{f"d{i}": "allow" for i in range(6)}}
