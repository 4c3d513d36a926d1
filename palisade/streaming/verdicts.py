"""Verdicts on calls whose buffers come as a stream: decided as soon as they can be, or given up at a deadline."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions.matching import may_match
from palisade.operators.scan import found_in
from palisade.operators.verdict import LISTED, blocking
from palisade.plans.rules import Rule, rules
from palisade.sources.shared import shared_dir

#: What is kept of a call: the buffers seen, what they showed, when it is given up, and whether it is decided.
STATE = "seen array<long>, parts long, findings long, rules array<string>, unread long, passed_over long, override string, deadline long, decided boolean"
EXPIRED = "not all of it came in time"


def stream_verdicts(
    stream: DataFrame, call: str = "call_id", time: str = "time", text: str = "text", which: Sequence[Rule] | None = None, deadline_seconds: int = 600, late: str = "1 minute"
) -> DataFrame:
    """call, verdict, reason, findings, seen, missing, expired: one row for each call, as soon as it is decided.

    A row of the stream is a buffer of a call: part (its number), parts (how many there are), text, time, and, if there
    are such columns, skip (why it could not be read) and override. Buffers come in any order and more than once. Texts
    are scanned where they come; only the names of rules go to the call's state. A finding decides at once (deny, or ask
    under an override); else the last buffer does: abstain where one could not be read, notice where one was passed over,
    allow in silence. What is open `deadline_seconds` after a call's first buffer, by event time, is abstained from, as
    expired. A call's state is kept as long again, so that buffers which come after its verdict change nothing; then it goes."""
    which = list(which if which is not None else rules())
    given = {c: F.col(c) if c in stream.columns else F.lit(None).cast("string") for c in ("skip", "override")}
    found = found_in(F.when(may_match(which, F.col(text)), F.col(text)), which)
    rows = stream.withWatermark(time, late).select(
        F.col(call).alias("call"), F.col(time).alias("time"), F.unix_millis(time).alias("at"), F.col("part").cast("long").alias("part"), F.col("parts").cast("long").alias("parts"),
        F.array_distinct(found["rule_id"]).alias("rules"), F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n"),
        F.coalesce(blocking(given["skip"]), F.lit(False)).alias("unread"), F.coalesce(~blocking(given["skip"]) & (given["skip"] != ""), F.lit(False)).alias("passed_over"), given["override"].alias("override"),
    )
    kind = rows.schema["call"].dataType.simpleString()
    length = deadline_seconds * 1000

    def told(call, s: dict, verdict: str, reason: str | None, expired: bool) -> pd.DataFrame:
        seen = len(s["seen"])
        return pd.DataFrame({"call": [call], "verdict": [verdict], "reason": [reason], "findings": [s["findings"]], "seen": [seen], "missing": [max(0, s["parts"] - seen)], "expired": [expired]})

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATE.split(", ")]
        if state.hasTimedOut:
            s = dict(zip(names, state.get))
            if s["decided"]:
                state.remove()
                return
            yield told(key[0], s, "abstain", EXPIRED, True)
            s["decided"] = True
            state.update(tuple(s[x] for x in names))
            state.setTimeoutTimestamp(max(s["deadline"] + length, state.getCurrentWatermarkMs() + 1))
            return
        s = dict(zip(names, state.get)) if state.exists else dict(zip(names, ([], 0, 0, [], 0, 0, None, 0, False)))
        if not s["decided"] and state.exists and s["deadline"] <= state.getCurrentWatermarkMs():
            # new buffers keep a timer from going off; what they bring is too late all the same
            yield told(key[0], s, "abstain", EXPIRED, True)
            s["decided"] = True
        seen, met = set(s["seen"]), set(s["rules"])
        first = not state.exists
        for part in parts:
            # columns as lists: calls have few buffers each, and rows as tuples cost more than what is done with them
            for at, nth, parts_, rules_, n, unread, passed_over, override in zip(*(part[x].tolist() for x in ("at", "part", "parts", "rules", "n", "unread", "passed_over", "override"))):
                s["deadline"] = min(s["deadline"] or at + length, at + length) if first else s["deadline"]
                if nth in seen:
                    continue
                seen.add(int(nth))
                met.update(rules_ if rules_ is not None else ())
                s["parts"] = max(s["parts"], int(parts_))
                s["findings"] += int(n)
                s["unread"] += int(unread)
                s["passed_over"] += int(passed_over)
                s["override"] = override or s["override"]
        s["seen"], s["rules"] = sorted(seen), sorted(met)
        if not s["decided"]:
            if s["findings"]:
                s["decided"] = True
                yield told(key[0], s, "ask" if s["override"] else "deny", f"{s['findings']} found: {', '.join(s['rules'][:LISTED])}", False)
            elif len(seen) >= s["parts"]:
                s["decided"] = True
                verdict, reason = ("abstain", f"{s['unread']} could not be read") if s["unread"] else ("notice", f"{s['passed_over']} not read as text") if s["passed_over"] else ("allow", None)
                yield told(key[0], s, verdict, reason, False)
        state.update(tuple(s[x] for x in names))
        due = s["deadline"] + (length if s["decided"] else 0)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    out = f"call {kind}, verdict string, reason string, findings long, seen long, missing long, expired boolean"
    decided = rows.groupBy("call").applyInPandasWithState(decide, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumnRenamed("call", call)


def expired_records(decided: DataFrame, call: str, version: str) -> DataFrame:
    """A coverage record for each call that was given up: time, event, version, reason and the call."""
    return decided.where("expired").select(F.current_timestamp().alias("time"), F.col(call).cast("string").alias("session_id"), F.lit(version).alias("version"), "reason")


def finished(stream: DataFrame) -> DataFrame:
    """What a stream gives of all that is there now, as a table: written to the shared folder, where a run that is
    broken off can go on from."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
