"""A verdict for each call, from what was found and what could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import BINARY, READ, READ_RAW
from palisade.operators.paths import guarded_class, resolved
from palisade.operators.scan import withheld

#: Skips that don't block.
ALLOWED_SKIPS = (READ, BINARY, READ_RAW)
TOOL, PROMPT = "PreToolUse", "UserPromptSubmit"
LISTED = 10


def targets(calls: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What calls would send: (call_id, label, content) to scan, and (call_id, gap, refusal) of what can't be
    read or is refused by its name.

    calls: call_id, cwd, tool_name and the inputs file_path, command, pattern, path, glob, type, output_mode (null
    where a tool has none). inventory: path, kind (file, dir, other), content. A read's own words are scanned with
    the file; a search sends content only in content mode; shell commands are scanned as text, and what they
    would read is said to be a gap. Absent files are no gap: nothing is sent."""
    c = F.col
    label = {"Read": [("<file_path>", "file_path")], "Bash": [("<command>", "command")], "PowerShell": [("<command>", "command")], "Grep": [(f"<{x}>", x) for x in ("pattern", "path", "glob", "type")]}
    words = F.array(*(F.when(c("tool_name") == tool, F.struct(F.lit(name).alias("label"), c(col).alias("text"))) for tool, own in label.items() for name, col in own))
    spoken = calls.select("call_id", F.explode(F.filter(words, lambda x: x["text"].isNotNull())).alias("w")).select("call_id", "w.label", F.encode("w.text", "UTF-8").alias("content"))

    reading, searching = c("tool_name") == "Read", (c("tool_name") == "Grep") & ~F.coalesce(F.nullif("output_mode", F.lit("")), F.lit("files_with_matches")).isin("files_with_matches", "count")
    goal = F.when(reading, c("file_path")).when(searching, F.coalesce(F.nullif("path", F.lit("")), c("cwd")))
    full = F.when(reading, F.when(goal.startswith("/"), goal)).otherwise(resolved(goal, c("cwd"), F.lit("/home")))
    asked = calls.select("call_id", "tool_name", goal.alias("goal"), full.alias("at"))
    met = asked.join(inventory.withColumnRenamed("path", "at"), "at", "left")
    gap = (
        F.when(c("tool_name").isin("Bash", "PowerShell"), F.concat(F.lit("what the "), c("tool_name"), F.lit(" command reads was not followed")))
        .when((c("tool_name") == "Read") & c("goal").isNull(), "the call names no file")
        .when(c("goal").isNotNull() & c("at").isNull(), "the path can't be resolved")
        .when((c("tool_name") == "Read") & (c("kind") == "dir"), "the call names a directory")
        .when(c("kind") == "other", "the call names neither a file nor a directory")
    )
    refusal = F.when((c("tool_name") == "Grep") & (c("kind") == "dir"), "a content search over a directory").when(c("kind") == "file", guarded_class(c("at")))
    judged = met.withColumn("gap", gap).withColumn("refusal", refusal)
    files = judged.where((c("kind") == "file") & c("refusal").isNull() & c("gap").isNull()).select("call_id", withheld(c("at")).alias("label"), c("content").cast("binary").alias("content"))
    return spoken.unionByName(files), judged.where("gap IS NOT NULL OR refusal IS NOT NULL").select("call_id", "gap", "refusal")


def blocking(skip: Column) -> Column:
    return ~skip.isin(*ALLOWED_SKIPS)


def verdicts(calls: DataFrame, found: DataFrame, skips: DataFrame, troubles: DataFrame) -> DataFrame:
    """call_id, verdict, reason, notice: one row for each call.

    calls: call_id, event, override (null: none; empty: without a reason), bypass (permissions are bypassed).
    found: call_id, rule_id; skips: call_id, skip; troubles: call_id, gap, refusal. In order: an override without a
    reason denies; a refusal, then a finding, is decided; a gap or a blocking skip abstains; other skips are
    noticed; else the call is allowed in silence. Decided: denied, or asked where overridden and not bypassed."""
    c = F.col
    flags = (
        calls.join(found.groupBy("call_id").agg(F.count("*").alias("findings"), F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, LISTED), ", ").alias("rules")), "call_id", "left")
        .join(skips.groupBy("call_id").agg(F.count_if(blocking(c("skip"))).alias("unread"), F.count_if(~blocking(c("skip")) & (c("skip") != READ)).alias("passed_over")), "call_id", "left")
        .join(troubles.groupBy("call_id").agg(F.min("gap").alias("gap"), F.min("refusal").alias("refusal")), "call_id", "left")
        .na.fill(0, ["findings", "unread", "passed_over"])
    )
    decided = F.when(c("override").isNotNull() & ~F.coalesce(c("bypass"), F.lit(False)) & (c("event") == TOOL), "ask").otherwise("deny")
    verdict = (
        F.when(c("override") == "", "deny")
        .when(c("refusal").isNotNull() | (c("findings") > 0), decided)
        .when(c("gap").isNotNull() | (c("unread") > 0), "abstain")
        .when(c("passed_over") > 0, "notice")
        .otherwise("allow")
    )
    reason = (
        F.when(c("override") == "", "the override gives no reason")
        .when(c("refusal").isNotNull(), F.concat(F.lit("refused: "), c("refusal")))
        .when(c("findings") > 0, F.concat(c("findings").cast("string"), F.lit(" found: "), c("rules")))
        .when(c("gap").isNotNull(), c("gap"))
        .when(c("unread") > 0, F.concat(c("unread").cast("string"), F.lit(" could not be read")))
    )
    notice = F.when((c("passed_over") > 0) & c("gap").isNull(), F.concat(c("passed_over").cast("string"), F.lit(" binary, not read as text"))).when(c("gap").isNotNull() & (c("findings") > 0), c("gap"))
    return flags.select("call_id", "event", verdict.alias("verdict"), reason.alias("reason"), notice.alias("notice"), "findings")


def places(found: DataFrame, most: int = LISTED) -> DataFrame:
    """call_id, places from findings (call_id, label, rule_id, offset): the first of them by label and place, as text,
    and how many more there are."""
    every = found.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("label", "offset", "rule_id"))).alias("every"))
    listed = F.transform(F.slice("every", 1, most), lambda x: F.format_string("%s in %s at byte %d", x["rule_id"], x["label"], x["offset"]))
    more = F.size("every") - most
    told = F.array_join(listed, "; ")
    return every.select("call_id", F.when(more > 0, F.format_string("%s; and %d more", told, more)).otherwise(told).alias("places"))


def as_json(decided: DataFrame) -> DataFrame:
    """call_id, output: the verdict as its event's JSON object; nothing for calls that are allowed or abstained."""
    c = F.col
    tool = F.struct(
        F.struct(F.lit(TOOL).alias("hookEventName"), c("verdict").alias("permissionDecision"), c("reason").alias("permissionDecisionReason")).alias("hookSpecificOutput"),
        c("notice").alias("systemMessage"),
    )
    prompt = F.struct(F.lit("block").alias("decision"), F.concat_ws(" ", "reason", "notice").alias("reason"))
    output = (
        F.when(c("verdict").isin("deny", "ask") & (c("event") == TOOL), F.to_json(tool))
        .when(c("verdict").isin("deny", "ask"), F.to_json(prompt))
        .when(c("verdict") == "notice", F.to_json(F.struct(c("notice").alias("systemMessage"))))
    )
    return decided.select("call_id", output.alias("output")).where("output IS NOT NULL")
