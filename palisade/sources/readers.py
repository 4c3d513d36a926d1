"""Sources: files as binary content, call payloads, coverage logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = (
    "hook_event_name string, cwd string, session_id string, permission_mode string, prompt string, tool_name string, "
    "tool_input string"
)
TOOL_INPUT = "file_path string, command string, pattern string, path string, glob string, type string, output_mode string"
LOG = "time timestamp, event string, tool string, session_id string, cwd string, version string, reason string, operands array<string>"
EVENTS = ("PreToolUse", "UserPromptSubmit")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size, content: whole files, read where they are scanned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", F.col("length").alias("size"), "content")


def payloads(df: DataFrame, key: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """Calls, with their tool's inputs as columns, and the rows that are no payload: (key, refused).

    Unknown fields are passed over; text that isn't an object, or an event that is missing or unknown, is refused."""
    call: Column = F.from_json(F.col(raw), PAYLOAD)
    parsed = df.select(F.col(key).alias("call_id"), call.alias("p"), F.col(raw).alias("raw")).select("call_id", "raw", "p.*")
    known = F.coalesce(F.col("hook_event_name").isin(*EVENTS), F.lit(False))
    calls = parsed.where(known).withColumn("i", F.from_json("tool_input", TOOL_INPUT)).select(
        "call_id", F.col("hook_event_name").alias("event"), "cwd", "session_id", (F.col("permission_mode") == "bypassPermissions").alias("bypass"), "prompt", "tool_name", "i.*"
    )
    return calls, parsed.where(~known).select("call_id", F.lit("no known event").alias("refused"))


#: Fixed value: a line of more bytes than this is no record.
LONGEST_LINE = 4 << 20


def coverage_log(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The log's records, and one row that counts the lines which are none: no JSON object, or longer than LONGEST_LINE.
    Empty lines are neither. Fields that are missing are null, and those that aren't known are passed over."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(list(paths)).where("trim(value) <> ''").withColumn("fits", F.octet_length("value") <= LONGEST_LINE)
    read = lines.select("fits", F.from_json(F.when(F.col("fits"), F.col("value")), f"{LOG}, _bad string", options).alias("r"))
    bad = ~F.col("fits") | F.col("r._bad").isNotNull() | F.col("r").isNull()
    return read.where(~bad).select("r.*").drop("_bad"), read.agg(F.count_if(bad).alias("bad_lines"))
