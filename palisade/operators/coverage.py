"""The coverage log: what could not be read, by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.scan import withheld

#: A path outside quotes: a slash, or a drive and a backslash, and two separators or more before it ends.
_IN_PATH = r"""[^\s,;:()"/\\]"""
_BARE_PATH = rf"(?:[A-Za-z]:(?=\\)|(?=/))(?:[/\\]{_IN_PATH}*){{2,}}"
# Times that a user may write.
TIMES = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
ELIDED = '"…"'


def reason_class(reason: Column) -> Column:
    """A reason without what differs from place to place: paths go, command names and the reason's words stay.

    Escaped quotes enclose a name, which stays unless it is a path; plain quotes are dropped, their text stays."""
    inner = r'\\"((?:(?!\\").)*)\\"'
    path = r'\\"(?:(?!\\").)*[/\\](?:(?!\\").)*\\"'
    c = F.regexp_replace(reason, f"(?s){path}", "\x01…\x01")
    c = F.regexp_replace(c, f"(?s){inner}", "\x01$1\x01")
    c = F.regexp_replace(c, r'(?s)\\".*$', "")
    c = F.translate(F.replace(c, F.lit('"'), F.lit("")), "\x01", '"')
    return F.trim(F.regexp_replace(c, _BARE_PATH, ELIDED))


def parsed_time(text: Column) -> Column:
    """A time in any of TIMES, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(t)) for t in TIMES))


def version_key(version: Column) -> Column:
    """A release version as something that sorts by precedence; null unless it is one (a `v` may lead, build
    data is dropped). A prerelease comes before its release; numeric parts before words, fewer parts first."""
    v = F.regexp_replace(F.regexp_replace(version, "^v", ""), r"\+.*$", "")
    number = r"(?:0|[1-9][0-9]*)"
    core = F.regexp_extract(v, rf"^({number}\.{number}\.{number})(?:-.+)?$", 1)
    pre = F.regexp_extract(v, "^[^-]*-(.+)$", 1)
    part = lambda x: F.struct(x.try_cast("long").isNull().alias("word"), F.coalesce(x.try_cast("long"), F.lit(0)).alias("number"), F.when(x.try_cast("long").isNull(), x).otherwise("").alias("text"))
    none = F.array().cast("array<struct<word:boolean,number:bigint,text:string>>")
    parts = F.when(pre == "", none).otherwise(F.transform(F.split(pre, r"\."), part))
    return F.when(core != "", F.struct(F.transform(F.split(core, r"\."), lambda x: x.cast("long")).alias("core"), (pre == "").alias("release"), parts.alias("pre")))


def summary(log: DataFrame, reason: str = "reason", time: str = "time") -> DataFrame:
    """reason, n, percent, first, last: a row for each class of reasons, commonest first."""
    counted = log.groupBy(reason_class(F.col(reason)).alias("reason")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    total = counted.agg(F.sum("n").alias("total"))
    # one row: the total
    return counted.join(F.broadcast(total)).select("reason", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"), "first", "last").orderBy(F.desc("n"), "reason")


def since(log: DataFrame, bound: str, time: str = "time", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """Rows from a time or version on, and one row that counts the others (older, unversioned)."""
    spark = log.sparkSession
    at = spark.range(1).select(parsed_time(F.lit(bound)).alias("t"), version_key(F.lit(bound)).isNotNull().alias("v")).first()
    if at["t"] is not None:
        keep, unversioned = F.col(time) >= F.lit(at["t"]), F.lit(False)
    elif at["v"]:
        keep, unversioned = version_key(F.col(version)) >= version_key(F.lit(bound)), version_key(F.col(version)).isNull()
    else:
        raise ValueError(f"{bound} is neither a time nor a version")
    keep = F.coalesce(keep, F.lit(False))
    return log.where(keep), log.agg(F.count_if(~keep & ~unversioned).alias("older"), F.count_if(unversioned).alias("unversioned"))


def records(calls: DataFrame, decided: DataFrame, time: Column, version: str) -> DataFrame:
    """A log record for each call that was abstained from: what a person should know was not looked at.

    calls: call_id, event, cwd, session_id, tool_name, file_path, path; decided: the verdicts. Names that hold a
    finding themselves are withheld."""
    c = F.col
    named = F.filter(F.array("file_path", "path"), lambda x: x.isNotNull())
    open_ = calls.join(decided.where("verdict = 'abstain'").select("call_id", "reason"), "call_id")
    name = F.explode_outer(named).alias("name")
    shown = open_.select("*", name).withColumn("name", withheld(c("name")))
    return shown.groupBy("call_id").agg(
        F.first("event").alias("event"), F.first("tool_name").alias("tool"), F.first("session_id").alias("session_id"), F.first("cwd").alias("cwd"),
        F.first("reason").alias("reason"), F.array_sort(F.collect_list("name")).alias("operands"),
    ).select(time.alias("time"), "event", "tool", "session_id", withheld(c("cwd")).alias("cwd"), F.lit(version).alias("version"), "reason", "operands")
