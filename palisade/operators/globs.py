"""File name patterns met with an inventory of paths, as a shell expands them by default."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Why a pattern isn't expanded.
BRACES, NAMED_CLASS = "braces are not expanded", "named classes are not expanded"
_COMPILED = "struct<prefix:string,depth:int,regex:string,literal:string,refused:string>"


def compiled(pattern: str, deep: bool = False) -> tuple[str, int | None, str, str, str | None]:
    """prefix (the directory before the first segment with a wildcard), depth (slashes of what it matches; None: any),
    regex over whole paths, the literal path that it may also be, and why it is refused, if it is.

    `*` and `?` stay within a segment, and begin none that begins with a dot: that dot has to be written. A class may be
    negated by ! or ^; one that isn't closed is literal. A backslash makes the next character literal. `**` is `*`, or,
    with deep, any number of whole directories where it is a segment of its own."""
    out, prefix, held, literal, refused = [], [], "", "", None
    i, n, segment_start, wild, any_depth = 0, len(pattern), True, False, False
    while i < n:
        c = pattern[i]
        hidden = r"(?!\.)" if segment_start else ""
        if c == "/":
            if not wild:
                prefix.append(held)
            held = ""
            out.append("/")
            literal += c
            segment_start, i = True, i + 1
            continue
        if deep and segment_start and pattern[i : i + 3] == "**/":
            wild = any_depth = True
            out.append(r"(?:(?!\.)[^/]+/)*")
            literal, i = literal + "**/", i + 3
            continue
        if c == "\\" and i + 1 < n:
            out.append(re.escape(pattern[i + 1]))
            held, literal, i = held + pattern[i + 1], literal + pattern[i + 1], i + 2
        elif c in "*?":
            wild = True
            size = 1
            if c == "*":
                while pattern[i + size : i + size + 1] == "*":
                    size += 1
            out.append(hidden + ("[^/]*" if c == "*" else "[^/]"))
            literal, i = literal + pattern[i : i + size], i + size
        elif c == "[":
            first = i + 1 + (pattern[i + 1 : i + 2] in ("!", "^"))
            end = pattern.find("]", first + 1)
            inside = pattern[i + 1 : end] if end > 0 else ""
            if end > 0 and "/" not in inside:
                if "[:" in inside or "[." in inside or "[=" in inside:
                    refused = refused or NAMED_CLASS
                wild = True
                negated, own = inside[:1] in ("!", "^"), inside[1:] if inside[:1] in ("!", "^") else inside
                own = re.sub(r"([\\\[\]^&~|])", r"\\\1", own)
                out.append(hidden + (f"(?=[^/])[^{own}]" if negated else f"[{own}]"))
                literal, i = literal + pattern[i : end + 1], end + 1
            else:
                out.append(r"\[")
                held, literal, i = held + c, literal + c, i + 1
        else:
            if c == "{" and re.match(r"\{[^{}/]*(,|\.\.)[^{}]*\}", pattern[i:]):
                refused = refused or BRACES
            out.append(re.escape(c))
            held, literal, i = held + c, literal + c, i + 1
        segment_start = False
    return "/".join(prefix), None if any_depth else literal.count("/"), f"^{''.join(out)}$", literal, refused


def _compiled(pattern: Column, deep: bool) -> Column:
    @F.arrow_udf(_COMPILED)
    def run(patterns: pa.Array) -> pa.Array:
        names = ("prefix", "depth", "regex", "literal", "refused")
        rows = [dict(zip(names, compiled(x.as_py(), deep))) if x.is_valid else None for x in patterns]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.array(rows, pa.struct(list(zip(names, kinds))))

    return run(pattern)


def expanded(asked: DataFrame, key: str, pattern: str, inventory: DataFrame, path: str = "path", deep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, path): the paths that each pattern matches, and (key, refused): patterns that aren't expanded, which are not
    clean but unknown. A pattern also matches the path that it literally is. Paths are absolute, or relative alike.

    A pattern meets only paths below its literal directory: each path goes under its ancestors, of which only those that
    some pattern begins with are kept, and patterns without ** only those of their own depth."""
    made = asked.select(F.col(key).alias("key"), _compiled(F.col(pattern), deep).alias("g")).where("g IS NOT NULL").select("key", "g.*")
    wanted = made.where("refused IS NULL")
    names = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    paths = inventory.select(F.col(path).alias("path")).distinct().withColumn("slashes", F.size(names) - 1)
    under = paths.select("path", "slashes", F.explode(F.array_distinct(above)).alias("prefix"))
    met = wanted.join(under, "prefix").where((F.col("depth").isNull() | (F.col("depth") == F.col("slashes"))) & F.rlike("path", "regex"))
    same = wanted.join(paths, wanted["literal"] == paths["path"])
    found = met.select("key", "path").unionByName(same.select("key", "path")).distinct()
    return found.withColumnRenamed("key", key), made.where("refused IS NOT NULL").select(F.col("key").alias(key), "refused")
