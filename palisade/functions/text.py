"""Texts as bytes: one character a byte, ASCII folding, what can't be read, places."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

#: Bytes that are looked at to tell binary content, and the most that are matched raw.
SNIFFED = 8192
RAW_LIMIT = 32 << 20
#: Why content was not read as text; an empty string says that it was.
READ, BINARY, UTF32, UTF16_BINARY, READ_RAW = "", "binary", "utf-32", "utf-16 binary", "read raw"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch that goes to Python.
BATCH = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session bounds the bytes of Arrow batches: texts may be long, and a worker holds a batch in several
    forms. It only ever lowers the session's setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name).lower().removesuffix("b")) > BATCH:
        df.sparkSession.conf.set(name, str(BATCH))
    return df


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_view(x: Column | str) -> Column:
    """One character for each byte of the text's UTF-8 (or of binary content): places count bytes."""
    return F.decode(column(x).cast("binary"), "ISO-8859-1")


def ascii_lower(x: Column | str) -> Column:
    """A-Z alone: lower() would also turn the Kelvin sign into k."""
    return F.translate(column(x), _UPPER, _LOWER)


def line_number(view: Column, offset: Column) -> Column:
    """The line of a place in a byte view, from 1."""
    return (F.length(F.regexp_replace(F.substring(view, F.lit(1), offset.cast("int")), "[^\n]", "")) + 1).cast("long")


def _starts(content: Column, mark: str) -> Column:
    return F.hex(F.substring(content, 1, len(mark) // 2)) == mark


def encoding(content: Column | str) -> Column:
    """By its first bytes: utf-32le, utf-32be, utf-16le, utf-16be or raw; four-byte marks are looked at first."""
    c = column(content)
    return (
        F.when(_starts(c, "FFFE0000"), "utf-32le")
        .when(_starts(c, "0000FEFF"), "utf-32be")
        .when(_starts(c, "FFFE"), "utf-16le")
        .when(_starts(c, "FEFF"), "utf-16be")
        .otherwise("raw")
    )


@F.arrow_udf(BinaryType())
def utf16_to_utf8(content: pa.Array, kind: pa.Array) -> pa.Array:
    """UTF-16 after its mark, null for other kinds; lone surrogates become U+FFFD, a last odd byte is dropped."""

    def one(c: bytes | None, k: str | None) -> bytes | None:
        if c is None or not (k or "").startswith("utf-16"):
            return None
        return c[2 : len(c) // 2 * 2].decode(k, "replace").encode()

    return pa.array((one(c.as_py(), k.as_py()) for c, k in zip(content, kind, strict=True)), pa.binary())


def has_nul(content: Column) -> Column:
    return F.instr(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1"), "\x00") > 0


def decoded(content: Column | str) -> Column:
    """Content as UTF-8 bytes where it is UTF-16, else as it is. Other content does not go to Python."""
    c = column(content)
    kind = encoding(c)
    wide = kind.startswith("utf-16")
    return F.when(wide, utf16_to_utf8(F.when(wide, c), kind)).otherwise(c)


def skipped(content: Column | str, include_binary: bool = False) -> Column:
    """READ, or why content can't be read as text. include_binary: content with NUL bytes is matched all the
    same, up to RAW_LIMIT, and says so. Of UTF-16, no more is decoded than what is looked at."""
    c = column(content)
    kind = encoding(c)
    binary = F.when(F.lit(include_binary) & (F.octet_length(c) <= RAW_LIMIT), READ_RAW).otherwise(BINARY)
    return (
        F.when(kind.startswith("utf-32"), UTF32)
        .when(kind.startswith("utf-16"), F.when(has_nul(decoded(F.substring(c, 1, 2 + 2 * SNIFFED))), UTF16_BINARY).otherwise(READ))
        .when(has_nul(c), binary)
        .otherwise(READ)
    )


@F.arrow_udf(ArrayType(LongType()))
def _utf16_units(text: pa.Array, places: pa.Array) -> pa.Array:
    def one(raw: bytes, at: list[int]) -> list[int]:
        found, lo, units = [], 0, 0
        for hi in at:
            units, lo = units + len(raw[lo:hi].decode().encode("utf-16-le")), hi
            found.append(2 + units)
        return found

    return pa.array([one(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(text, places)], pa.list_(pa.int64()))


def utf16_places(text: Column, places: Column) -> Column:
    """map from places in a text's UTF-8, ascending, different and between characters, to those in its UTF-16 form after
    the mark: each from the one before. Null for null texts, which don't go through it."""
    return F.map_from_arrays(places, _utf16_units(text.cast("binary"), places))
