"""Matches of rules in the bytes of a text, with places: looks in the JVM first, then one Arrow UDF for all rules.

Most texts show none of the literals that matches open with, and leave at a filter of built-in functions. Those that
remain go to Python in Arrow batches, where each rule is tried at the places of its openings alone (or runs over the
text, where it has none). Python's engine does not recurse over a text, works on bytes, and knows where any group lies.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palisade.plans.anchors import anchor, gate_is_implied, is_ascii, is_deep
from palisade.plans.patterns import byte_spelled, for_python, for_spark
from palisade.plans.rules import Rule

MATCH = "array<struct<offset:bigint,end:bigint,line:bigint,value:string>>"
#: What the UDF gives: rule_order numbers the rules; near holds the bytes before a match, for rules with labels alone, and bits
#: its entropy, for rules that ask for some.
SPAN = "array<struct<rule_order:int,offset:bigint,end:bigint,line:bigint,value:string,near:string,bits:double>>"
#: Bytes before a match in which a label counts.
NEAR = 64
_RUN = re.compile(rb"[A-Za-z0-9_-]*")
#: The least bytes of a token's three segments; the second opens like the first.
_SEGMENTS = (11, 11, 10)


def pattern(rule: Rule) -> str:
    return for_spark(rule.regex)


def is_gated(rule: Rule) -> bool:
    return any(rule.keywords)


def gate(rule: Rule, low: Column) -> Column:
    """Whether any keyword occurs in a lower-cased byte view, with no word byte before it (where it starts with
    one). A byte view has no letter beyond Latin-1, so lower() turns nothing else into a letter of a keyword. The
    keyword itself is looked for first, and what is before it only where it is."""
    met = F.lit(False)
    for word in (byte_spelled(k).lower() for k in rule.keywords if k):
        own = low.contains(word)
        if re.match("[a-z0-9_]", word):
            own = own & low.rlike(f"\\Q{word}\\E(?<![a-z0-9_]\\Q{word}\\E)")
        met = met | own
    return met if is_gated(rule) else F.lit(True)


def may_match(which: Sequence[Rule], text: Column) -> Column:
    """Whether any rule can match the text at all, by what is cheap: the openings of its matches as they are written,
    or, for patterns without one over ASCII alone, the pattern itself. Never false where there is a match."""
    literals: set[str] = set()
    shapes: list[str] = []
    for rule in which:
        own = anchor(rule.regex)
        if own and all(x.isascii() for x in own.openings):
            shared = os.path.commonprefix(own.openings).decode()
            literals |= {shared} if len(shared) >= 3 else {x.decode() for x in own.openings}
        elif is_ascii(rule.regex) and not is_deep(rule.regex):
            shapes.append(pattern(rule))
        else:
            return text.isNotNull()
    least = sorted(x for x in literals if not any(y != x and y in x for y in literals))

    def looks(t: Column) -> Column:
        met = F.lit(False)
        for look in (*(t.contains(x) for x in least), *(t.rlike(x) for x in shapes)):
            met = met | look
        return met

    # the text is bound once: where it is computed, each look would make it anew
    return text.isNotNull() & F.exists(F.array(text), looks)


class _Rule:
    """A rule as it runs over bytes."""

    def __init__(self, order: int, rule: Rule, gated: bool):
        self.order, self.group, self.extent = order, rule.group, rule.extent
        self.regex = re.compile(for_python(rule.regex).encode("latin-1"))
        own = anchor(rule.regex)
        self.openings = own.openings if own else ()
        self.labelled, self.measured = any(rule.labels), rule.entropy > 0
        self.gate = None
        if gated and is_gated(rule) and not gate_is_implied(rule.regex, rule.keywords):
            words = [byte_spelled(k).encode("latin-1") for k in rule.keywords if k]
            self.gate = re.compile(b"(?i)" + b"|".join((rb"(?<![A-Za-z0-9_])" if re.match(rb"[A-Za-z0-9_]", w) else b"") + re.escape(w) for w in words))

    def places(self, text: bytes) -> list[int]:
        """Where matches can begin, ascending."""
        found: list[int] = []
        for opening in self.openings:
            at = text.find(opening)
            while at >= 0:
                found.append(at)
                at = text.find(opening, at + 1)
        return sorted(found) if len(self.openings) > 1 else found

    def tried(self, text: bytes) -> Iterator[re.Match]:
        """Matches that don't overlap, ascending. Since each begins at an opening, it is tried there alone."""
        if self.gate and not self.gate.search(text):
            return
        if not self.openings:
            yield from self.regex.finditer(text)
            return
        end = 0
        for at in self.places(text):
            if at >= end and (m := self.regex.match(text, at)):
                end = m.end()
                yield m

    def spans(self, text: bytes) -> Iterator[tuple[int, int]]:
        """The group's places. A group that took no part gives none."""
        runs, end = _Runs(text), 0
        for m in self.tried(text):
            lo, hi = m.span(self.group)
            if self.extent:
                hi = runs.token(lo) if lo >= end else -1
            if lo >= 0 and hi >= 0:
                yield lo, hi
                end = hi


class _Runs:
    """Runs of token bytes; the last few are kept, so that openings in one run don't walk it again and again."""

    def __init__(self, text: bytes):
        self.text, self.known = text, []

    def end(self, at: int) -> int:
        for lo, hi in self.known:
            if lo <= at <= hi:
                return hi
        hi = _RUN.match(self.text, at).end()
        self.known = [(at, hi), *self.known[:3]]
        return hi

    def token(self, at: int) -> int:
        """Where a whole token of three segments that begins here ends, or -1."""
        first, second, third = _SEGMENTS
        dot = self.end(at)
        if dot - at < first or self.text[dot : dot + 4] != b".eyJ":
            return -1
        next_dot = self.end(dot + 1)
        if next_dot - dot - 1 < second or self.text[next_dot : next_dot + 1] != b".":
            return -1
        end = self.end(next_dot + 1)
        return end if end - next_dot - 1 >= third else -1


@lru_cache(maxsize=16)
def _compiled(which: tuple[Rule, ...], gated: bool) -> tuple[_Rule, ...]:
    return tuple(_Rule(i, r, gated) for i, r in enumerate(which))


_KIND = pa.struct([("rule_order", pa.int32()), ("offset", pa.int64()), ("end", pa.int64()), ("line", pa.int64()), ("value", pa.string()), ("near", pa.string()), ("bits", pa.float64())])


def bits_of(value: bytes) -> float:
    """Entropy in bits a byte: what validators.entropy() gives."""
    n = len(value)
    return math.log2(n) - sum(c * math.log2(c) for c in map(value.count, sorted(set(value)))) / n if n else 0.0


def spans_of(text: bytes, which: tuple[Rule, ...], lines: bool = False, gated: bool = True) -> Iterator[tuple]:
    """(rule_order, offset, end, line, value, near, bits) of all rules' matches, rule by rule, ascending."""
    for rule in _compiled(which, gated):
        at, line = 0, 1
        for lo, hi in rule.spans(text):
            if lines:
                line, at = line + text.count(b"\n", at, lo), lo
            near = text[max(0, lo - NEAR) : lo].decode("latin-1") if rule.labelled else None
            yield rule.order, lo, hi, line if lines else None, text[lo:hi].decode("latin-1"), near, bits_of(text[lo:hi]) if rule.measured else None


def spans(which: Sequence[Rule], raw: Column, lines: bool = False, gated: bool = True) -> Column:
    """SPAN of text or binary content; an empty array for null. Only what is not null goes through the rules."""
    own = tuple(which)

    @F.arrow_udf(SPAN)
    def find(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for x in texts:
            if x.is_valid:
                rows += spans_of(x.as_py(), own, lines, gated)
            ends.append(len(rows))
        parts = list(zip(*rows)) if rows else [()] * len(_KIND)
        columns = [pa.array(p, f.type) for p, f in zip(parts, _KIND)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_KIND)))

    return find(raw.cast("binary"))


def matches(rule: Rule, view: Column, low: Column | None = None, lines: bool = False) -> Column:
    """MATCH of one rule's matches in a byte view; an empty array if the gate is shut, for which low, the view in lower
    case, is given. line is null unless lines are asked for."""
    opened = view.isNotNull() & (gate(rule, low) if low is not None else F.lit(True))
    found = spans([rule], F.when(opened, F.encode(view, "ISO-8859-1")), lines, gated=False)
    return F.transform(found, lambda m: F.struct(*(m[x].alias(x) for x in ("offset", "end", "line", "value")))).cast(MATCH)


@F.arrow_udf(BinaryType())
def spliced(raw: pa.Array, cuts: pa.Array) -> pa.Array:
    """Bytes with cuts (offset, rule_id, end; ascending) replaced by a marker of their rule. A cut that overlaps what is
    hidden already hides more, without a second marker. Linear in the bytes and the cuts; null where there are none."""

    def one(text: bytes, spans: list[dict]) -> bytes:
        kept, at = [], 0
        for s in spans:
            if s["offset"] >= at:
                kept += (text[at : s["offset"]], b"[REDACTED:%s]" % s["rule_id"].encode())
            at = max(at, s["end"])
        return b"".join([*kept, text[at:]])

    return pa.array([one(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(raw, cuts)], pa.binary())
