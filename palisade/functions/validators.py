"""Checks of candidates, as Columns: true means that the candidate stays, malformed ones don't.

Each takes the candidate's value (a byte view) and, where it needs more, the whole view and the place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import ascii_lower
from palisade.plans.patterns import byte_spelled
from palisade.plans.rules import REGISTERED, VALIDATORS, Rule

#: Bytes before a candidate in which a label is looked for.
LABEL_WINDOW = 64

# Card numbers that processors publish for tests.
TEST_CARDS = (
    "4000056655665556", "4005519200000004", "4009348888881881", "4012000033330026", "4012000077777777",
    "4012888888881881", "4111111111111111", "4217651111111119", "4242424242424242", "4500600000000061",
    "2223000048400011", "2223003122003222", "5105105105105100", "5200828282828210", "5555555555554444",
    "371449635398431", "378282246310005", "6011000990139424", "6011000991300009", "6011111111111117",
    "6011981111111113", "36227206271667", "36259600000004", "3056930009020004", "3530111333300000",
    "3566002020360505", "6200000000000005", "6200000000000047", "6205500000000000004", "6221261111117766",
    "6223164991230014", "6243030000000001", "6304000000000000", "6555900000604105",
)
# Numbers printed as examples.
EXAMPLE_SSNS = ("078-05-1120", "219-09-9999", "123-45-6789")
# Ranges that are not public, as first address and prefix length.
RESERVED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
# Fixed value: a key that a token debugger prints beside its example.
SAMPLE_KEY = b"your-256-bit-secret"
EXAMPLE_KEY_END = "EXAMPLE"


def bare(v: Column) -> Column:
    """Without the separators that card numbers are written with."""
    return F.translate(v, " -", "")


def luhn(v: Column) -> Column:
    return bare(v).rlike("^[0-9]{2,}$") & F.coalesce(F.call_function("luhn_check", bare(v)), F.lit(False))


def mod_11(v: Column) -> Column:
    """ISO 7064 MOD 11-2; X stands for ten at the end."""
    digits = F.split(F.upper(v), "")
    step = F.aggregate(
        F.slice(digits, 1, F.greatest(F.size(digits) - 1, F.lit(0))), F.lit(0), lambda p, c: ((p + c.cast("int")) * 2) % 11
    )
    last = F.element_at(digits, -1)
    return v.rlike("^[0-9]+[0-9Xx]$") & (((step + F.when(last == "X", 10).otherwise(last.try_cast("int"))) % 11) == 1)


def not_test_card(v: Column) -> Column:
    d = bare(v)
    return d.rlike("^[0-9]+$") & ~d.isin(*TEST_CARDS) & ~d.rlike(r"^([0-9])\1*$")


def not_example_key(v: Column) -> Column:
    return ~v.endswith(EXAMPLE_KEY_END)


def not_example_ssn(v: Column) -> Column:
    area, group, serial = F.substring(v, 1, 3), F.substring(v, 5, 2), F.substring(v, 8, 4)
    return (
        v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z")
        & (area != "666") & (group != "00") & (serial != "0000") & ~v.isin(*EXAMPLE_SSNS)
        & ~F.translate(v, "-", "").rlike(r"^([0-9])\1*$")
    )


def entropy(v: Column) -> Column:
    """Shannon bits a byte: from the lengths of the runs of equal bytes, once sorted."""
    n = F.length(v)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(v, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    spent = F.aggregate(runs, F.lit(0.0), lambda total, run: total + F.length(run) * F.log2(F.length(run)))
    return F.when(n > 0, F.log2(n) - spent / n).otherwise(0.0)


def ipv4_number(v: Column) -> Column:
    """A dotted quad as a number; null unless it is one, without leading zeros."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.split(v, r"\.")
    at = lambda i: F.element_at(parts, i).try_cast("long")
    number = ((at(1) * 256 + at(2)) * 256 + at(3)) * 256 + at(4)
    return F.when(v.rlike(rf"^(?:{octet}\.){{3}}{octet}$"), number)


def _block(first: str, bits: int) -> tuple[int, int]:
    a = int.from_bytes(bytes(map(int, first.split("."))), "big")
    return a, a + (1 << (32 - bits)) - 1


def reserved_block(v: Column) -> Column:
    """The reserved range that holds the address, else null."""
    n, found = ipv4_number(v), F.lit(None).cast("string")
    for first, bits in RESERVED:
        found = F.when(n.between(*map(F.lit, _block(first, bits))), f"{first}/{bits}").otherwise(found)
    return found


def public_ipv4(v: Column) -> Column:
    return ipv4_number(v).isNotNull() & reserved_block(v).isNull()


def before(view: Column, offset: Column) -> Column:
    """The LABEL_WINDOW bytes before a place, or as many as there are."""
    start = F.greatest(offset - LABEL_WINDOW, F.lit(0))
    return F.substring(view, (start + 1).cast("int"), (offset - start).cast("int"))


def labelled(window: Column, labels: Iterable[str]) -> Column:
    """Whether a label stands in the bytes before a place, apart from letters and digits (an
    underscore parts words here). The window's ends part words as well."""
    word = "[a-z0-9]"
    shapes = []
    for label in labels:
        own = byte_spelled(label).translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        left = f"(?<!{word})" if own[0].isascii() and own[0].isalnum() else ""
        right = f"(?!{word})" if own[-1].isascii() and own[-1].isalnum() else ""
        shapes.append(left + "\\Q" + own + "\\E" + right)
    return ascii_lower(window).rlike("|".join(shapes))


def near_label(view: Column, offset: Column, labels: Iterable[str]) -> Column:
    return labelled(before(view, offset), labels)


def _hmac(message: Column, key: bytes, bits: int) -> Column:
    """HMAC as hex, from the hash alone: the key is a constant."""
    size = 64 if bits == 256 else 128
    padded = key.ljust(size, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in padded).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), bits))
    return F.sha2(F.concat(pad(0x5C), inner), bits)


def _raw_base64url(v: Column) -> Column:
    """Decoded, or null where it isn't unpadded base64url."""
    n = F.length(v)
    return F.when(v.rlike("^[A-Za-z0-9_-]*$") & (n % 4 != 1), F.unbase64(F.rpad(F.translate(v, "-_", "+/"), F.ceil(n / 4).cast("int") * 4, F.lit("="))))


def not_sample_jwt(v: Column) -> Column:
    """Not signed with the published key; what can't be parsed is no sample."""
    parts = F.split(v, r"\.")
    header, payload, signature = (F.element_at(parts, i) for i in (1, 2, 3))
    alg = F.get_json_object(F.decode(_raw_base64url(header), "ISO-8859-1"), "$.alg")
    message, given = F.concat(header, F.lit("."), payload), F.lower(F.hex(_raw_base64url(signature)))
    signed = F.lit(False)
    for name, bits in (("HS256", 256), ("HS384", 384), ("HS512", 512)):
        signed = F.when(alg == name, given == _hmac(message, SAMPLE_KEY, bits)).otherwise(signed)
    return ~F.when(F.size(parts) == 3, F.coalesce(signed, F.lit(False))).otherwise(False)


#: name -> (rule, value, the bytes before it) -> whether the candidate stays.
REGISTRY: dict[str, Callable[[Rule, Column, Column], Column]] = {
    "luhn": lambda rule, v, near: luhn(v),
    "mod-11": lambda rule, v, near: mod_11(v),
    "card-placeholder": lambda rule, v, near: not_test_card(v),
    "aws-placeholder": lambda rule, v, near: not_example_key(v),
    "ssn-placeholder": lambda rule, v, near: not_example_ssn(v),
    "jwt-sample-key": lambda rule, v, near: not_sample_jwt(v),
    "entropy": lambda rule, v, near: entropy(v) >= rule.entropy,
    "reserved-range": lambda rule, v, near: public_ipv4(v),
    "context-label": lambda rule, v, near: labelled(near, rule.labels),
}


def register(name: str, check: Callable[[Column], Column]) -> None:
    """A check of one's own, that rules may name from then on: from a candidate's value (one character a byte) to whether
    it stays. Shipped checks can't be replaced; a check that gives null drops the candidate."""
    if name in VALIDATORS or not name:
        raise ValueError(f"the check {name} is there already" if name else "a check needs a name")
    REGISTRY[name] = lambda rule, v, near: F.coalesce(check(v), F.lit(False))
    REGISTERED.add(name)


def passes(rule: Rule, v: Column, near: Column, bits: Column | None = None, least: Column | None = None) -> Column:
    """All checks of a rule, in its order; one it doesn't know is an error, not a rule that finds nothing. bits: the
    value's entropy, where it is known; least: what it has to reach, if not the rule's own."""
    found = F.lit(True)
    for name in rule.validators:
        known = name == "entropy" and bits is not None
        found = found & (bits >= (rule.entropy if least is None else least) if known else REGISTRY[name](rule, v, near))
    return found
