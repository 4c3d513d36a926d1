"""What a pattern's parse tree says about where its matches can be: the bytes that open them, how far they reach, and
whether a recursive engine is safe with it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

from palisade.plans.patterns import WORD, _children, _class, _symbols, byte_spelled, for_python

#: Openings that are told apart, options of a class that are spelled out, and the most bytes of an anchored match.
OPENINGS, OPTIONS, REACH = 24, 8, 4096
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)


@dataclass(frozen=True)
class Anchor:
    """Every match begins with one of `openings`, and has `reach` bytes at most (None: no bound under REACH)."""

    openings: tuple[bytes, ...]
    reach: int | None
    #: Whether no word byte stands before a match that opens on one.
    bounded: bool


def _tree(regex: str):
    return _parser.parse(for_python(regex))


def _grown(tree, given: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Openings, and whether more may follow that is known, after a further part of the pattern."""
    for op, arg in tree:
        if op is C.AT:
            continue
        if not any(more for _, more in given):
            break
        options: list[tuple[str, bool]] | None = None
        if op is C.LITERAL:
            options = [(chr(arg), True)]
        elif op is C.IN:
            symbols = sorted(_class(arg))
            options = [(chr(x), True) for x in symbols] if 0 < len(symbols) <= OPTIONS else None
        elif op is C.SUBPATTERN and not (arg[1] or arg[2]):
            options = _grown(arg[3], [("", True)])
        elif op is C.ATOMIC_GROUP:
            options = _grown(arg, [("", True)])
        elif op is C.BRANCH:
            options = [x for child in arg[1] for x in _grown(child, [("", True)])]
        elif op in _REPEATS:
            low, high = int(arg[0]), int(arg[1]) if arg[1] != C.MAXREPEAT else None
            one = _grown(arg[2], [("", True)])
            if low == 0 and high == 1:
                options = [("", True), *one]
            elif low >= 1:
                options = [("", True)]
                for _ in range(min(low, 40)):
                    options = [(a + b, more) for a, on in options for b, more in ([*one] if on else [("", False)])]
                    if len(options) > OPENINGS:
                        break
                if low > 40 or high != low:
                    options = [(x, False) for x, _ in options]
        grown = [(a + b, more) for a, on in given for b, more in (options if on and options else [("", False)])]
        if len(set(grown)) > OPENINGS:
            return [(a, False) for a, _ in given]
        given = sorted(set(grown))
    return given


@lru_cache(maxsize=512)
def anchor(regex: str) -> Anchor | None:
    """None where matches open on nothing that can be looked for: less than two known bytes."""
    tree = _tree(regex)
    if tree.state.flags & re.IGNORECASE:
        return None
    found = {x for x, _ in _grown(tree, [("", True)])}
    found = {x for x in found if not any(x != y and x.startswith(y) for y in found)}
    if min(map(len, found), default=0) < 2:
        return None
    widest = tree.getwidth()[1]
    openings = tuple(sorted(x.encode("latin-1") for x in found))
    return Anchor(openings, int(widest) if widest < REACH else None, regex.startswith(r"\b") and all(re.match(WORD, chr(x[0])) for x in openings))


def gate_is_implied(regex: str, keywords: tuple[str, ...]) -> bool:
    """Whether each match by itself shows a keyword that the gate would let pass."""
    own = anchor(regex)
    words = [byte_spelled(k).encode("latin-1").lower() for k in keywords if k]
    if own is None:
        return not words

    def shown(opening: bytes) -> bool:
        low = opening.lower()
        for word in words:
            at = low.find(word)
            while at >= 0:
                apart = not re.match(WORD, chr(word[0])) or (own.bounded if at == 0 else not re.match(WORD, chr(low[at - 1])))
                if apart:
                    return True
                at = low.find(word, at + 1)
        return False

    return not words or all(map(shown, own.openings))


#: A repeat of what stands in parentheses, as it is written: parsers simplify some, Java's engine does not.
_GROUP_REPEAT = re.compile(r"\)(?:[*+]|\{(\d*)(,?)(\d*)\})")


@lru_cache(maxsize=512)
def is_deep(regex: str) -> bool:
    """Whether a recursive engine may run out of stack on it: what stands in parentheses is repeated without a bound of
    64. A closing parenthesis that is only a character counts too: then the pattern is merely not looked for early."""
    for low, comma, high in _GROUP_REPEAT.findall(regex):
        if not (low or high) or (comma and not high) or int(high or low) > 64:
            return True
    return False


@lru_cache(maxsize=512)
def is_ascii(regex: str) -> bool:
    """Whether nothing that it matches holds a byte beyond ASCII: then characters and bytes say the same."""
    return regex.isascii() and max(_symbols(_tree(regex)), default=0) < 128
