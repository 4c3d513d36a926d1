"""Patterns as the rules write them, for the engines that run them.

Rules are written for an engine with ASCII classes that works on bytes. Texts are scanned as one character a byte
(palisade.functions.text.byte_view), so patterns and words beyond ASCII are spelled in their UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from re import _constants as C  # the parse tree is what bounds are read from
from re import _parser

WORD = "[A-Za-z0-9_]"
#: A word boundary by ASCII, whatever stands on either side.
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def byte_spelled(text: str) -> str:
    """Each UTF-8 byte as the character of that number."""
    return text.encode().decode("latin-1")


def for_spark(regex: str) -> str:
    """The pattern for java.util.regex over byte views: boundaries by ASCII, text end spelled its way. A boundary
    before what can only be a word byte looks at that byte first, and only there at the one before it."""
    words = {b for b in range(256) if re.match(WORD, chr(b))}
    lead, tail = regex.startswith(r"\b"), regex.endswith(r"\b") and not regex.endswith(r"\\b")
    inner = regex[2 if lead else 0 : -2 if tail else None]
    tree = _parser.parse(for_python(inner))
    first, last = _edge(tree, 0), _edge(tree, -1)
    before = after = ""
    if lead:
        before = f"(?=[{_spelled(first)}])(?<!{WORD})" if first <= words else BOUNDARY
    if tail:
        after = f"(?!{WORD})" if last <= words else BOUNDARY
    return before + byte_spelled(re.sub(r"(\\\\)|\\b", lambda m: m[1] or BOUNDARY, inner)) + after


def _spelled(symbols: set[int]) -> str:
    return "".join(f"\\x{b:02x}" for b in sorted(symbols))


def _edge(tree, side: int) -> set[int]:
    """Bytes that a match can begin (side 0) or end (side -1) with."""
    found: set[int] = set()
    for op, arg in list(tree)[:: 1 if side == 0 else -1]:
        if op is C.AT:
            continue
        if op is C.BRANCH:
            for child in arg[1]:
                found |= _edge(child, side)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            found |= _edge(arg[2], side)
            if int(arg[0]) == 0:
                continue
        elif op is C.SUBPATTERN:
            found |= _edge(arg[3], side)
            if arg[3].getwidth()[0] == 0:
                continue
        else:
            found |= _symbols([(op, arg)])
        return found
    return found or set(range(256))


def for_python(regex: str) -> str:
    """The pattern for Python's re over bytes decoded as latin-1, with re.ASCII."""
    return "(?a)" + byte_spelled(regex).replace(r"\z", r"\Z")


def lint(regex: str) -> list[str]:
    """What the rules' own engine refuses: look-around, back-references, repeats over 1000, empty matches."""
    problems = []
    if re.search(r"\(\?(?:[=!]|<[=!])", regex):
        problems.append("regex: look-around")
    if re.search(r"\\[1-9]|\(\?P=", regex):
        problems.append("regex: back-reference")
    try:
        tree = _parser.parse(for_python(regex))
    except re.error as e:
        return [*problems, f"regex: {e}"]
    if any(low > 1000 or (high != C.MAXREPEAT and high > 1000) for low, high in _repeats(tree)):
        problems.append("regex: a repeat over 1000")
    if tree.getwidth()[0] == 0:
        problems.append("regex: it matches the empty string")
    return problems


def _children(op, arg):
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return [arg[2]]
    if op is C.SUBPATTERN:
        return [arg[3]]
    if op is C.BRANCH:
        return arg[1]
    return []


def _repeats(tree):
    for op, arg in tree:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            yield int(arg[0]), arg[1] if arg[1] == C.MAXREPEAT else int(arg[1])
        for child in _children(op, arg):
            yield from _repeats(child)


def _group(tree, number: int):
    if number == 0:
        return tree
    for op, arg in tree:
        if op is C.SUBPATTERN and arg[0] == number:
            return arg[3]
        for child in _children(op, arg):
            if (found := _group(child, number)) is not None:
                return found
    return None


def _symbols(tree) -> set[int]:
    """Bytes that can occur in what the tree matches."""
    found: set[int] = set()
    for op, arg in tree:
        if op is C.LITERAL:
            found.add(arg)
        elif op is C.IN:
            found |= _class(arg)
        elif op in (C.ANY, C.NOT_LITERAL):
            found |= set(range(256))
        for child in _children(op, arg):
            found |= _symbols(child)
    return found


def _class(items) -> set[int]:
    found: set[int] = set()
    negated = False
    for op, arg in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            found.add(arg)
        elif op is C.RANGE:
            found |= set(range(arg[0], arg[1] + 1))
        elif op is C.CATEGORY:
            shape = {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_WORD: r"\w", C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_NOT_WORD: r"\W", C.CATEGORY_NOT_SPACE: r"\S"}[arg]
            found |= {b for b in range(256) if re.match(shape, chr(b), re.ASCII)}
    return set(range(256)) - found if negated else found


def capture_bounds(regex: str, group: int) -> tuple[float, int]:
    """The most bytes that the group can hold (inf: no bound), and how many different ones."""
    tree = _group(_parser.parse(for_python(regex)), group)
    longest = tree.getwidth()[1]
    return (math.inf if longest >= C.MAXREPEAT or longest > 1 << 31 else longest), len(_symbols(tree))
