"""Expressions that users bring: read, and refused where matching could take more than about the square of a text.

An expression is read by Python's parser, so only what that and Spark's engine share is let in. What is refused: what
does not parse, what may match nothing, references to groups, a repeat without bound over something that can itself be
split in more than one way (a further variable repeat, or alternatives that may begin with the same character), and more
than `MOST_OPEN` repeats without bound that can all take the same characters.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as parser

#: Repeats without bound over shared characters that one expression may have.
MOST_OPEN = 3
#: A repeat up to more than this counts as one without bound.
OPEN = 256
#: Longest expression.
MOST_CHARS = 1000

_CLASSES = {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S", K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_WORD: r"\W"}
# Characters that stand for all others when it is asked whether two parts can begin alike: ASCII and some beyond it.
_SAMPLE = frozenset([*map(chr, range(128)), "\x85", "\xa0", "ß", "é", "Ω", "ж", "٣", "中", " "])


class UnsafePattern(ValueError):
    """An expression that is not let in."""


def check_pattern(pattern: str, any_case: bool = False) -> str:
    """The pattern itself if it is let in; else `UnsafePattern`."""
    if not pattern or len(pattern) > MOST_CHARS:
        raise UnsafePattern(f"an expression has 1 to {MOST_CHARS} characters")
    try:
        tree = parser.parse(pattern, re.IGNORECASE if any_case else 0)
    except (re.error, OverflowError, RecursionError) as e:
        raise UnsafePattern(f"{pattern!r} cannot be read: {e}") from None
    if tree.state.flags & ~(re.UNICODE | (re.IGNORECASE if any_case else 0)):
        raise UnsafePattern(f"{pattern!r} sets flags of its own")
    if tree.getwidth()[0] == 0:
        raise UnsafePattern(f"{pattern!r} may match nothing")
    _walk(tree, False, pattern)
    open_ = _open_repeats(tree)
    for c in _SAMPLE:
        if sum(c in chars for chars in open_) > MOST_OPEN:
            raise UnsafePattern(f"{pattern!r} has more than {MOST_OPEN} unbounded repeats that take {c!r}")
    return pattern


def _walk(tree: parser.SubPattern, inside: bool, pattern: str) -> None:
    """`inside` a repeat without bound nothing may be taken in more than one way."""
    for op, arg in tree:
        if op in (K.GROUPREF, K.GROUPREF_EXISTS):
            raise UnsafePattern(f"{pattern!r} refers to a group")
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = arg
            if inside and low != high:
                raise UnsafePattern(f"{pattern!r} repeats a repeat without bound")
            if _is_open(high) and body.getwidth()[0] == 0:
                raise UnsafePattern(f"{pattern!r} repeats nothing without bound")
            _walk(body, inside or _is_open(high), pattern)
        elif op is K.BRANCH:
            firsts = [_first(b) for b in arg[1]]
            if inside and any(a & b for i, a in enumerate(firsts) for b in firsts[:i]):
                raise UnsafePattern(f"{pattern!r} repeats alternatives that begin alike without bound")
            for branch in arg[1]:
                _walk(branch, inside, pattern)
        else:
            for part in _parts(op, arg):
                _walk(part, inside, pattern)


def _is_open(high: int) -> bool:
    return high is K.MAXREPEAT or high > OPEN


def _parts(op, arg) -> list[parser.SubPattern]:
    """What a group, a look-around or a repeat that gives nothing back holds."""
    if op is K.SUBPATTERN:
        return [arg[3]]
    if op in (K.ASSERT, K.ASSERT_NOT):
        return [arg[1]]
    if op is K.ATOMIC_GROUP:
        return [arg]
    return [arg[2]] if op is K.POSSESSIVE_REPEAT else []


def _chars(op, arg) -> frozenset[str]:
    """The sample characters that a single-character part takes."""
    if op is K.LITERAL:
        # a character outside the sample stands for itself
        return frozenset(c for c in _SAMPLE | {chr(arg)} if c.casefold() == chr(arg).casefold())
    if op is K.NOT_LITERAL:
        return _SAMPLE - {chr(arg)}
    if op is K.ANY:
        return _SAMPLE
    found: set[str] = set()
    negated = False
    for what, value in arg:
        if what is K.NEGATE:
            negated = True
        elif what is K.LITERAL:
            found |= _chars(what, value)
        elif what is K.RANGE:
            found |= {c for c in _SAMPLE if value[0] <= ord(c) <= value[1] or value[0] <= ord(c.swapcase()[0]) <= value[1]} | {chr(value[0])}
        elif what is K.CATEGORY:
            found |= {c for c in _SAMPLE if re.match(_CLASSES[value], c)}
    return _SAMPLE - found if negated else frozenset(found)


def _first(tree: parser.SubPattern) -> frozenset[str]:
    """The sample characters that a match of `tree` may begin with; all of them if it may be empty."""
    found: frozenset[str] = frozenset()
    for op, arg in tree:
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            found |= _first(arg[2])
            if arg[0] == 0:
                continue
        elif op is K.BRANCH:
            found = found.union(*[_first(b) for b in arg[1]])
        elif parts := _parts(op, arg):
            found |= _first(parts[0])
        else:
            found |= _chars(op, arg)
        return found
    return _SAMPLE


def _open_repeats(tree: parser.SubPattern) -> list[frozenset[str]]:
    """What each repeat without bound takes."""
    found = []
    for op, arg in tree:
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            found += [_first(arg[2])] if _is_open(arg[1]) else _open_repeats(arg[2])
        elif op is K.BRANCH:
            found += max((_open_repeats(b) for b in arg[1]), key=len)
        else:
            for part in _parts(op, arg):
                found += _open_repeats(part)
    return found
