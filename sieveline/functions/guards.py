"""Cheap tests that every match of a regex passes, worked out from the regex.

A guard is a set of strings, one of which each match contains (in lower case, as the test is made on the line in lower
case), and the number of digits that each match has at least. Both are substring tests or lengths, so that the regexes
themselves run only on lines that may match.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser  # the standard library's own regex parser

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
#: Strings of a guard beyond which it costs more than it saves.
MOST = 40


@dataclass(frozen=True)
class Guard:
    any_of: frozenset[str] = frozenset()
    digits: int = 0


def n_digits(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, DIGITS, ""))


def _worth(options: frozenset[str] | None) -> tuple:
    """How good a set of strings is: long ones first, few ones then."""
    return (min(map(len, options)), -len(options)) if options else (0, 0)


def _is_digit(items) -> bool:
    return all(op is _parser.CATEGORY and arg is _parser.CATEGORY_DIGIT or op is _parser.RANGE and 48 <= arg[0] and arg[1] <= 57 or op is _parser.LITERAL and 48 <= arg <= 57 for op, arg in items)


def _need(items) -> tuple[frozenset[str] | None, int]:
    best, digits, run = None, 0, ""

    def offer(options: frozenset[str] | None) -> None:
        nonlocal best
        if options and len(options) <= MOST and _worth(options) > _worth(best):
            best = options

    for op, arg in items:
        if op is _parser.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            digits += chr(arg) in DIGITS
            continue
        offer(frozenset([run]) if run else None)
        run = ""
        if op is _parser.SUBPATTERN:
            options, n = _need(arg[3])
            offer(options)
            digits += n
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0]:
            options, n = _need(arg[2])
            offer(options)
            digits += n * arg[0]
        elif op is _parser.BRANCH:
            parts = [_need(x) for x in arg[1]]
            offer(frozenset().union(*[p[0] for p in parts]) if all(p[0] for p in parts) else None)
            digits += min(p[1] for p in parts)
        elif op is _parser.IN:
            digits += _is_digit(arg)
            if all(o is _parser.LITERAL and chr(a).isascii() for o, a in arg):
                offer(frozenset(chr(a).lower() for _, a in arg))
    offer(frozenset([run]) if run else None)
    return best, digits


def guard(regex: str) -> Guard:
    options, digits = _need(_parser.parse(regex))
    return Guard(options or frozenset(), digits)
