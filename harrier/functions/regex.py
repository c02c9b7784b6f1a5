"""Regular expressions of the RE2 dialect for Spark: translation to Java's, and the literals that a match needs.

Rules are kept in RE2's dialect, which the SQL oracle shares. Java differs in what ``.``, ``\\s`` and ``\\b`` mean; a translated
pattern means in Spark what the original means in RE2.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: A boundary where a word character follows, or where one is before.
_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"
_SPACE = r"\t\n\f\r "


def to_java(pattern: str) -> str:
    """The Java pattern that means what ``pattern`` means in RE2."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            two = pattern[at : at + 2]
            at += 2
            if two == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif two == r"\S":
                out.append(r"\S\x0B" if inside else f"[^{_SPACE}]")
            elif two == r"\b" and not inside:
                out.append(_BEFORE if _starts_word(pattern, at) else _AFTER if _ends_word(pattern, at - 2) else _BOUNDARY)
            else:
                out.append(two)
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" and pattern[at : at + 2] != "[:":
                out.append("\\")
            elif c == "&" and pattern[at : at + 2] == "&&":
                out.append("\\")
        elif c == "[":
            inside = True
            take = 2 if pattern[at + 1 : at + 2] == "^" else 1
            out.append(pattern[at : at + take])
            at += take
            continue
        elif c == "$":
            c = r"(?=\n|\z)" if _multiline(pattern) else r"\z"
        out.append(c)
        at += 1
    text = "".join(out)
    flags = re.match(r"\(\?([a-z]+)\)", text)
    if flags and "i" in flags[1]:
        text = f"(?{flags[1]}u){text[flags.end():]}"
    return "(?d)" + text


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _starts_word(pattern: str, at: int) -> bool:
    """Whether what follows begins with a word character, in all of its alternatives."""
    rest = pattern[at:]
    if group := re.match(r"\((?:\?:)?([^()\[\]\\]*)\)(?![?*{])", rest):
        return all(x and _is_word(x[0]) and x[1:2] not in ("?", "*", "{") for x in group[1].split("|"))
    return bool(rest) and _is_word(rest[0]) and rest[1:2] not in ("?", "*", "{") and "|" not in rest


def _ends_word(pattern: str, at: int) -> bool:
    """Whether what is before ends in a plain word character."""
    return at > 0 and _is_word(pattern[at - 1]) and pattern[at - 2 : at - 1] != "\\" and "|" not in pattern


def _multiline(pattern: str) -> bool:
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return bool(flags and "m" in flags[1])


#: Texts that a run of a pattern may be spelled in before it counts as open.
_SPELLINGS = 48


def _spellings(op: object, arg: object) -> set[str] | None:
    """All texts that a piece of a pattern matches, if they are few; None if not."""
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.AT:
        return {""}
    if op is C.IN:
        out: set[str] = set()
        for o, x in arg:
            if o is C.LITERAL:
                out.add(chr(x))
            elif o is C.RANGE and x[1] - x[0] < 6:
                out |= {chr(c) for c in range(x[0], x[1] + 1)}
            elif o is C.CATEGORY and x is C.CATEGORY_SPACE:
                out |= set("\t\n\f\r ")
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _all_spellings(arg[3])
    if op is C.BRANCH:
        parts = [_all_spellings(x) for x in arg[1]]
        return set().union(*parts) if all(x is not None for x in parts) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and tuple(arg[:2]) in ((0, 1), (1, 1)):
        own = _all_spellings(arg[2])
        return None if own is None else own | ({""} if arg[0] == 0 else set())
    return None


def _all_spellings(parsed: _parser.SubPattern) -> set[str] | None:
    out = {""}
    for op, arg in parsed:
        own = _spellings(op, arg)
        if own is None or len(out) * len(own) > _SPELLINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _needs(parsed: _parser.SubPattern) -> list[str] | None:
    """Literals of which every match holds one, the longest to be had; None if there are none."""
    found: list[list[str]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if "" not in run:
            found.append(sorted(run))
        run = {""}

    for op, arg in parsed:
        own = _spellings(op, arg)
        if own is not None and len(run) * len(own) <= _SPELLINGS:
            run = {a + b for a in run for b in own}
            continue
        repeated = op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0
        if repeated and (first := _all_spellings(arg[2])) is not None and len(run) * len(first) <= _SPELLINGS:
            run = {a + b for a in run for b in first}  # what is repeated comes once at least
        close()
        if op is C.BRANCH:
            parts = [_needs(x) for x in arg[1]]
            if all(parts):
                found.append([y for x in parts for y in x])
        elif op is C.SUBPATTERN:
            if got := _needs(arg[3]):
                found.append(got)
        elif repeated and (got := _needs(arg[2])):
            found.append(got)
    close()
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def required_literals(pattern: str) -> tuple[list[str] | None, bool]:
    """Of every match, one of these is a part (None: nothing is known), and whether their case does not count."""
    return _needs(_parser.parse(pattern.replace(r"\z", r"\Z"))), bool(re.match(r"\(\?[a-z]*i", pattern))


def matches(text: Column, pattern: str) -> Column:
    """Whether ``text`` holds a match of the RE2 pattern."""
    return F.rlike(text, F.lit(to_java(pattern)))


def holds(text: Column, java: Column) -> Column:
    """Whether ``text`` holds a match of a Java pattern from a column; a pattern is compiled once for as long as it stays the same."""
    return F.regexp_instr(text, java) > 0


def example(pattern: str) -> str:
    """A short text that the pattern matches."""

    def one(parsed: _parser.SubPattern) -> str:
        out = ""
        for op, arg in parsed:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.NOT_LITERAL:
                out += "z" if arg != ord("z") else "y"
            elif op is C.ANY:
                out += "x"
            elif op is C.IN:
                out += _member(arg)
            elif op is C.BRANCH:
                out += one(arg[1][0])
            elif op is C.SUBPATTERN:
                out += one(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                gap = arg[0] == 0 and arg[1] > 1 and arg[2][0][0] in (C.ANY, C.IN) and re.match(_source(arg[2]), " ")
                out += " " if gap else one(arg[2]) * arg[0]
        return out

    return one(_parser.parse(pattern))


def _source(parsed: _parser.SubPattern) -> str:
    """A pattern for one character that a repeated class or dot accepts, as far as white space goes."""
    op, arg = parsed[0]
    if op is C.ANY:
        return "."
    wide = arg[0][0] is C.NEGATE
    space = any((o is C.LITERAL and x == 32) or (o is C.CATEGORY and x is C.CATEGORY_SPACE) for o, x in arg)
    return "." if wide and not space else "(?!)"


def _member(items: list) -> str:
    """A character of a class."""
    negated = items[0][0] is C.NEGATE
    test = re.compile
    for c in "aA1 0zZ9x-_./":
        hit = False
        for op, arg in items:
            if op is C.LITERAL:
                hit |= ord(c) == arg
            elif op is C.RANGE:
                hit |= arg[0] <= ord(c) <= arg[1]
            elif op is C.CATEGORY:
                kind = {C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_DIGIT: r"\d", C.CATEGORY_WORD: r"\w"}[arg]
                hit |= bool(test(kind).match(c))
        if hit != negated:
            return c
    return chr(next(arg if op is C.LITERAL else arg[0] for op, arg in items if op in (C.LITERAL, C.RANGE)))
