"""Regular expressions with complement, intersection and number ranges: parsed, and turned into automata by derivatives."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 0x10FFFF
#: States that an automaton may have; a pattern that needs more is refused.
MAX_STATES = 5000
#: Copies of a part that counted repetitions may make.
MAX_REPEAT = 1000


class BadRegex(ValueError):
    pass


# An expression is a tuple: a kind, and what it is made of. Equal expressions are equal tuples.
Expression = tuple
NOTHING: Expression = ("or",)
EMPTY: Expression = ("cat",)


def chars(*ranges: tuple[int, int]) -> Expression:
    """One character in any of the ranges of code points."""
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    return ("chars", *map(tuple, merged)) if merged else NOTHING


ANY_CHAR = chars((0, LAST))


def star(part: Expression) -> Expression:
    return part if part[0] == "star" else EMPTY if part in (NOTHING, EMPTY) else ("star", part)


ANYTHING = star(ANY_CHAR)


def negate(part: Expression) -> Expression:
    return part[1] if part[0] == "not" else NOTHING if part == ANYTHING else ("not", part)


def cat(*parts: Expression) -> Expression:
    flat = [q for p in parts for q in (p[1:] if p[0] == "cat" else (p,))]
    return NOTHING if NOTHING in flat else flat[0] if len(flat) == 1 else ("cat", *flat)


def either(*parts: Expression) -> Expression:
    flat = {q for p in parts for q in (p[1:] if p[0] == "or" else (p,))}
    if ANYTHING in flat or negate(NOTHING) in flat:
        return ANYTHING
    return flat.pop() if len(flat) == 1 else ("or", *sorted(flat, key=repr))


def both(*parts: Expression) -> Expression:
    flat = {q for p in parts for q in (p[1:] if p[0] == "and" else (p,))} - {ANYTHING, negate(NOTHING)}
    if NOTHING in flat:
        return NOTHING
    return ANYTHING if not flat else flat.pop() if len(flat) == 1 else ("and", *sorted(flat, key=repr))


def text(value: str) -> Expression:
    return cat(*[chars((ord(c), ord(c))) for c in value])


def repeated(part: Expression, least: int, most: int | None) -> Expression:
    if max(least, most or 0) > MAX_REPEAT or most is not None and most < least:
        raise BadRegex("a repetition has too large or crossed bounds")
    rest: Expression = star(part)
    if most is not None:
        rest = EMPTY
        for _ in range(most - least):
            rest = either(EMPTY, cat(part, rest))
    return cat(*[part] * least, rest)


def numbers(low: str, high: str) -> Expression:
    """Decimal numbers from low to high; bounds of equal length fix it, else zeros may stand in front."""
    fixed = len(low) == len(high)
    if int(low) > int(high):
        low, high = high, low

    def digit(a: int, b: int) -> Expression:
        return chars((48 + a, 48 + b))

    def between(a: str, b: str) -> Expression:
        """Strings of as many digits as a and b have."""
        if not a:
            return EMPTY
        x, y = int(a[0]), int(b[0])
        if x == y:
            return cat(digit(x, x), between(a[1:], b[1:]))
        rest = len(a) - 1
        middle = [cat(digit(x + 1, y - 1), *[digit(0, 9)] * rest)] if y - x > 1 else []
        return either(cat(digit(x, x), between(a[1:], "9" * rest)), *middle, cat(digit(y, y), between("0" * rest, b[1:])))

    if fixed:
        return between(low, high)
    low, high = str(int(low)), str(int(high))
    sizes = range(len(low), len(high) + 1)
    spans = [between(low if n == len(low) else "1" + "0" * (n - 1), high if n == len(high) else "9" * n) for n in sizes]
    return cat(star(digit(0, 0)), either(*spans))


class _Reader:
    """| binds least, then &, then what stands side by side, then ? * + {n,m}, then ~."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def sees(self, marks: str) -> bool:
        return self.at < len(self.pattern) and self.pattern[self.at] in marks

    def take(self) -> str:
        if self.at == len(self.pattern):
            raise BadRegex("something is missing at the end")
        self.at += 1
        return self.pattern[self.at - 1]

    def until(self, mark: str) -> str:
        end = self.pattern.find(mark, self.at)
        if end < 0:
            raise BadRegex(f"{mark} is missing")
        found, self.at = self.pattern[self.at : end], end + 1
        return found

    def whole(self) -> Expression:
        found = self.union() if self.pattern else EMPTY
        if self.at < len(self.pattern):
            raise BadRegex(f"unexpected {self.pattern[self.at]}")
        return found

    def joined(self, mark: str, part, join) -> Expression:
        found = [part()]
        while self.sees(mark):
            self.at += 1
            found.append(part())
        return join(*found)

    def union(self) -> Expression:
        return self.joined("|", self.intersection, either)

    def intersection(self) -> Expression:
        return self.joined("&", self.sequence, both)

    def sequence(self) -> Expression:
        found = [self.counted()]
        while self.at < len(self.pattern) and not self.sees("|&)"):
            found.append(self.counted())
        return cat(*found)

    def counted(self) -> Expression:
        found = self.complement()
        while self.sees("?*+{"):
            mark = self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[mark]
            if mark == "{":
                first, comma, last = self.until("}").partition(",")
                if not first.isdecimal() or last and not last.isdecimal():
                    raise BadRegex("a repetition needs numbers")
                least, most = int(first), int(last) if last else None if comma else int(first)
            found = repeated(found, least, most)
        return found

    def complement(self) -> Expression:
        if self.sees("~"):
            self.at += 1
            return negate(self.complement())
        return self.simple()

    def simple(self) -> Expression:
        mark = self.take()
        if mark == "[":
            return self.char_class()
        if mark == "(":
            if self.sees(")"):
                self.at += 1
                return EMPTY
            found = self.union()
            if self.take() != ")":
                raise BadRegex(") is missing")
            return found
        if mark == "<":
            low, dash, high = self.until(">").partition("-")
            if not (low.isdecimal() and high.isdecimal()):
                raise BadRegex("a range of numbers needs two")
            return numbers(low, high)
        if mark in "?*+{|&)":
            raise BadRegex(f"unexpected {mark}")
        known = {".": ANY_CHAR, "#": NOTHING, "@": ANYTHING}
        if mark == '"':
            return text(self.until('"'))
        return text(self.take()) if mark == "\\" else known.get(mark) or text(mark)

    def char_class(self) -> Expression:
        inverse = self.sees("^")
        self.at += inverse
        found: list[tuple[int, int]] = []
        while not found or not self.sees("]"):
            low = self.take()
            low = high = self.take() if low == "\\" else low
            if self.sees("-") and self.pattern[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.take()
                high = self.take() if high == "\\" else high
            if high < low:
                raise BadRegex("a range of characters is crossed")
            found.append((ord(low), ord(high)))
        self.at += 1
        if not inverse:
            return chars(*found)
        gaps, start = [], 0
        for low, high in chars(*found)[1:]:
            if low > start:
                gaps.append((start, low - 1))
            start = high + 1
        return chars(*gaps, *[(start, LAST)] * (start <= LAST))


def parsed(pattern: str) -> Expression:
    try:
        return _Reader(pattern).whole()
    except RecursionError as problem:
        raise BadRegex("it is nested too deeply") from problem


@lru_cache(100_000)
def nullable(e: Expression) -> bool:
    kind, parts = e[0], e[1:]
    if kind in ("cat", "and"):
        return all(map(nullable, parts))
    if kind == "or":
        return any(map(nullable, parts))
    return kind == "star" or kind == "not" and not nullable(parts[0])


@lru_cache(100_000)
def derivative(e: Expression, c: int) -> Expression:
    """What must follow the character c for the whole to match e."""
    kind, parts = e[0], e[1:]
    if kind == "chars":
        return EMPTY if any(low <= c <= high for low, high in parts) else NOTHING
    if kind == "star":
        return cat(derivative(parts[0], c), e)
    if kind == "not":
        return negate(derivative(parts[0], c))
    if kind == "or":
        return either(*[derivative(p, c) for p in parts])
    if kind == "and":
        return both(*[derivative(p, c) for p in parts])
    if not parts:
        return NOTHING
    rest = cat(*parts[1:])
    first = cat(derivative(parts[0], c), rest)
    return either(first, derivative(rest, c)) if nullable(parts[0]) else first


def _starts(e: Expression) -> set[int]:
    """Where, in the order of code points, the expression begins to tell characters apart."""
    if e[0] == "chars":
        return {x for low, high in e[1:] for x in (low, high + 1)}
    return {x for p in e[1:] for x in _starts(p)}


@dataclass(frozen=True)
class Automaton:
    """Classes of characters begin at starts; table[state * classes + class] is the next state; 0 is the first."""

    starts: tuple[int, ...]
    table: tuple[int, ...]
    accepting: tuple[int, ...]

    def matches(self, word: str) -> bool:
        state = 0
        for c in word:
            state = self.table[state * len(self.starts) + bisect_right(self.starts, ord(c)) - 1]
        return state in self.accepting

    def holds(self, term: Column) -> Column:
        """The same as a condition, without Python: the table is one constant that a term's characters are led through."""

        def constant(values: tuple[int, ...]) -> Column:
            return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")

        if not self.accepting:
            return F.lit(False)
        size, starts, table = len(self.starts), constant(self.starts), constant(self.table)
        places = F.when(F.char_length(term) > 0, F.sequence(F.lit(1), F.char_length(term))).otherwise(F.array().cast("array<int>"))
        points = F.transform(places, lambda i: F.ascii(F.substring(term, i, F.lit(1))))
        step = lambda state, c: F.element_at(table, state * size + F.size(F.filter(starts, lambda s: s <= c)))
        return F.array_contains(constant(self.accepting), F.aggregate(points, F.lit(0), step))


def automaton(pattern: str) -> Automaton:
    """Its states are the derivatives of the pattern; BadRegex if there are too many."""
    try:
        first = parsed(pattern)
        starts = tuple(sorted({0, *(s for s in _starts(first) if s <= LAST)}))
        states, table = {first: 0}, []
        for state in (order := [first]):
            for c in starts:
                following = derivative(state, c)
                if following not in states:
                    if len(states) == MAX_STATES:
                        raise BadRegex("it needs too many states")
                    states[following] = len(states)
                    order.append(following)
                table.append(states[following])
        return Automaton(starts, tuple(table), tuple(i for e, i in states.items() if nullable(e)))
    except RecursionError as problem:
        raise BadRegex("it is nested too deeply") from problem


#: Marks of a term's beginning and end in its grams.
BEGIN, END = "\x02", "\x03"


def required_texts(e: Expression) -> list[list[str]]:
    """Alternatives, each with texts that stand in every term, begun and ended by marks, that it matches."""

    def of(part: Expression) -> list[str]:
        run, found = BEGIN, []
        for p in part[1:] if part[0] == "cat" else (part,):
            if p[0] == "chars" and len(p) == 2 and p[1][0] == p[1][1]:
                run += chr(p[1][0])
                continue
            found.append(run)
            run = ""
            if p[0] == "and":
                # A part of the word: what its marks stand at isn't known.
                found += [t.strip(BEGIN + END) for q in p[1:] for t in of(q)]
        return [*found, run + END]

    def alternatives(e: Expression) -> list[list[str]]:
        if e[0] == "or":
            return [a for p in e[1:] for a in alternatives(p)]
        if e[0] == "and":
            return [[t for p in e[1:] if p[0] not in ("or", "not") for t in of(p)]]
        return [of(e)] if e[0] != "not" else [[]]

    return alternatives(e)
