"""A tokenizer of query strings that never fails: for highlighting, and for what stands under the caret."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql.functions import udtf

from tessera.functions.lexer import CJ_RANGES, is_cj, is_cjk, python_class
from tessera.functions.text import SPECIAL

# What single signs and words are.
SIGNS = {
    "AND": "And", "&&": "And", "+": "And", "OR": "Or", "||": "Or", "NOT": "Not", "!": "Not", "-": "Not",
    "^": "BoostModifier", "~": "SlopeModifier", "?": "AnyChar", "*": "AnyString",
    "(": "OpenGroup", "{": "OpenOpenRange", "[": "OpenClosedRange", ")": "CloseGroup", "}": "CloseOpenRange", "]": "CloseClosedRange",
    "TO": "To", ":": "Colon", '"': "Quote", "/": "RegexDelimiter",
}
BOOLEAN, MODIFIER, WILDCARD = {"And", "Or", "Not"}, {"BoostModifier", "SlopeModifier"}, {"AnyChar", "AnyString"}
RANGES = {"OpenOpenRange", "OpenClosedRange"}
OPENERS, CLOSERS = RANGES | {"OpenGroup"}, {"CloseOpenRange", "CloseClosedRange", "CloseGroup"}
DELIMITERS = OPENERS | CLOSERS | {"Colon", "OpenQuote", "CloseQuote", "OpenRegex", "CloseRegex"}


def closes(closer: str, opener: str | None) -> bool:
    """A group's closer closes a group; a range may end inclusively or not, however it began."""
    return opener == "OpenGroup" if closer == "CloseGroup" else opener in RANGES


class Token(NamedTuple):
    position: int
    value: str
    type: str
    parent_field: str | None
    next_field: str | None

    @property
    def end(self) -> int:
        return self.position + len(self.value)

    def holds(self, caret: int) -> bool:
        return self.position < caret < self.end

    def touches(self, caret: int) -> bool:
        return caret in (self.position, self.end)

    def connected(self, caret: int) -> bool:
        """An edge is at the caret and one may type on there."""
        if not self.touches(caret) or self.type in DELIMITERS:
            return False
        return not (self.type == "FieldValue" and is_cj(self.value[0 if caret == self.position else -1]))


# A run of characters that are nothing by themselves is one unit: no word ends inside it.
_UNIT = re.compile(rf"(?P<space>\s+)|\\[{re.escape(SPECIAL)}]|[^\s{re.escape(SPECIAL)}{python_class(CJ_RANGES)}]+|.", re.S)


class _Scan:
    def __init__(self, text: str):
        self.units = [(m.start(), m[0], m["space"] is not None) for m in _UNIT.finditer(text)]
        self.tokens: list[Token] = []
        self.errors: list[str] = []
        self.open: list[Token] = []
        self.field: str | None = None

    def outer(self) -> None:
        self.field = self.open[-1].parent_field if self.open else None

    def add(self, start: int, value: str, kind: str, parent: str | None, after: str | None = None) -> Token:
        self.tokens.append(Token(start, value, kind, parent, after))
        return self.tokens[-1]

    def ends_word(self, i: int) -> bool:
        """Whether a word can't go on after unit i."""
        if i + 1 >= len(self.units) or self.units[i + 1][2]:
            return True
        now, then = self.units[i][1], self.units[i + 1][1]
        if now not in SPECIAL and then not in SPECIAL:
            return False
        return now != then or now not in "&|"

    def run(self) -> _Scan:
        i = 0
        while i < len(self.units):
            i = self.step(i)
        return self

    def step(self, i: int) -> int:
        """Reads one token that begins at unit i; gives the unit after it."""
        start, unit, space = self.units[i]
        if space:
            return i + 1
        if self.tokens and self.tokens[-1].type == "OpenRegex" and unit != "/":
            return self.regex_body(i)
        j, value = i, unit
        while True:
            kind = SIGNS.get(value)
            after_colon = j + 1 < len(self.units) and self.units[j + 1][1] == ":"
            if kind == "To" and not (self.open and self.open[-1].type in RANGES):
                kind = None
                if not after_colon:  # no separator here: it goes with what follows
                    if j + 1 >= len(self.units):
                        return j + 1
                    j += 1
                    value += self.units[j][1]
                    continue
            if kind and not (kind in BOOLEAN and value.isalpha() and not self.ends_word(j)) and not (kind == "To" and not self.ends_word(j)):
                self.sign(start, value, kind, after_colon)
                return j + 1
            if after_colon:
                self.field = value
                self.add(start, value.rstrip(), "Field", value, value)
                return j + 1
            if self.ends_word(j) and not (kind is None and value in ("&", "|") and j + 1 < len(self.units) and self.units[j + 1][1] == value):
                self.value(start, value)
                return j + 1
            if is_cj(value[-1]):
                self.add(start, value, "FieldValue", self.field, self.field)
                return j + 1
            j += 1
            value += self.units[j][1]

    def regex_body(self, i: int) -> int:
        j = i
        while j + 1 < len(self.units) and self.units[j + 1][1] != "/":
            j += 1
        body = "".join(u[1] for u in self.units[i : j + 1]).rstrip()
        self.add(self.units[i][0], body, "RegexBody", self.field, self.field)
        return j + 1

    def value(self, start: int, value: str) -> None:
        modified = bool(self.tokens) and self.tokens[-1].type in MODIFIER
        parent = self.field
        self.outer()
        self.add(start, value.rstrip(), "ModifierValue" if modified else "FieldValue", parent, self.field)

    def sign(self, start: int, value: str, kind: str, before_colon: bool) -> None:
        if kind in OPENERS:
            self.open.append(self.add(start, value, kind, self.field, self.field))
        elif kind in CLOSERS:
            self.closer(start, value, kind)
        elif kind in ("Quote", "RegexDelimiter"):
            self.delimiter(start, value, "Quote" if kind == "Quote" else "Regex")
        elif kind == "AnyString" and before_colon:
            self.field = value
            self.add(start, value, "Field", value, value)
        else:
            if kind in WILDCARD and self.tokens and self.tokens[-1].end == start:
                self.field = self.tokens[-1].parent_field  # part of the word before
            self.add(start, value, kind, self.field, self.field)

    def closer(self, start: int, value: str, kind: str) -> None:
        top = self.open[-1] if self.open else None
        parent = self.field
        if top and closes(kind, top.type):
            self.open.pop()
            self.outer()
        elif top:
            self.errors.append(f"Unexpected {value} at {start} closing {top.value} at {top.position}")
        else:
            self.errors.append(f"Unmatched {value} at {start}")
        self.add(start, value, kind, parent, self.field)

    def delimiter(self, start: int, value: str, name: str) -> None:
        if self.open and self.open[-1].type == f"Open{name}":
            parent = self.field
            self.open.pop()
            self.outer()
            self.add(start, value, f"Close{name}", parent, self.field)
        else:
            self.open.append(self.add(start, value, f"Open{name}", self.field, self.field))


def tokenize(text: str) -> tuple[list[Token], list[str]]:
    """(tokens, syntax errors); positions in code points. Openers that are never closed are no error."""
    scan = _Scan(text).run()
    return scan.tokens, scan.errors


def edited_token(text: str, caret: int) -> Token:
    """The token that typing at the caret changes, or an empty one of the type that would begin there."""
    tokens, _ = tokenize(text)
    if inside := next((t for t in tokens if t.holds(caret)), None):
        return inside
    left = next((t for t in reversed(tokens) if t.end <= caret), None)
    right = next((t for t in tokens if t.position >= caret), None)
    if right and right.connected(caret) and not (left and left.connected(caret)):
        return right
    if left and left.touches(caret):
        if left.type in MODIFIER:
            return Token(caret, "", "ModifierValue", left.parent_field, left.next_field)
        if left.type in {"Field", "FieldValue", "ModifierValue"} and left.connected(caret) or left.type in BOOLEAN and len(left.value) > 1:
            return left
    field = left.next_field if left else None
    marks = [t.type for t in tokens if t.end <= caret and t.type in {"OpenQuote", "CloseQuote", "OpenRegex", "CloseRegex"}]
    quoted = bool(marks) and marks[-1].startswith("Open")
    return Token(caret, "", "FieldValue" if quoted or field else "Field", field, field)


def highlight(token: Token) -> str:
    """Fixed classes: underline for words (CJK ones stay plain), teal for fields, darkred for expressions, else blue."""
    if token.type == "FieldValue":
        return "" if is_cjk(token.value) else "underline"
    return {"Field": "teal", "Colon": "teal", "RegexBody": "darkred"}.get(token.type, "blue")


@udtf(returnType="pos int, value string, type string, parent_field string, next_field string, style string")
class QueryTokens:
    """SELECT * FROM query_tokens('a AND b'), once registered."""

    def eval(self, query: str):
        for t in tokenize(query or "")[0]:
            yield t.position, t.value, t.type, t.parent_field, t.next_field, highlight(t)
