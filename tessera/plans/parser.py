"""The text syntax: terms, phrases, groups, prefixes, wildcards, regular expressions, fuzzy terms, ranges, boosts, fields."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.functions.lexer import Lexer
from tessera.plans.ast import (
    MUST, MUST_NOT, SHOULD, Bool, Boost, Fuzzy, MatchAll, Node, Phrase, Prefix, Query, Range, Regex, Term, Wildcard,
    require_positive, warn_leading_wildcards,
)
from tessera.plans.terms import UnsupportedRegex, checked_regex


class SyntaxProblem(Exception):
    pass


_SPACE = " \t\n\r　"
_STOP = _SPACE + '+-!():^[]"{}~*?\\/'
_TOKEN = re.compile(
    rf"""(?P<space>[{_SPACE}]+)
    |(?P<and>AND(?=[{_SPACE}()!+\-"]|$)|&&)|(?P<or>OR(?=[{_SPACE}()!+\-"]|$)|\|\|)|(?P<not>NOT(?=[{_SPACE}()!+\-"]|$)|!)
    |(?P<plus>\+)|(?P<minus>-)|(?P<open>\()|(?P<close>\))|(?P<colon>:)
    |(?P<boost>\^(?P<factor>[0-9]+(?:\.[0-9]+)?)?)|(?P<quoted>"(?:[^"\\]|\\.)*")
    |(?P<fuzzy>~(?P<amount>[0-9]*\.?[0-9]+)?)|(?P<regex>/(?:[^/\\]|\\.)*/)|(?P<range>[\[{{])
    |(?P<term>(?:[^{re.escape(_STOP)}]|\\.|[*?])(?:[^{re.escape(_STOP)}]|\\.|[*?+\-])*)""",
    re.X | re.S,
)
_RANGE = re.compile(
    rf"""[{_SPACE}]*(?P<low>"(?:[^"\\]|\\.)*"|(?:[^{_SPACE}\]}}"\\]|\\.)+)[{_SPACE}]+TO[{_SPACE}]+(?P<high>"(?:[^"\\]|\\.)*"|(?:[^{_SPACE}\]}}"\\]|\\.)+)[{_SPACE}]*(?P<end>[\]}}])""",
    re.X | re.S,
)


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Parser:
    """auto_phrase: a bare word of several terms is a phrase, else any of them; lower: fold what isn't lexed."""

    lexer: Lexer = Lexer()
    auto_phrase: bool = True
    lower: bool = True
    field: str = "content"

    def __call__(self, text: str) -> Query:
        """Never raises for what stands in the text: problems are errors of the result."""
        try:
            node = _Reader(self, text).whole()
        except SyntaxProblem as problem:
            return Query(None, [f"Cannot parse '{text}': {problem}"])
        warnings: list[str] = []
        node = require_positive(node, warnings)
        warn_leading_wildcards(node, warnings)
        return Query(node, [], warnings)

    def folded(self, text: str) -> str:
        return "".join(c.lower() for c in text) if self.lower else text

    def lexed(self, text: str, field: str, phrase: bool, slop: int = 0) -> Node | None:
        words = self.lexer.tokens(text)
        if len(words) < 2:
            return Term(words[0], field) if words else None
        if phrase:
            return Phrase(tuple(words), slop, field)
        return Bool(tuple((SHOULD, Term(w, field)) for w in words))


class _Reader:
    def __init__(self, parser: Parser, text: str):
        self.parser, self.text, self.at = parser, text, 0

    def next(self):
        """The next token without taking it; None at the end."""
        while self.at < len(self.text):
            found = _TOKEN.match(self.text, self.at)
            if not found:
                raise SyntaxProblem(f"unexpected {self.text[self.at]!r} at {self.at}")
            if found.lastgroup == "space" or found["space"]:
                self.at = found.end()
                continue
            return found
        return None

    @staticmethod
    def kind(found) -> str:
        return next(k for k in ("and", "or", "not", "plus", "minus", "open", "close", "colon", "boost", "quoted", "fuzzy", "regex", "range", "term") if found[k] is not None)

    def take(self, *kinds: str):
        found = self.next()
        if found and self.kind(found) in kinds:
            self.at = found.end()
            return found
        return None

    def whole(self) -> Node:
        if not self.next():
            raise SyntaxProblem("it is empty")
        node = self.clauses(self.parser.field)
        if found := self.next():
            raise SyntaxProblem(f"unexpected {found[0]!r} at {found.start()}")
        return node

    def clauses(self, field: str) -> Node:
        got: list[list] = []
        while True:
            join = self.take("and", "or") if got else None
            sign = self.take("plus", "minus", "not")
            found = self.next()
            if not found or self.kind(found) == "close":
                if join or sign or not got and not found:
                    raise SyntaxProblem("something is missing at the end")
                break
            node = self.clause(field)
            word = self.kind(join) if join else None
            if word == "and" and got and got[-1][0] != MUST_NOT:
                got[-1][0] = MUST
            if sign and self.kind(sign) in ("minus", "not"):
                occur = MUST_NOT
            else:
                occur = MUST if sign or word == "and" else SHOULD
            got.append([occur, node])
        got = [g for g in got if g[1] is not None] if any(g[1] is None for g in got) else got
        if len(got) == 1 and got[0][0] != MUST_NOT:
            return got[0][1]
        return Bool(tuple((occur, node) for occur, node in got))

    def clause(self, field: str) -> Node | None:
        found = self.next()
        after = _TOKEN.match(self.text, found.end()) if found.end() < len(self.text) else None
        if self.kind(found) == "term" and after and after["colon"]:
            self.at = after.end()
            name = plain(found["term"])
            if name == "*" and self.text[self.at : self.at + 1] == "*":
                self.at += 1
                return self.boosted(MatchAll())
            field = name
            if not self.next():
                raise SyntaxProblem("a field without a value")
        if self.take("open"):
            node = self.clauses(field)
            if not self.take("close"):
                raise SyntaxProblem("a group isn't closed")
            return self.boosted(node)
        return self.simple(field)

    def boosted(self, node: Node | None) -> Node | None:
        if found := self.take("boost"):
            if found["factor"] is None:
                raise SyntaxProblem("^ without a number")
            return None if node is None else Boost(node, float(found["factor"]))
        return node

    def simple(self, field: str) -> Node | None:
        parser = self.parser
        if found := self.take("quoted"):
            amount = self.take("fuzzy")
            slop = int(float(amount["amount"] or 0)) if amount else 0
            return self.boosted(parser.lexed(plain(found["quoted"][1:-1]), field, True, slop))
        if found := self.take("regex"):
            pattern = parser.folded(re.sub(r"\\/", "/", found["regex"][1:-1]))
            try:
                checked_regex(pattern)
            except UnsupportedRegex as problem:
                raise SyntaxProblem(str(problem)) from problem
            return self.boosted(Regex(pattern, field))
        if found := self.take("range"):
            inner = _RANGE.match(self.text, self.at)
            if not inner:
                raise SyntaxProblem(f"a range isn't closed or has no TO at {found.start()}")
            self.at = inner.end()

            def bound(text: str) -> str | None:
                if text == "*":
                    return None
                return parser.folded(plain(text[1:-1] if text[0] == '"' else text))

            return self.boosted(Range(bound(inner["low"]), bound(inner["high"]), found[0] == "[", inner["end"] == "]", field))
        if not (found := self.take("term")):
            found = self.next()
            raise SyntaxProblem(f"unexpected {found[0]!r} at {found.start()}")
        text = found["term"]
        amount = None
        after = _TOKEN.match(self.text, self.at) if self.at < len(self.text) else None
        if after and after["fuzzy"]:
            self.at = after.end()
            amount = after
        parts = [(plain(p), p in "*?") for p in re.findall(r"[*?]|(?:\\.|[^*?\\])+", text, re.S)]
        if amount:
            word = parser.folded(plain(text))
            return self.boosted(Fuzzy(word, fuzzy_edits(amount["amount"], len(word)), field))
        if any(special for _, special in parts):
            parts = tuple((p if special else parser.folded(p), special) for p, special in parts)
            if len(parts) == 2 and parts[1] == ("*", True) and not parts[0][1]:
                return self.boosted(Prefix(parts[0][0], field))
            return self.boosted(Wildcard(parts, field))
        return self.boosted(parser.lexed(plain(text), field, parser.auto_phrase))


def fuzzy_edits(amount: str | None, length: int) -> int:
    """No number: 2; below 1: a similarity of the whole word; whole numbers: so many edits, 2 at most."""
    if amount is None:
        return 2
    x = float(amount)
    if x >= 1:
        if x != int(x):
            raise SyntaxProblem("fractional edit distances are not allowed")
        return min(2, int(x))
    return 0 if x == 0 else min(2, int((1 - x) * length))
