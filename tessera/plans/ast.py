"""Queries as trees, the fluent builder, and the rewrites that warn."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

MUST, SHOULD, MUST_NOT = "+", "", "-"
AND, OR, NOT = "and", "or", "not"
# The warnings.
NEGATIVE_WARNING = "Negative clause may require a full index scan"
POSTFIX_WARNING = "Postfix wildcard expression requires a full index scan"


class Node:
    """A condition on a document; boost plays no part in whether it holds."""


@dataclass(frozen=True)
class Term(Node):
    word: str
    field: str = "content"

    def __str__(self):
        return f"{self.field}:{self.word}"


@dataclass(frozen=True)
class Phrase(Node):
    words: tuple[str, ...]
    slop: int = 0
    field: str = "content"

    def __str__(self):
        return f'{self.field}:"{" ".join(self.words)}"' + (f"~{self.slop}" if self.slop else "")


@dataclass(frozen=True)
class Prefix(Node):
    prefix: str
    field: str = "content"

    def __str__(self):
        return f"{self.field}:{self.prefix}*"


@dataclass(frozen=True)
class Wildcard(Node):
    """parts: literal texts, with ? and * as one-character strings that are marked True."""

    parts: tuple[tuple[str, bool], ...]
    field: str = "content"

    @property
    def leading(self) -> bool:
        return bool(self.parts) and self.parts[0][1]

    def __str__(self):
        return f"{self.field}:" + "".join(p for p, _ in self.parts)


@dataclass(frozen=True)
class Regex(Node):
    pattern: str
    field: str = "content"

    def __str__(self):
        return f"{self.field}:/{self.pattern}/"


@dataclass(frozen=True)
class Fuzzy(Node):
    word: str
    edits: int = 2
    field: str = "content"

    def __str__(self):
        return f"{self.field}:{self.word}~{self.edits}"


@dataclass(frozen=True)
class Range(Node):
    """A bound of None is open."""

    low: str | None
    high: str | None
    include_low: bool = True
    include_high: bool = True
    field: str = "content"

    def __str__(self):
        return f"{self.field}:{'[' if self.include_low else '{'}{self.low or '*'} TO {self.high or '*'}{']' if self.include_high else '}'}"


@dataclass(frozen=True)
class MatchAll(Node):
    def __str__(self):
        return "*:*"


@dataclass(frozen=True)
class Boost(Node):
    node: Node
    factor: float

    def __str__(self):
        return f"({self.node})^{self.factor:g}"


@dataclass(frozen=True)
class Bool(Node):
    """All MUST, no MUST_NOT, and, where there is no MUST, at least one SHOULD."""

    clauses: tuple[tuple[str, Node], ...]

    def __str__(self):
        return " ".join(f"{occur}({node})" if isinstance(node, Bool) else f"{occur}{node}" for occur, node in self.clauses)


@dataclass
class Query:
    """A tree, or none; errors keep it from being run."""

    node: Node | None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def require_positive(node: Node, warnings: list[str]) -> Node:
    """Gives every group of negative clauses alone all documents to take from, with a warning. Empty groups match nothing."""
    if isinstance(node, Boost):
        return Boost(require_positive(node.node, warnings), node.factor)
    if not isinstance(node, Bool):
        return node
    clauses = tuple((occur, require_positive(n, warnings)) for occur, n in node.clauses)
    if clauses and all(occur == MUST_NOT for occur, _ in clauses):
        warnings.append(f"{NEGATIVE_WARNING}: {node}")
        clauses = (*clauses, (MUST, MatchAll()))
    return Bool(clauses)


def warn_leading_wildcards(node: Node, warnings: list[str]) -> None:
    if isinstance(node, Bool):
        for _, n in node.clauses:
            warn_leading_wildcards(n, warnings)
    elif isinstance(node, Boost):
        warn_leading_wildcards(node.node, warnings)
    elif isinstance(node, Wildcard) and node.leading:
        warnings.append(f"{POSTFIX_WARNING}: {node}")


class Builder:
    """Queries without text syntax; words are taken as they are."""

    def __init__(self, parse=None):
        self._parse = parse

    def value(self, word: str) -> Query:
        return Query(Term(word))

    def phrase(self, *words: str) -> Query:
        return Query(Phrase(tuple(words)))

    def prefix(self, prefix: str) -> Query:
        return Query(Prefix(prefix))

    def engine_specific(self, text: str) -> Query:
        return self._parse(text)

    def boolean(self, clauses: Iterable[tuple[str, Query]]) -> Query:
        """Clauses of AND, OR and NOT: what holds is all AND, no NOT, and one of the OR clauses, if there are any.

        Clauses that couldn't be parsed are left out; their errors and warnings stay.
        """
        clauses = list(clauses)
        errors = [e for _, q in clauses for e in q.errors]
        warnings = [w for _, q in clauses for w in q.warnings]
        occurs = {AND: MUST, NOT: MUST_NOT}
        given = [(occurs.get(op), q.node) for op, q in clauses if q.node is not None]
        either = tuple((SHOULD, n) for occur, n in given if occur is None)
        flat = tuple((occur, n) for occur, n in given if occur is not None)
        if either:
            flat = (*flat, (MUST, Bool(either)))
        if not flat:
            return Query(None, errors, warnings)
        node = Bool(flat)
        if all(occur == MUST_NOT for occur, _ in flat):
            warnings.append(f"{NEGATIVE_WARNING}: {node}")
            node = Bool((*flat, (MUST, MatchAll())))
        return Query(node, errors, warnings)
