"""Syntax trees of boolean queries (survey Q15): rendering, and compilation to a predicate over a collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.analysis import analyze, contains_phrase, has_letters

MATCH_ALL = "*:*"


@dataclass(frozen=True)
class Scope:
    """Columns that terms are looked up in: analysed text fields and exact keyword fields; default: where no field is named."""

    text: tuple[str, ...] = ()
    keyword: tuple[str, ...] = ()
    default: tuple[str, ...] = ()

    def fields(self, name: str | None) -> tuple[str, ...]:
        if name is None:
            return self.default or self.text
        if name not in (*self.text, *self.keyword):
            raise ValueError(f"unknown field {name}")
        return (name,)

    def starts(self, prefix: str, name: str | None) -> Column:
        """Whether any of the fields has a keyword, or a token, that starts with the prefix."""
        found = F.lit(False)
        for f in self.fields(name):
            own = F.col(f).cast("string").startswith(prefix) if f in self.keyword else F.exists(analyze(F.col(f)), lambda t: t.startswith(prefix.lower()))
            found = found | F.coalesce(own, F.lit(False))
        return found

    def holds(self, phrase: str, name: str | None) -> Column:
        """Whether any of the fields has the phrase: an equal keyword, or its tokens in a row."""
        found = F.lit(False)
        for f in self.fields(name):
            own = F.col(f).cast("string") == phrase if f in self.keyword else has_letters(F.col(f), phrase) & contains_phrase(analyze(F.col(f)), analyze(F.lit(phrase)))
            found = found | F.coalesce(own, F.lit(False))
        return found


def is_prefix(value: str) -> bool:
    """`java*`, but not `*` alone."""
    return len(value) > 1 and value.endswith("*") and "*" not in value[:-1]


class Node:
    def render(self) -> str:
        raise NotImplementedError

    def predicate(self, scope: Scope, name: str | None = None) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Node):
    value: str

    def render(self) -> str:
        return self.value

    def predicate(self, scope: Scope, name: str | None = None) -> Column:
        if is_prefix(self.value):
            return scope.starts(self.value[:-1], name)
        return F.lit(True) if self.value == MATCH_ALL else scope.holds(self.value, name)


@dataclass(frozen=True)
class Phrase(Node):
    value: str

    def render(self) -> str:
        return f'"{self.value}"'

    def predicate(self, scope: Scope, name: str | None = None) -> Column:
        return scope.holds(self.value, name)


@dataclass(frozen=True)
class Binary(Node):
    operator: str
    left: Node
    right: Node

    def render(self) -> str:
        return f"({self.left.render()} {self.operator} {self.right.render()})"

    def predicate(self, scope: Scope, name: str | None = None) -> Column:
        a, b = self.left.predicate(scope, name), self.right.predicate(scope, name)
        return a & b if self.operator == "AND" else a | b


@dataclass(frozen=True)
class Not(Node):
    inner: Node

    def render(self) -> str:
        return f"NOT {self.inner.render()}"

    def predicate(self, scope: Scope, name: str | None = None) -> Column:
        return ~self.inner.predicate(scope, name)


@dataclass(frozen=True)
class InField(Node):
    name: str
    inner: Node

    def render(self) -> str:
        return f"{self.name}:({self.inner.render()})"

    def predicate(self, scope: Scope, name: str | None = None) -> Column:
        if self.name == "*" and self.inner == Term("*"):  # what *:* lexes to
            return F.lit(True)
        return self.inner.predicate(scope, self.name)
