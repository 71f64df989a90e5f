"""Expression constraints over concepts: lexer, parser, AST, and compilation to set plans.

    expression := refined-chain { OR refined-chain }
    chain      := refined { (AND | MINUS) refined }          equal precedence, left to right
    refined    := unary [ ":" refinement ]
    refinement := conjunction { OR conjunction }
    conjunction:= attribute { (AND | ",") attribute }        takes AND greedily
    attribute  := ID "=" unary | "(" refinement ")"
    unary      := [ "<" | "<<" ] ID | "(" expression ")"
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hierarchy import descendants
from ..sources.storage import stored


class EclError(ValueError):
    """Bad syntax, or a result that is too large."""


@dataclass(frozen=True)
class Concept:
    concept_id: str
    below: str = ""  # "", "<" or "<<"


@dataclass(frozen=True)
class SetOp:
    name: str  # AND, OR, MINUS
    left: object
    right: object


@dataclass(frozen=True)
class Attribute:
    type_id: str
    value: object


@dataclass(frozen=True)
class Refined:
    focus: object
    refinement: object


_TOKEN = re.compile(r"\s*(?:(?P<id>\d+)|(?P<op><<|<|[():=,])|(?P<word>[A-Za-z]+))")
WORDS = ("AND", "OR", "MINUS")


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, position); ends with an end token."""
    out, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found:
            raise EclError(f"unexpected character {text[at:].strip()[0]!r} at {at}")
        kind, start = found.lastgroup, found.start(found.lastgroup)
        value = found[kind]
        if kind == "word":
            if value.upper() not in WORDS:
                raise EclError(f"unknown word {value!r} at {start}: only AND, OR and MINUS are allowed")
            value = value.upper()
        out.append((kind, value, start))
        at = found.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)

    def peek(self) -> str:
        return self.rest[0][1]

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        got_kind, got, at = self.rest[0]
        if (value is not None and got != value) or (kind is not None and got_kind != kind):
            raise EclError(f"expected {value or kind} at {at}, found {got or 'the end'!r}")
        self.rest.pop(0)
        return got

    def chain(self, part, names: dict[str, str]):
        left = part()
        while self.peek() in names:
            left = SetOp(names[self.take()], left, part())
        return left

    def expression(self):
        return self.chain(lambda: self.chain(self.refined, {"AND": "AND", "MINUS": "MINUS"}), {"OR": "OR"})

    def refined(self):
        focus = self.unary()
        if self.peek() != ":":
            return focus
        self.take(":")
        return Refined(focus, self.refinement())

    def refinement(self):
        return self.chain(lambda: self.chain(self.attribute, {"AND": "AND", ",": "AND"}), {"OR": "OR"})

    def attribute(self):
        if self.peek() == "(":
            self.take("(")
            inner = self.refinement()
            self.take(")")
            return inner
        name = self.take(kind="id")
        self.take("=")
        return Attribute(name, self.unary())

    def unary(self):
        if self.peek() == "(":
            self.take("(")
            inner = self.expression()
            self.take(")")
            return inner
        below = self.take() if self.peek() in ("<", "<<") else ""
        return Concept(self.take(kind="id"), below)


def parse(text: str):
    parser = _Parser(text)
    tree = parser.expression()
    parser.take(kind="end")
    return tree


def validate(text: str) -> tuple[object | None, str | None]:
    """The tree, or what is wrong with the text."""
    try:
        return parse(text), None
    except EclError as error:
        return None, str(error)


@dataclass
class EclSpace:
    """What expressions are evaluated on: concepts, closure, attribute edges. Pairs and edges may come
    more than once; without being stored, they are read only where an expression asks."""

    concepts: DataFrame
    closure: DataFrame
    attributes: DataFrame

    def compile(self, tree) -> DataFrame:
        """One plan of distinct concept_id, lazy but for the values of attributes."""
        if isinstance(tree, str):
            tree = parse(tree)
        if isinstance(tree, Concept):
            if tree.below:
                return descendants(self.closure, self.concepts, tree.concept_id, include_self=tree.below == "<<")
            return self.concepts.sparkSession.range(1).select(F.lit(tree.concept_id).alias("concept_id"))
        if isinstance(tree, SetOp):
            return _combine(tree.name, self.compile(tree.left), self.compile(tree.right))
        focus = self.compile(tree.focus)
        return focus.join(self.refine(tree.refinement), "concept_id", "left_semi")

    def refine(self, tree) -> DataFrame:
        """Active concepts that have the attributes; role groups don't matter."""
        if isinstance(tree, SetOp):
            return _combine(tree.name, self.refine(tree.left), self.refine(tree.right))
        values = self.compile(tree.value).withColumnRenamed("concept_id", "destination_id")
        if not isinstance(tree.value, Concept) or tree.value.below:
            values = stored(values, "values")  # so that Spark knows their size: few are broadcast, and no edge is shuffled for them
        found = self.attributes.where(F.col("type_id") == tree.type_id).join(values, "destination_id", "left_semi")
        active = self.concepts.where("active").select("concept_id")
        return found.select(F.col("source_id").alias("concept_id")).distinct().join(active, "concept_id", "left_semi")

    def expand(self, text: str, most: int = 200_000) -> DataFrame:
        """compile() with a guard: more than most concepts are an error."""
        ids = self.compile(text)
        if ids.limit(most + 1).count() > most:
            raise EclError(f"the expression expands to more than {most} concepts")
        return ids


def _combine(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    if name == "AND":
        return left.intersect(right)
    return left.union(right).distinct() if name == "OR" else left.subtract(right)


def scope(ids: DataFrame, area: DataFrame | None = None, most: int = 20_000) -> DataFrame:
    """ids within an area, at most so many in order of id. An empty scope stays empty."""
    inside = ids if area is None else ids.intersect(area)
    return inside.orderBy("concept_id").limit(most)
