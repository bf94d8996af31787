"""The fluent front end: ``field("price") > 10`` makes conditions, & and | combine them, ~ negates.

Conditions are plain trees until a schema binds them; any nesting of and, or and not is allowed and ends up as a disjunction of
conjunctions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from ..errors import BindError
from ..functions.values import bind
from ..schema import CollectionSchema
from . import query as Q


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return _Both(self, other)

    def __or__(self, other: Condition) -> Condition:
        return _Either(self, other)

    def __invert__(self) -> Condition:
        return _Not(self)

    def __bool__(self):
        raise TypeError("combine conditions with & and |")

    def branches(self, schema: CollectionSchema, negative: bool = False) -> tuple:
        raise NotImplementedError


@dataclass(eq=False)
class _Both(Condition):
    left: Condition
    right: Condition

    def branches(self, schema, negative=False):
        a, b = self.left.branches(schema, negative), self.right.branches(schema, negative)
        return a + b if negative else Q.conjoin(a, b)


@dataclass(eq=False)
class _Either(Condition):
    left: Condition
    right: Condition

    def branches(self, schema, negative=False):
        a, b = self.left.branches(schema, negative), self.right.branches(schema, negative)
        return Q.conjoin(a, b) if negative else a + b


@dataclass(eq=False)
class _Not(Condition):
    inner: Condition

    def branches(self, schema, negative=False):
        return self.inner.branches(schema, not negative)


@dataclass(eq=False)
class _Test(Condition):
    column: str
    op: str
    values: tuple

    def branches(self, schema, negative=False):
        f = schema[self.column]
        if any(isinstance(v, str) for v in self.values) and f.scalar.typeName() == "string":
            values = self.values  # Python text is meant as it stands
        else:
            values = tuple(bind(v, f.scalar, f.name) for v in self.values)
        atom = Q.Atom(f.name, self.op, values)
        if not negative:
            return ((atom,),)
        return ((atom.negated(),),)


class field:
    """A column in a condition."""

    def __init__(self, name: str):
        self.name = name

    def _test(self, op: str, *values) -> Condition:
        return _Test(self.name, op, values)

    def __eq__(self, v):  # type: ignore[override]
        return self._test(Q.EQ, v)

    def __ne__(self, v):  # type: ignore[override]
        return self._test(Q.NE, v)

    def __lt__(self, v):
        return self._test(Q.LT, v)

    def __le__(self, v):
        return self._test(Q.LE, v)

    def __gt__(self, v):
        return self._test(Q.GT, v)

    def __ge__(self, v):
        return self._test(Q.GE, v)

    __hash__ = None  # type: ignore[assignment]

    def isin(self, values: Iterable) -> Condition:
        return self._test(Q.IN, *values)

    def contains(self, value) -> Condition:
        """An element of a collection."""
        return self._test(Q.CONTAINS, value)

    def startswith(self, text: str) -> Condition:
        return self._test(Q.STARTS, text)

    def endswith(self, text: str) -> Condition:
        return self._test(Q.ENDS, text)

    def holds(self, text: str) -> Condition:
        """Text inside the column's text."""
        return self._test(Q.HOLDS, text)

    def is_true(self) -> Condition:
        return self._test(Q.EQ, True)

    def is_null(self) -> Condition:
        return self._test(Q.EQ, None)


@dataclass(frozen=True)
class Builder:
    """An unfinished query over a collection; every step returns a new one."""

    schema: CollectionSchema
    query: Q.Query
    runner: Callable[[Q.Query], object] | None = None

    def _with(self, **kw) -> Builder:
        return replace(self, query=replace(self.query, **kw))

    def where(self, condition: Condition) -> Builder:
        """Chained conditions must all hold."""
        return self._with(branches=Q.conjoin(self.query.branches, condition.branches(self.schema)))

    def select(self, *columns: str, **aliases: str) -> Builder:
        chosen = [(self.schema[c].name, self.schema[c].name) for c in columns] + [(self.schema[c].name, a) for a, c in aliases.items()]
        return self._with(select=tuple(chosen))

    def distinct(self) -> Builder:
        if not self.query.select:
            raise BindError("distinct needs columns")
        return self._with(distinct=True)

    def order_by(self, column: str, descending: bool = False) -> Builder:
        return self._with(order_by=self.schema[column].name, descending=descending)

    def order_by_descending(self, column: str) -> Builder:
        return self.order_by(column, True)

    def take(self, n: int) -> Builder:
        return self._with(take=n)

    def skip(self, n: int) -> Builder:
        return self._with(skip=n)

    def full_text(self, text: str) -> Builder:
        return self._with(full_text=text)

    def only_if_complete(self) -> Builder:
        return self._with(only_if_complete=True)

    def frame(self):
        return self.runner(self.query)

    def rows(self) -> list[dict]:
        return [r.asDict(True) for r in self.frame().collect()]

    def count(self) -> int:
        return self.runner(replace(self.query, count=True)).first()[0]

    def first(self) -> dict | None:
        found = self.runner(replace(self.query, take=1)).collect()
        return found[0].asDict(True) if found else None
