"""The one place that knows the truth rules.

Equality has two values: null equals null and differs from everything else. In an order null is smaller than any value. Text tests
other than equality ignore case and are false for null. A null collection is an empty one. Forms are chosen so that Spark pushes
them to the Parquet scan: no ``coalesce`` around a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError
from ..plans import query as Q
from ..schema import CollectionSchema


def literal(value, kind: T.DataType) -> Column:
    out = F.lit(value)
    if value is None or isinstance(kind, T.DecimalType) or isinstance(value, bool):
        return out.cast(kind) if value is None else out
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return out.cast(kind)
    return out


def _order(c: Column, op: str, value, kind: T.DataType) -> Column:
    """Comparison with null below everything; not wrapped, so a null result filters the row out."""
    if value is None:
        return {Q.LT: F.lit(False), Q.LE: c.isNull(), Q.GT: c.isNotNull(), Q.GE: F.lit(True)}[op]
    v = literal(value, kind)
    return {Q.LT: c.isNull() | (c < v), Q.LE: c.isNull() | (c <= v), Q.GT: c > v, Q.GE: c >= v}[op]


def column_of(atom: Q.Atom, schema: CollectionSchema) -> Column:
    """The comparison as a filter condition."""
    field = schema[atom.column]
    c, kind, op = F.col(f"`{field.name}`"), field.scalar, atom.op
    if field.is_collection:
        if op not in (Q.CONTAINS, Q.NOT_CONTAINS):
            raise BindError(f"{field.name} is a collection: only contains and not contains apply")
        found = F.array_contains(c, literal(atom.value, kind)) if atom.value is not None else F.exists(c, lambda x: x.isNull())
        has = F.coalesce(found, F.lit(False))
        return ~has if op == Q.NOT_CONTAINS else has
    if op in (Q.CONTAINS, Q.NOT_CONTAINS):
        raise BindError(f"{field.name} is not a collection")
    if op == Q.EQ:
        return c.eqNullSafe(literal(atom.value, kind)) if atom.value is not None else c.isNull()
    if op == Q.NE:
        return ~c.eqNullSafe(literal(atom.value, kind)) if atom.value is not None else c.isNotNull()
    if op in Q.RANGES:
        low, high = Q.RANGES[op]
        lower = _order(c, low, atom.values[0], kind)
        # A lower bound that is a value shuts nulls out already: the bare upper comparison is enough.
        upper = _order(c, high, atom.values[1], kind) if atom.values[0] is None or atom.values[1] is None else (c < literal(atom.values[1], kind) if high == Q.LT else c <= literal(atom.values[1], kind))
        return lower & upper
    if op in (Q.LT, Q.LE, Q.GT, Q.GE):
        return _order(c, op, atom.value, kind)
    if op in (Q.IN, Q.NOT_IN):
        some = [literal(v, kind) for v in atom.values if v is not None]
        has_null = len(some) < len(atom.values)
        inside = c.isin(some) if some else F.lit(False)
        if op == Q.IN:
            return inside | c.isNull() if has_null else inside
        outside = ~inside if some else F.lit(True)
        return c.isNotNull() & outside if has_null else c.isNull() | outside
    if not isinstance(kind, T.StringType):
        raise BindError(f"{field.name} is not text")
    low, v = F.lower(c), F.lit(atom.value.lower())
    base = op.removeprefix("not ")
    test = {Q.STARTS: F.startswith, Q.ENDS: F.endswith, Q.HOLDS: F.contains}[base](low, v)
    return c.isNull() | ~test if base != op else test


def where(query: Q.Query, schema: CollectionSchema) -> Column | None:
    """The whole condition, or None when every row passes."""
    if query.unconditional:
        return None
    out = None
    for branch in query.branches:
        both = None
        for atom in branch:
            c = column_of(atom, schema)
            both = c if both is None else both & c
        out = both if out is None else out | both
    return out


def holds(atom: Q.Atom, row: dict) -> bool:
    """The same rules on one Python row; the tests' yardstick and the check of conditional writes."""
    x, op = row.get(atom.column), atom.op
    if op in (Q.CONTAINS, Q.NOT_CONTAINS):
        return (atom.value in (x or [])) == (op == Q.CONTAINS)
    if op in (Q.EQ, Q.NE):
        return (x == atom.value) == (op == Q.EQ)
    if op in (Q.IN, Q.NOT_IN):
        return (x in atom.values) == (op == Q.IN)
    if op in Q.RANGES:
        return all(holds(Q.Atom(atom.column, o, (v,)), row) for o, v in zip(Q.RANGES[op], atom.values))
    if op in (Q.LT, Q.LE, Q.GT, Q.GE):
        v = atom.value
        if x is None or v is None:
            sign = (x is not None) - (v is not None)
        else:
            sign = (x > v) - (x < v)
        return {Q.LT: sign < 0, Q.LE: sign <= 0, Q.GT: sign > 0, Q.GE: sign >= 0}[op]
    base = op.removeprefix("not ")
    low, v = (x or "").lower(), atom.value.lower()
    ok = x is not None and {Q.STARTS: low.startswith(v), Q.ENDS: low.endswith(v), Q.HOLDS: v in low}[base]
    return ok == (base == op)


def matches(query: Q.Query, row: dict) -> bool:
    return query.unconditional or any(all(holds(a, row) for a in b) for b in query.branches)
