"""What a form needs to know about a collection's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import query as Q
from ..schema import CollectionSchema, Field

MOST_VALUES = 1000


def operators(field: Field) -> list[str]:
    """The tests that a column's type allows."""
    if field.is_collection:
        return [Q.CONTAINS, Q.NOT_CONTAINS]
    if isinstance(field.type, T.BooleanType):
        return [Q.EQ, Q.NE, "is null", "is not null"]
    base = [Q.EQ, Q.NE, Q.IN, Q.NOT_IN, "is null", "is not null"]
    if isinstance(field.type, T.StringType):
        return [*base, "starts with", "ends with", "contains text"]
    return [*base, Q.LT, Q.LE, Q.GT, Q.GE]


def kind(field: Field) -> str:
    t = field.scalar
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string"


def values(df: DataFrame, field: Field, most: int = MOST_VALUES) -> list:
    """The distinct values in order, or nothing when there are more than ``most``."""
    c = F.col(f"`{field.name}`")
    found = df.select((F.explode(c) if field.is_collection else c).alias("v")).distinct().orderBy(F.col("v").asc_nulls_first()).limit(most + 1).collect()
    return [] if len(found) > most else [r[0] for r in found]


def describe(df: DataFrame, schema: CollectionSchema, most: int = MOST_VALUES) -> list[dict]:
    return [{"name": f.name, "type": kind(f), "collection": f.is_collection, "operators": operators(f), "values": values(df, f, most)} for f in schema.fields if f.queryable]


def summary(df: DataFrame, schema: CollectionSchema) -> DataFrame:
    """(column, type, distinct, low, high) of the scalar columns in one pass."""
    fields = [f for f in schema.fields if f.queryable and not f.is_collection]
    aggregates = []
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggregates += [F.count_distinct(c).alias(f"d{k}"), F.min(c).cast("string").alias(f"l{k}"), F.max(c).cast("string").alias(f"h{k}")]
    rows = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(kind(f)).alias("type"), F.col(f"d{k}").alias("distinct"), F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high")) for k, f in enumerate(fields)])).alias("r")
    return df.agg(*aggregates).select(rows).select("r.*")


#: Operators of a form and their text in the dialect.
_FORM = {"=": "{c} = {v}", "<>": "{c} <> {v}", "<": "{c} < {v}", "<=": "{c} <= {v}", ">": "{c} > {v}", ">=": "{c} >= {v}", "contains": "{c} contains {v}", "not contains": "{c} not contains {v}", "is null": "{c} = null", "is not null": "{c} <> null"}
_LIKES = {"starts with": "{}%", "ends with": "%{}", "contains text": "%{}%"}


def form_to_sql(collection: str, parts: list[dict], order_by: str | None = None, descending: bool = False, take: int = 0) -> str:
    """SQL text of a structured form: each part has column, operator and values, and all must hold."""
    tests = []
    quote = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "\\'") + "'"
    for p in parts:
        c, op, given = p["column"], p["operator"], list(p.get("values", []))
        if op in _LIKES:
            tests.append(f"{c} like {quote(_LIKES[op].format(given[0]))}")
        elif op in (Q.IN, Q.NOT_IN) or len(given) > 1 and op in ("=", "<>"):
            tests.append(f"{c} {'not in' if op in (Q.NOT_IN, '<>') else 'in'} ({', '.join(map(quote, given))})")
        else:
            tests.append(_FORM[op].format(c=c, v=quote(given[0]) if given else ""))
    out = f"select from {collection}" + (f" where {' and '.join(tests)}" if tests else "")
    if order_by:
        out += f" order by {order_by}" + " descending" * descending
    return out + (f" take {take}" if take else "")
