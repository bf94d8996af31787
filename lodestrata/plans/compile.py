"""From a query to a DataFrame. Catalyst takes it from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import where
from ..schema import CollectionSchema
from .query import Query


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def ordering(query: Query, schema: CollectionSchema, columns: set[str] | None = None) -> list[Column]:
    """The order column with null smallest, then the key in the same direction (where it is still there)."""
    way = (lambda c: _col(c).desc_nulls_last()) if query.descending else (lambda c: _col(c).asc_nulls_first())
    names = [query.order_by] + [schema.key] * (query.order_by.lower() != schema.key.lower())
    return [way(n) for n in names if columns is None or n in columns]


def filtered(df: DataFrame, query: Query, schema: CollectionSchema) -> DataFrame:
    condition = where(query, schema)
    return df if condition is None else df.filter(condition)


def bounded(df: DataFrame, query: Query) -> DataFrame:
    if query.skip:
        df = df.offset(query.skip)
    return df.limit(query.take) if query.take else df


def projected(query: Query) -> list[Column]:
    return [_col(c).alias(a) for c, a in query.select]


def run(query: Query, df: DataFrame, schema: CollectionSchema) -> DataFrame:
    """The query's rows, without its full-text part; a count is one row with ``count``."""
    rows = filtered(df, query, schema)
    if query.distinct:
        rows = _distinct(rows, query, schema)
    elif query.count:
        rows = bounded(rows, query) if query.take or query.skip else rows
    else:
        if query.order_by:
            rows = rows.orderBy(*ordering(query, schema))
        rows = bounded(rows, query)
        if query.select:
            rows = rows.select(*projected(query))
    return rows.agg(F.count("*").alias("count")) if query.count else rows


def _distinct(rows: DataFrame, query: Query, schema: CollectionSchema) -> DataFrame:
    """Distinct tuples; for a single collection column its distinct elements. An order by another column ranks a tuple by its first row."""
    aliases = [a for _, a in query.select]
    if len(query.select) == 1 and schema[query.select[0][0]].is_collection:
        out = rows.select(F.explode(_col(query.select[0][0])).alias(aliases[0])).distinct()
        if query.order_by and query.order_by == query.select[0][0]:
            out = out.orderBy(_col(aliases[0]).desc_nulls_last() if query.descending else _col(aliases[0]).asc_nulls_first())
    elif not query.order_by:
        out = rows.select(*projected(query)).distinct()
    else:
        pick = F.max if query.descending else F.min
        known = {c: a for c, a in query.select}
        if query.order_by in known:
            keys = [known[query.order_by], *[a for a in aliases if a != known[query.order_by]]]
            out = rows.select(*projected(query)).distinct()
        else:
            nulls = F.max(_col(query.order_by).isNull().cast("int"))
            out = rows.groupBy(*projected(query)).agg(pick(_col(query.order_by)).alias("__order"), nulls.alias("__null"))
            # Null is smallest: ascending, a tuple with a null comes first.
            out = out.withColumn("__order", F.when(F.col("__null") == 1, F.lit(None)).otherwise(F.col("__order"))) if not query.descending else out
            keys = ["__order", *aliases]
        way = (lambda c: _col(c).desc_nulls_last()) if query.descending else (lambda c: _col(c).asc_nulls_first())
        out = out.orderBy(*[way(k) for k in keys])
        if "__order" in out.columns:
            out = out.drop("__order", "__null")
    return bounded(out, query)
