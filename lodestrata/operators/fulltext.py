"""Ranked full-text search.

Lines are a document's texts: a string field, each element of a string array, each string inside nested values. A posting is a
(token, key, line); a token's weight is log10(postings / postings with it). A line scores the sum of the weights of the query's
tokens in it, times 100 n when n > 1 of them are there, times a bonus for tokens in the query's order. A document scores the sum over its lines
times the number of distinct query tokens it has; documents under a twentieth of the best are cut.

Stop tokens: when there are more than ``most_entries`` postings (0: any number is fine), the tokens in most lines are dropped one after
the other until no more postings are left than that, at most ``most_ignored`` of them. Dropped tokens find nothing and their postings
don't count for the weights of the others.

``Index`` keeps the postings as a table of lists sorted by token, written once per snapshot; a search reads the few tokens it needs
through a pushed filter. ``scan`` ranks without an index in one pass over the lines. Only the query's tokens and one maximum are ever on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import CollectionSchema
from . import packing

CUT = 20.0
MOST_IGNORED = 100


def _texts(c: Column, kind: T.DataType) -> Column | None:
    """All texts inside a value as one array, nulls removed; dates in text form are no text to search."""
    if isinstance(kind, T.StringType):
        return F.array(c)
    if isinstance(kind, T.StructType):
        parts = [p for p in (_texts(c[f"`{f.name}`" if "." in f.name else f.name], f.dataType) for f in kind.fields) if p is not None]
        return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else None
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return c
        probe = _texts(F.lit(None), kind.elementType)
        return F.flatten(F.transform(c, lambda x: _texts(x, kind.elementType))) if probe is not None else None
    return None


_DATE_LIKE = r"^\d{4}-\d{2}-\d{2}(T[\d:.]+Z?([+-]\d{2}:\d{2})?)?$"


def spread(df: DataFrame) -> DataFrame:
    """Few files make few tasks; tokenising is worth a shuffle of the rows then. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def lines(df: DataFrame, schema: CollectionSchema, fields: Iterable[str] | None = None) -> DataFrame:
    """(key, line, text) of every text of the fields that are searched."""
    arrays = []
    for name in fields or schema.full_text:
        f = schema.find(name)
        found = _texts(F.col(f"`{f.name}`"), f.type)
        if found is not None:
            arrays.append(F.coalesce(found, F.array().cast("array<string>")))
    if not arrays:
        return df.select(F.col(f"`{schema.key}`").alias("key"), F.lit(0).alias("line"), F.lit("").alias("text")).limit(0)
    return df.select(F.col(f"`{schema.key}`").alias("key"), F.posexplode(F.concat(*arrays)).alias("line", "text")).filter(F.col("text").isNotNull() & ~F.col("text").rlike(_DATE_LIKE))


def postings(lined: DataFrame, squeeze: bool = True) -> DataFrame:
    """(token, key, line, position): each token of a line once, at its first place. No shuffle: a line's tokens are one row's."""
    listed = lined.withColumn("tokens", X.tokens(F.col("text"), squeeze)).select("key", "line", "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    return listed.select("token", "key", "line", (F.array_position("tokens", F.col("token")) - 1).cast("int").alias("position"))


def frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def most_frequent(df: DataFrame, schema: CollectionSchema, most: int, fields: Iterable[str] | None = None, squeeze: bool = True) -> DataFrame:
    """(token, df): the tokens in most lines, ties by token."""
    return frequencies(postings(spread(lines(df, schema, fields)), squeeze)).orderBy(F.col("df").desc(), "token").limit(most)


def bonus(query: list[str], positions: dict[str, int]) -> float:
    """The factor for tokens that stand in the query's order: exact neighbours weigh most."""
    at = [(k, positions.get(t, -1)) for k, t in enumerate(query)]
    low = min((max(p, 0) for _, p in at), default=0)
    kept = [(k, p - low) for k, p in at if p >= 0]
    out = 1.0
    for (k0, p0), (k1, p1) in zip(kept, kept[1:]):
        gap = (p1 - p0) - (k1 - k0)
        out *= {0: 100.0, 1: 50.0, 2: 30.0}.get(gap, 2.0 if p1 > p0 else 1.0)
    return out


def _bonus_column(query: list[str], at: dict[str, Column]) -> Column:
    """The same as an expression over columns that hold each token's place, from 1, or 0; ``query`` is short, so is the fold."""
    start = F.struct(F.lit(1.0).alias("m"), F.lit(-1).alias("k"), F.lit(-1).alias("p"))
    places = F.array(*[F.struct(F.lit(k).alias("k"), (at[t] - 1).cast("int").alias("p")) for k, t in enumerate(query)])

    def step(acc: Column, x: Column) -> Column:
        gap = (x["p"] - acc["p"]) - (x["k"] - acc["k"])
        factor = F.when(acc["k"] < 0, 1.0).when(gap == 0, 100.0).when(gap == 1, 50.0).when(gap == 2, 30.0).when(x["p"] > acc["p"], 2.0).otherwise(1.0)
        return F.when(x["p"] < 0, acc).otherwise(F.struct((acc["m"] * factor).alias("m"), x["k"].alias("k"), x["p"].alias("p")))

    return F.aggregate(places, start, step, lambda acc: acc["m"])


class Index:
    """Postings of one snapshot of a collection. Stored, each task's are a file of lists (see ``packing``), sorted by token in runs, so
    that a search finds a token's lists by the statistics of row groups and pages."""

    def __init__(self, posted: DataFrame, squeeze: bool = True, packed: DataFrame | None = None):
        self.posted, self.squeeze, self._packed = posted, squeeze, packed

    @staticmethod
    def write(df: DataFrame, schema: CollectionSchema, path: str, squeeze: bool = True) -> None:
        """One pass over the lines, without a shuffle of postings."""
        packing.pack(spread(lines(df, schema)), squeeze).write.parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, key: T.DataType, squeeze: bool = True) -> Index:
        packed = spark.read.schema(packing.schema(key)).parquet(path)
        return Index(packing.unpack(packed), squeeze, packed)

    @staticmethod
    def of(df: DataFrame, schema: CollectionSchema, fields: Iterable[str] | None = None, squeeze: bool = True) -> Index:
        return Index(postings(lines(df, schema, fields), squeeze), squeeze)

    def entries(self) -> int:
        return self.posted.count() if self._packed is None else self._packed.agg(F.sum("n")).first()[0] or 0

    def frequencies(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, df) of all tokens or of some; of lists their lengths alone are read."""
        posted = self.posted if self._packed is None else self._packed
        found = posted if tokens is None else posted.filter(F.col("token").isin(tokens))
        return frequencies(found) if self._packed is None else found.groupBy("token").agg(F.sum("n").alias("df"))

    def stops(self, most_entries: int, most_ignored: int = MOST_IGNORED, entries: int | None = None) -> tuple[list[str], int]:
        """The tokens to drop and the postings that are left."""
        return stop_tokens(self.frequencies(), self.entries() if entries is None else entries, most_entries, most_ignored)

    def search(self, text: str, take: int = 0, stop: Iterable[str] = (), entries: int | None = None, most_entries: int = 0, most_ignored: int = MOST_IGNORED) -> DataFrame:
        """(key, score, tokens) of the documents found, best first, ties by key. Tokens of ``stop`` count for nothing."""
        total = self.entries() if entries is None else entries
        dropped, total = self.stops(most_entries, most_ignored, total)
        stop = {*stop, *dropped}
        query, wanted = _query(text, stop, self.squeeze)
        if not wanted:
            return _nothing(self.posted.sparkSession, self.posted.schema["key"].dataType)
        every = list(dict.fromkeys(query))
        hits = self.posted.filter(F.col("token").isin(every))
        df = {r[0]: r[1] for r in self.frequencies(wanted).collect()}
        place = [F.min(F.when(F.col("token") == t, F.col("position") + 1)).alias(f"p{k}") for k, t in enumerate(every)]
        per_line = hits.groupBy("key", "line").agg(*place)
        per_line = per_line.select("key", "line", *[F.coalesce(f"p{k}", F.lit(0)).alias(f"p{k}") for k in range(len(every))])
        return _rank(per_line, query, wanted, df, total, take)


def stop_tokens(counted: DataFrame, total: int, most_entries: int, most_ignored: int = MOST_IGNORED) -> tuple[list[str], int]:
    """The rule of stop tokens for (token, df) of ``total`` postings; ties go by token."""
    if not most_entries or total <= most_entries:
        return [], total
    dropped = []
    for token, n in counted.orderBy(F.col("df").desc(), "token").limit(most_ignored).collect():
        if total <= most_entries:
            break
        dropped.append(token)
        total -= n
    return dropped, total


def _query(text: str, stop: Iterable[str], squeeze: bool) -> tuple[list[str], list[str]]:
    """The query's tokens in order, and the distinct ones that score."""
    query = [X.normalize_text(t, squeeze) for t in X.split_text(text)]
    stop = set(stop)
    return query, list(dict.fromkeys(q for q in query if not X.is_symbol(q) and q not in stop))


def _nothing(spark: SparkSession, key: T.DataType) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("key", key), T.StructField("score", T.DoubleType()), T.StructField("tokens", T.IntegerType())]))


def _rank(per_line: DataFrame, query: list[str], wanted: list[str], df: dict[str, int], total: int, take: int) -> DataFrame:
    """Scores from (key, line, p0, p1, ...): the place, from 1, of each distinct query token in the line, 0 where it isn't."""
    every = list(dict.fromkeys(query))
    known = [t for t in wanted if df.get(t, 0) > 0]
    if not known or not total:
        return _nothing(per_line.sparkSession, per_line.schema["key"].dataType)
    at = {t: F.col(f"p{k}") for k, t in enumerate(every)}
    base = sum((F.when(at[t] > 0, math.log10(total / df[t])).otherwise(0.0) for t in known), F.lit(0.0))
    n = sum(((at[t] > 0).cast("int") for t in known), F.lit(0))
    factor = F.when(n > 1, 100.0 * n).otherwise(1.0)
    flags = [(at[t] > 0).cast("int").alias(f"f{k}") for k, t in enumerate(known)]
    line = per_line.filter(n > 0).select("key", (base * factor * _bonus_column(query, at)).alias("s"), *flags)
    docs = line.groupBy("key").agg(F.sum("s").alias("s"), *[F.max(f"f{k}").alias(f"f{k}") for k in range(len(known))])
    count = sum((F.col(f"f{k}") for k in range(len(known))), F.lit(0))
    ranked = docs.select("key", (F.col("s") * count).alias("score"), count.cast("int").alias("tokens"))
    best = ranked.agg(F.max("score").alias("best")).scalar()
    kept = ranked.filter(F.col("score") >= best / CUT)
    out = kept.orderBy(F.col("score").desc(), "key")
    return out.limit(take) if take else out


def scan(lined: DataFrame, text: str, path: str, take: int = 0, stop: Iterable[str] = (), squeeze: bool = True, most_entries: int = 0, most_ignored: int = MOST_IGNORED) -> DataFrame:
    """The same ranking without an index, from (key, line, text): all lines are tokenised once (twice if there are stop tokens to find).

    The pass runs at once: it writes the lines that have a token of the query to ``path`` and counts, on the way, all postings and
    each token's.
    """
    query, wanted = _query(text, stop, squeeze)
    spark = lined.sparkSession
    if not wanted:
        return _nothing(spark, lined.schema["key"].dataType)
    every = list(dict.fromkeys(query))
    split = spread(lined).select("key", "line", X.tokens(F.col("text"), squeeze).alias("tokens"))
    placed = split.select("key", "line", F.size(F.array_distinct("tokens")).alias("n"), *[F.coalesce(F.array_position("tokens", F.lit(t)), F.lit(0)).cast("int").alias(f"p{k}") for k, t in enumerate(every)])
    seen = Observation()
    counted = placed.observe(seen, F.sum("n").alias("n"), *[F.count_if(F.col(f"p{k}") > 0).alias(f"d{k}") for k in range(len(every))])
    some = reduce(lambda a, b: a | b, [F.col(f"p{k}") > 0 for k in range(len(every))])
    counted.filter(some).drop("n").write.parquet(path)
    stats = seen.get
    df = {t: stats[f"d{k}"] or 0 for k, t in enumerate(every)}
    hits = spark.read.schema(placed.drop("n").schema).parquet(path)
    total = stats["n"] or 0
    if most_entries and total > most_entries:
        dropped, total = stop_tokens(frequencies(split.select(F.explode(F.array_distinct("tokens")).alias("token"))), total, most_entries, most_ignored)
        wanted = [t for t in wanted if t not in dropped]
    return _rank(hits, query, wanted, df, total, take)
