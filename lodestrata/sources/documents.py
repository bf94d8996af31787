"""JSON in and out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CollectionSchema


def from_text(documents: DataFrame, column: str, schema: CollectionSchema) -> DataFrame:
    """Documents held as JSON text in a column; absent fields are null, a missing key is 0."""
    struct = schema.struct()
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in struct])
    parsed = documents.select(F.from_json(F.col(column), loose).alias("d")).select("d.*")
    return _key_or_zero(parsed, schema)


def _key_or_zero(df: DataFrame, schema: CollectionSchema) -> DataFrame:
    kind = schema.fields[0].type
    zero = F.lit("0") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else None
    return df if zero is None else df.withColumn(schema.key, F.coalesce(F.col(schema.key), zero))


def from_strings(spark: SparkSession, documents: Iterable[str], schema: CollectionSchema) -> DataFrame:
    return from_text(spark.createDataFrame([(d,) for d in documents], "j string"), "j", schema)


def read_file(spark: SparkSession, path: str, schema: CollectionSchema, array: bool = True) -> DataFrame:
    """A file with one JSON array, or (``array`` false) one document a line, which Spark can split."""
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema.struct()])
    return _key_or_zero(spark.read.json(path, schema=loose, multiLine=array), schema)


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as a document, nulls and collections included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def stream(df: DataFrame) -> Iterator[str]:
    """A JSON array piece by piece; one partition at a time is on the driver."""
    yield "["
    first = True
    for r in as_json(df).toLocalIterator():
        yield ("" if first else ",") + r[0]
        first = False
    yield "]"


def write_array(df: DataFrame, path: str) -> int:
    """One JSON array, written row by row: in a file of the driver, or, if ``path`` has a scheme, on that file system; returns the
    number of rows."""
    n = 0
    with _target(df.sparkSession, path) as out:
        out(b"[")
        for r in as_json(df).toLocalIterator():
            out(((",\n" if n else "\n") + r[0]).encode())
            n += 1
        out(b"\n]\n")
    return n


@contextmanager
def _target(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """A function that writes bytes to ``path``."""
    if ":/" not in path:
        with open(path, "wb") as file:
            yield file.write
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    held = bytearray()

    def write(data: bytes) -> None:
        held.extend(data)
        if len(held) > 1 << 20:
            stream.write(held)
            held.clear()

    try:
        yield write
        stream.write(held)
    finally:
        stream.close()


def loads(text: str) -> list[dict]:
    data = json.loads(text)
    return data if isinstance(data, list) else [data]
