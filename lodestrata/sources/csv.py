"""CSV feeds: separator, column names, types and telling keys, from a sample of lines; the whole file then goes through Spark's reader."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.values import parse_date
from ..schema import DICTIONARY, NONE, ORDERED, PRIMARY, CollectionSchema, Field

SAMPLE = 10_000
ROW_ID = "@id"
NULL, BOOL, INT, FLOAT, DATE, TEXT = "null", "bool", "int", "float", "date", "string"
_TYPES = {NULL: T.StringType(), BOOL: T.BooleanType(), INT: T.LongType(), FLOAT: T.DoubleType(), DATE: T.TimestampType(), TEXT: T.StringType()}


def split_line(line: str, separator: str) -> list[str]:
    """Fields of a line; quotes toggle and are dropped, separators inside them are text."""
    out, now, quoted = [], [], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == separator and not quoted:
            out.append("".join(now))
            now = []
        else:
            now.append(c)
    return [*out, "".join(now)]


def detect_separator(header: str) -> str:
    """The first of comma, semicolon and tab that the header has."""
    for c in ",;\t":
        if c in header:
            return c
    raise EngineError("no separator in the header")


def column_name(raw: str) -> str:
    """Blank-separated words become one, each later word with a capital."""
    first, *rest = raw.strip().split() or [""]
    return first + "".join(w[0].upper() + w[1:] for w in rest)


def type_of(text: str, us: bool = False) -> str:
    text = text.strip()
    if not text or text.lower() == "null":
        return NULL
    if text.lower() in ("true", "false"):
        return BOOL
    try:
        int(text)
        return INT
    except ValueError:
        pass
    try:
        float(text)
        return FLOAT if text[-1].isdigit() or text[-1] == "." else TEXT
    except ValueError:
        pass
    return DATE if parse_date(text, us) else TEXT


def wider(a: str, b: str) -> str:
    """The type that holds both: null gives way, an int becomes a float, anything else that differs is text."""
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    return FLOAT if {a, b} == {INT, FLOAT} else TEXT


@dataclass
class Column_:
    name: str
    type: str = NULL
    average: float = 0.0  # sampled lines per value
    largest: int = 0


@dataclass
class CsvSchema:
    columns: list[Column_]
    separator: str = ","
    us_dates: bool = False
    discriminant: list[str] = field(default_factory=list)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, _TYPES[c.type]) for c in self.columns])

    def to_collection(self, name: str, most_indexes: int = 4) -> CollectionSchema:
        """With a generated key and an index hint on the most telling columns that aren't floats."""
        telling = sorted((c for c in self.columns if c.type != FLOAT), key=lambda c: c.average)[:most_indexes]
        hints = {c.name: ORDERED if c.type in (INT, DATE) else DICTIONARY for c in telling}
        return CollectionSchema(name, (Field(ROW_ID, T.LongType(), PRIMARY), *(Field(c.name, _TYPES[c.type], hints.get(c.name, NONE)) for c in self.columns)))

    def report(self) -> str:
        rows = [f"{c.name}: {c.type}, {c.average:.2f} lines a value, {c.largest} at most" for c in sorted(self.columns, key=lambda c: c.average)]
        return "\n".join([*rows, *([f"telling together: {' + '.join(self.discriminant)}"] if self.discriminant else [])])


def infer(spark: SparkSession, path: str, lines: int = SAMPLE, us_dates: bool = False, composite: bool = True) -> CsvSchema:
    """From the header and at most ``lines`` lines of the file, or of all files of the folder. A line with another number of columns
    is an error; lines like the header are the other files' headers."""
    text = spark.read.text(path)
    head = text.limit(1).collect()
    if not head:
        raise EngineError(f"{path} is empty")
    header = head[0][0]
    sample = [r[0] for r in text.filter(F.col("value") != header).limit(lines).collect()]
    return infer_lines([header, *sample], us_dates, composite)


def infer_lines(sample: list[str], us_dates: bool = False, composite: bool = True) -> CsvSchema:
    separator = detect_separator(sample[0])
    columns = [Column_(column_name(c)) for c in split_line(sample[0], separator)]
    rows = []
    for k, line in enumerate(sample[1:], 2):
        cells = split_line(line, separator)
        if len(cells) != len(columns):
            raise EngineError(f"line {k} has {len(cells)} columns, the header {len(columns)}")
        rows.append(cells)
        for c, cell in zip(columns, cells):
            c.type = wider(c.type, type_of(cell, us_dates))
    for k, c in enumerate(columns):
        c.average, c.largest = _lines_a_value([r[k] for r in rows])
    out = CsvSchema(columns, separator, us_dates)
    if composite and rows:
        out.discriminant = discriminant(columns, rows)
    return out


def _lines_a_value(values: list) -> tuple[float, int]:
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return (len(values) / len(counts), max(counts.values())) if counts else (0.0, 0)


def discriminant(columns: list[Column_], rows: list[list[str]]) -> list[str]:
    """The pair of columns with the smallest largest group, if no single column does as well."""
    best, pair = min(((c.largest, c.average) for c in columns), default=(0, 0.0)), []
    for a, b in combinations(range(len(columns)), 2):
        average, largest = _lines_a_value([(r[a], r[b]) for r in rows])
        if (largest, average) < best:
            best, pair = (largest, average), [columns[a].name, columns[b].name]
    return pair


def discriminant_in(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, largest, average) of each column and pair over all rows, the most telling first: one aggregation for each of them."""
    sets = [(c,) for c in columns] + list(combinations(columns, 2))
    parts = None
    for names in sets:
        part = df.groupBy(*names).count().agg(F.max("count").alias("largest"), F.avg("count").alias("average")).select(F.lit("+".join(names)).alias("columns"), "largest", "average")
        parts = part if parts is None else parts.unionByName(part)
    return parts.orderBy("largest", "average", "columns")


def _value(text: Column, kind: str, us: bool) -> Column:
    """Cast, null where it doesn't parse."""
    plain = F.trim(text)
    if kind == INT:
        return plain.try_cast("long")
    if kind == FLOAT:
        return plain.try_cast("double")
    if kind == BOOL:
        return plain.try_cast("boolean")
    if kind == DATE:
        slash = "MM/dd/yyyy" if us else "dd/MM/yyyy"
        wide = F.regexp_replace(F.regexp_replace(plain, r"^(\d)([/-])", "0$1$2"), r"([/-])(\d)([/-])", "$10$2$3")
        tries = [F.try_to_timestamp(wide, F.lit(f)) for f in (slash, slash.replace("/", "-"), f"{slash} HH:mm", f"{slash} HH:mm:ss")]
        return F.coalesce(plain.try_cast("timestamp"), *tries)
    return text


def read(spark: SparkSession, path: str, schema: CsvSchema) -> DataFrame:
    """The file's rows, typed; a missing last value and values that don't parse are null. Split by Spark like any large CSV."""
    raw = T.StructType([T.StructField(c.name, T.StringType()) for c in schema.columns])
    text = spark.read.csv(path, schema=raw, header=True, sep=schema.separator, mode="PERMISSIVE", quote='"', enforceSchema=True)
    return text.select(*[_value(F.col(f"`{c.name}`"), c.type, schema.us_dates).alias(c.name) for c in schema.columns])


def feed_frame(spark: SparkSession, path: str, schema: CsvSchema) -> DataFrame:
    """With the generated key in front; the ids are unique, not without gaps."""
    return read(spark, path, schema).select(F.monotonically_increasing_id().alias(ROW_ID), "*")


def from_lines(spark: SparkSession, lines: list[str], schema: CsvSchema) -> DataFrame:
    """The same from lines without a header."""
    width = len(schema.columns)
    cells = [(split_line(x, schema.separator) + [None])[:width] for x in lines]
    raw = spark.createDataFrame([tuple(c + [None] * (width - len(c))) for c in cells], T.StructType([T.StructField(c.name, T.StringType()) for c in schema.columns]))
    return raw.select(F.monotonically_increasing_id().alias(ROW_ID), *[_value(F.col(f"`{c.name}`"), c.type, schema.us_dates).alias(c.name) for c in schema.columns])
