"""Shared plumbing of the training-data operators.

* ``shared_dir`` / ``save``: cut lineage through a Parquet table in the folder named by ``spark.checkpoint.dir``, which every
  executor reaches, so a lost executor costs a re-read and never a failed job.
* ``map_batches``: Arrow batches in and out of a Python kernel, column-pruned by the caller.
* ``join_keyed``: equi-join against a table with one row per key, where a key may hold a third of all rows. At most ``HOT_KEYS``
  keys can each hold more than 1/HOT_KEYS of the rows, so their side of the join is broadcast with a bound known in advance and
  everything else is a plain shuffle join of harmless groups.
* byte-level helpers that keep word work inside numpy.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: No more than this many keys can each hold more than 1/HOT_KEYS of a table's rows.
HOT_KEYS = 200
#: Bytes of text that one numpy step handles at most; a longer single text makes a step of its own, which goes on in slices.
STEP_BYTES = 1 << 20

#: Bytes of a letter run that count as one word.
LONGEST_WORD = 1024

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one is set only for a local master that has none."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(cleanup)
    _written.append((spark, path))
    return path


def cleanup() -> None:
    """Delete every scratch table of this driver. Results that still read one must have been consumed."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may be gone already when the interpreter ends
            return


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Before a Python kernel is planned. Texts are long: 1000 of them make an Arrow batch, unless the session asks for another number
    than Spark's default. Workers that would not find this package get it."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` with a per-task ``setup`` value handed to the kernel as second argument."""

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows:
                yield from (kernel(batch, state) if setup else kernel(batch))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def join_keyed(left: DataFrame, right: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Join ``left`` with ``right`` (one row per ``key``), sending rows of hot keys past the shuffle.

    ``counts`` (key, n) and ``total`` spare a pass when the caller has them. Keys with more than total/HOT_KEYS rows are at most
    HOT_KEYS in number, which bounds the broadcast. A null key matches a null key.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = left.count() if total is None else total
    hot = [r[0] for r in counts.filter(F.col("n") > max(1000, total // HOT_KEYS)).select(key).limit(HOT_KEYS).collect()]
    other = [c for c in right.columns if c != key]
    renamed = right.withColumnRenamed(key, "__key")

    def on(part: DataFrame, side: DataFrame) -> DataFrame:
        return part.join(side, part[key].eqNullSafe(side["__key"]), how).select(*[part[c] for c in part.columns], *[side[c] for c in other])

    if not hot:
        return on(left, renamed)
    plain = [v for v in hot if v is not None]
    is_hot = F.coalesce(F.col(key).isin(plain), F.lit(False)) | (F.col(key).isNull() if None in hot else F.lit(False))
    hot_side = F.coalesce(F.col("__key").isin(plain), F.lit(False)) | (F.col("__key").isNull() if None in hot else F.lit(False))
    return on(left.filter(~is_hot), renamed.filter(~hot_side)).unionByName(on(left.filter(is_hot), F.broadcast(renamed.filter(hot_side))))


#: Two 64-bit hashes of a row's columns.
MARKS = ("mark1", "mark2")


def marked(df: DataFrame, *names: str) -> DataFrame:
    """(row, MARKS, ``names``): ``row`` holds all columns of ``df``, so no name can clash (``select("row.*")`` gives them back); the
    marks tell rows apart by the contents of all columns that Spark can hash (maps and variants are left out)."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    # A null doesn't change the running hash, so the places of nulls are hashed too.
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in plain])
    return df.select(F.struct("*").alias("row"), F.xxhash64(nulls, *plain).alias(MARKS[0]), F.xxhash64(F.lit("second"), nulls, *plain).alias(MARKS[1]), *names)


def split_repeats(rows: DataFrame, again: DataFrame, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose marks are not in ``again`` (distinct MARKS), and one row for each mark that is (None if ``again`` is empty)."""
    n = again.count()
    if not n:
        return rows, None
    again = F.broadcast(again) if n <= broadcast_rows else again
    return rows.join(again, list(MARKS), "left_anti"), rows.join(again, list(MARKS), "left_semi").dropDuplicates(list(MARKS))


# ---------------------------------------------------------------- bytes

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[0x80:] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:
    have = cache.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = np.uint64(pow(base, filled, 1 << 64))
                out[filled : 2 * filled] = out[:filled] * step
                filled *= 2
        have = cache[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that low bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of arbitrary spans of a byte buffer in constant time each."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inverse = _powers(_P_INV, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_P, n + 1)[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.inverse[start]


def hash_text(word: bytes) -> int:
    """What Rolling.spans gives for a span with these bytes."""
    return sum((b + 1) * pow(_P, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, nulls as empty strings, without copying the text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a row boundary."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(mask[:-1], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(mask[1:], out=after[:-1])
    cut = offs[1:-1]
    before[cut[cut < n]] = True
    after[cut[cut > 0] - 1] = True
    return np.flatnonzero(mask & before), np.flatnonzero(mask & after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~_WS[buf], offs)


def letters(buf: np.ndarray, offs: np.ndarray, last: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and Latin-1 capitals) and the spans of words: letter runs, cut every LONGEST_WORD bytes; every byte from
    0x80 counts as a letter. ``last``: the byte before, of a slice of a text."""
    low = _LOWER[buf]
    if last == 0xC3 and len(buf) and 0x80 <= buf[0] <= 0x9E and buf[0] != 0x97:
        low[0] += 32
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][capital] += 32
    start, end = runs(_ALPHA[buf], offs)
    if (end - start > LONGEST_WORD).any():
        parts = -(-(end - start) // LONGEST_WORD)
        begin = np.repeat(start, parts) + LONGEST_WORD * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        start, end = begin, np.minimum(begin + LONGEST_WORD, np.repeat(end, parts))
    return low, start, end


def letter_slices(buf: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of one text, of at most ``step`` bytes (a multiple of LONGEST_WORD), that cut no word of ``letters``."""
    at = 0
    while at < len(buf):
        stop = min(len(buf), at + step)
        if stop < len(buf):
            other = np.flatnonzero(~_ALPHA[buf[at:stop]])
            stop = at + int(other[-1]) + 1 if len(other) else stop
        yield at, stop
        at = stop


def row_of(offs: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, start, "right") - 1


def crc_mod(column: str, m: int):
    """crc32 of the id's decimal text, modulo ``m``; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m)), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 0, label: str | None = None) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of ``key``: the same rows at each run, whatever the partitioning.

    A first pass counts the keys (no other column is read); the second lets about twice ``rows`` rows through by their hash, so that
    the final cut has little to sort at any size of the table. Rows without a key are not chosen. With ``label`` every label gets the
    same number of rows as far as it has them, by turns in the order, so rare labels are there at any size of the table.
    """
    df = df.filter(F.col(key).isNotNull())
    h = F.xxhash64(F.lit(seed), F.col(key))
    if label is None:
        share = min(1.0, 2 * rows / max(1, df.select(key).count()))
        if share < 1:
            df = df.filter(h < F.lit(int(-(2**63) + share * 2**64)))
        return df.orderBy(h, F.col(key)).limit(rows)
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    counts = save(counts, "label-counts")
    labels = counts.count()
    quota = max(1, rows // max(1, labels))
    counts = F.broadcast(counts) if labels <= 10_000 else counts
    near = df.join(counts, F.col(label) == F.col("__label"))
    near = near.filter(h / F.lit(2.0**64) + 0.5 < 2.0 * quota / F.col("__n") + F.lit(8.0) / F.col("__n"))
    turn = F.row_number().over(Window.partitionBy("__label").orderBy(h, F.col(key)))
    return near.withColumn("__turn", turn).filter(F.col("__turn") <= quota).orderBy("__turn", "__label").limit(rows).select(*df.columns)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the spans (starts[k], lengths[k])."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.ones(total, np.int64)
    used = lengths > 0
    s, n, e = starts[used], lengths[used], ends[used]
    if len(s):
        out[0] = s[0]
        out[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the spans' contents, one span of each content, and for every span the place of its content among them.

    64-bit hashes stand for the contents; that two of a task's contents share one is less likely than 1 in 10 million.
    """
    return np.unique(mix(Rolling(buf).spans(start, end)) ^ (end - start).astype(np.uint64), return_index=True, return_inverse=True)


class Memo:
    """Rows by 64-bit hash, kept over a worker's steps; forgets all when full."""

    def __init__(self, width: int, most: int = 400_000, dtype=np.int64):
        self.most, self.width, self.dtype = most, width, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, self.width), self.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and rows for all keys (zeros for unknown ones)."""
        out = np.zeros((len(keys), self.width), self.dtype)
        if not len(self.keys):
            return np.zeros(len(keys), bool), out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        out[known] = self.rows[at[known]]
        return known, out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Sorted new keys with their rows."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows, axis=0)

    @property
    def full(self) -> bool:
        return len(self.keys) > self.most


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of the spans, one after the other."""
    return buf[ragged(start, end - start)].tobytes()
