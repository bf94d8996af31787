"""Postings packed into lists, the form in which an index is stored.

A kernel on Arrow batches splits and normalises many lines at once, as arrays of code points: no work per character or token in Python
but one dictionary lookup a token. The tables it looks characters up in are asked of the JVM, so its tokens are those of
``functions.text.tokens``. A task's postings are sorted by token in runs, which bounds its memory; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..shipping import ship

#: Characters that are split at once (a longer text is one piece), postings of a run, of a list and of a batch.
PIECE, RUN, LIST, BATCH = 1 << 20, 4_000_000, 1 << 16, 1 << 18
_SPACE, _UPPER, _LOW, _DIGIT, _SYMBOL, _MARK = 0, 1, 2, 3, 4, 8
_SIGMA = 0x3A3
_CODES = 0x110000
#: Code points outside are unassigned or private: symbols without case.
_ASSIGNED = [(0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000)]
_known: dict[str, bytes] = {}


class Characters:
    """For each code point its class (and ``_MARK`` if it is dropped from tokens), and what normalisation makes of it."""

    def __init__(self, kind: np.ndarray, low: np.ndarray):
        self.kind, self.low = kind, low
        self._plain = str.maketrans(X._MARKED, X._PLAIN)

    @staticmethod
    def ask(spark: SparkSession) -> bytes:
        """From the JVM's own classes and cases, packed for ``load``. Once per application."""
        asked = spark.sparkContext.applicationId
        if asked not in _known:
            _known[asked] = Characters._ask(spark)
        return _known[asked]

    @staticmethod
    def _ask(spark: SparkSession) -> bytes:
        blocks = [" ".join(map(chr, range(a, min(a + 4096, stop)))) for start, stop in _ASSIGNED for a in range(start, stop, 4096)]
        only = lambda c: F.regexp_replace("s", f"[^{c}]", "")
        of = {_UPPER: r"\p{Lu}", _LOW: r"\p{Ll}\p{Lt}\p{Lm}\p{Lo}", _DIGIT: r"\p{Nd}", _SPACE: r"\s\p{Z}", _MARK: r"\p{Mn}"}
        found = spark.createDataFrame(pa.table({"s": blocks})).select("s", F.lower(F.translate("s", X._MARKED, X._PLAIN)).alias("low"), *[only(c).alias(f"k{k}") for k, c in of.items()]).collect()
        kind, low = np.full(_CODES, _SYMBOL, np.uint8), np.arange(_CODES, dtype=np.uint32)
        codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
        for r in found:
            low[codes(r["s"])[::2]] = codes(r["low"])[::2]
            for k in (_UPPER, _LOW, _DIGIT, _SPACE):
                kind[codes(r[f"k{k}"])] = k
        for r in found:
            kind[codes(r[f"k{_MARK}"])] |= _MARK
        return zlib.compress(kind.tobytes() + low.tobytes())

    @staticmethod
    def load(packed: bytes) -> Characters:
        raw = zlib.decompress(packed)
        return Characters(np.frombuffer(raw, np.uint8, _CODES), np.frombuffer(raw, np.uint32, _CODES, _CODES))

    def split(self, texts: list[str], squeeze: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The normalised tokens of all texts in order, the text that each is from, and its place there."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[codes] & 7
        inside = kind != _SPACE
        begin = inside.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) & ((kind[:-1] != _UPPER) | (kind[1:] != _LOW))
        first = np.flatnonzero(begin)
        if not len(first):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        token = np.cumsum(begin, dtype=np.int32) - 1
        low = self.low[codes]
        self._sigmas(joined, codes, inside, first, token, low)
        keep = inside & (self.kind[low] < _MARK)
        low, token = low[keep], token[keep]
        if squeeze:
            keep = np.ones(len(low), bool)
            keep[1:] = (low[1:] != low[:-1]) | (token[1:] != token[:-1])
            low, token = low[keep], token[keep]
        out = np.full(len(low) + len(first) - 1, ord(" "), np.uint32)
        out[np.arange(len(low)) + token] = low
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        text = np.searchsorted(starts, first, side="right") - 1
        return out.tobytes().decode("utf-32-le").split(" "), text, np.arange(len(first)) - np.searchsorted(text, text)

    def _sigmas(self, joined: str, codes: np.ndarray, inside: np.ndarray, first: np.ndarray, token: np.ndarray, low: np.ndarray) -> None:
        """The one letter whose small form depends on its neighbours."""
        for k in np.unique(token[codes == _SIGMA]):
            start, stop = first[k], first[k + 1] if k + 1 < len(first) else len(codes)
            stop = start + np.count_nonzero(inside[start:stop])
            small = joined[start:stop].translate(self._plain).lower()
            for i in np.flatnonzero(codes[start:stop] == _SIGMA):
                low[start + i] = ord(small[i])


def schema(key: T.DataType) -> T.StructType:
    """A token's postings of one run, or a piece of them; ``n`` of them."""
    lists = [T.StructField("key", T.ArrayType(key)), T.StructField("line", T.ArrayType(T.IntegerType())), T.StructField("position", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.IntegerType()), *lists])


def pack(lined: DataFrame, squeeze: bool = True, sizes: tuple[int, int, int, int] = (PIECE, RUN, LIST, BATCH)) -> DataFrame:
    """The postings of (key, line, text) in lists, sorted by token in runs. ``sizes`` bound the memory of a task, not what is found."""
    spark = lined.sparkSession
    ship(spark)
    return lined.select("key", "line", "text").mapInArrow(_packer(Characters.ask(spark), squeeze, *sizes), schema(lined.schema["key"].dataType))


def unpack(packed: DataFrame) -> DataFrame:
    """(token, key, line, position): the postings of the lists."""
    listed = packed.select("token", F.explode(F.arrays_zip("key", "line", "position")).alias("p"))
    return listed.select("token", "p.key", "p.line", "p.position")


def _packer(packed: bytes, squeeze: bool, piece: int, most: int, listed: int, batch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, run = Characters.load(packed), _Run()
        for b in batches:
            texts = _strings(b.column("text"))
            sizes = np.cumsum([len(t) for t in texts]) // piece
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            for start, stop in pairwise(cuts):
                run.add(b.slice(start, stop - start), *characters.split(texts[start:stop], squeeze))
                if run.size >= most:
                    yield from run.sorted(listed, batch)
                    run = _Run()
        yield from run.sorted(listed, batch)

    return kernel


def _strings(column: pa.Array) -> list[str]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


class _Run:
    """Postings until they are sorted by token: numbers of tokens and lines, and what these stand for."""

    def __init__(self):
        self.size, self._lines, self._parts, self._keys = 0, 0, [], []
        self._tokens: defaultdict[str, int] = defaultdict()
        self._tokens.default_factory = self._tokens.__len__

    def add(self, b: pa.RecordBatch, tokens: list[str], text: np.ndarray, place: np.ndarray) -> None:
        """The first place of each token in each line of the batch."""
        if not tokens:
            return
        numbers = np.fromiter(map(self._tokens.__getitem__, tokens), np.int64, len(tokens))
        order = np.sort(numbers << 32 | np.arange(len(tokens)))
        number, at = order >> 32, order & 0xFFFFFFFF
        text, place = text[at], place[at]
        new = np.ones(len(at), bool)
        new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
        self._parts.append((number[new].astype(np.int32), (text[new] + self._lines).astype(np.int32), place[new].astype(np.int32)))
        self._keys.append((b.column("key"), b.column("line")))
        self._lines += b.num_rows
        self.size += int(np.count_nonzero(new))

    def sorted(self, listed: int, batch: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        tokens = list(self._tokens)
        by_name = sorted(range(len(tokens)), key=tokens.__getitem__)
        rank = np.empty(len(tokens), np.int64)
        rank[by_name] = np.arange(len(tokens))
        number, line, place = (np.concatenate(x) for x in zip(*self._parts))
        order = np.sort(rank[number] << 32 | np.arange(self.size))
        number, at = order >> 32, order & 0xFFFFFFFF
        line, place = line[at], place[at]
        keys, lines = (pa.concat_arrays(x) for x in zip(*self._keys))
        # Lists end where the token changes, and every ``listed`` postings.
        first = np.flatnonzero(np.diff(number, prepend=-1))
        bounds = np.concatenate([np.arange(a, b, listed) for a, b in pairwise([*first.tolist(), self.size])] + [[self.size]])
        names = pa.array([tokens[k] for k in by_name])
        # Batches end with the list that reaches ``batch`` postings.
        ends = np.flatnonzero(np.diff(bounds[1:] // batch)) + 1
        for a, b in pairwise(dict.fromkeys([0, *ends.tolist(), len(bounds) - 1])):
            low, high = bounds[a], bounds[b]
            offsets = pa.array((bounds[a : b + 1] - low).astype(np.int32))
            taken = pa.array(line[low:high])
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (keys.take(taken), lines.take(taken), pa.array(place[low:high]))]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number[bounds[a:b]])), pa.array(np.diff(bounds[a : b + 1]).astype(np.int32)), *lists], ["token", "n", "key", "line", "position"])
