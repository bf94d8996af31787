"""SentencePiece encoding and decoding with byte spans in the original text.

Normalisation is done here as the model's file prescribes: at each position the longest prefix known to the compiled character map
(a double-array trie) is replaced, and every normalised byte remembers where in the source it came from. The library segments the
text; the pieces' lengths, laid over that alignment, give each piece's span of source bytes.

With an identity map and a BPE vocabulary in which no piece has a space mark behind another character, no merge crosses the border
between a non-space and a space. Texts are then spliced there: each distinct piece is encoded once per task (a bounded memo), many
of them joined by single spaces, and each id belongs to the piece in which its bytes end. ``Codec`` checks that premise from the
model file and otherwise hands whole texts to the library.

Decoding is the library's ``decode`` of the ids. Rows that repeat the row before them (as mixing puts them out) are coded once.
A text of more than ``STEP_BYTES`` is coded in slices that begin at such a border and decoded in slices that begin at a piece with a
space mark, so beside its own ids, spans and text memory doesn't grow with it (in spliced mode, without a written space mark in it;
otherwise the library gets the whole text).

Defined results: null is the empty text (no ids); repeated rows stay; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, Memo, distinct_spans, map_batches, ragged, row_of, steps, table, utf8

_MARK = "▁"
_MARK_BYTES = _MARK.encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """A compiled character map: little-endian trie size, double-array units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of text[at:]."""
        if not len(self.units):
            return None
        units, found = self.units, None
        node = self._offset(int(units[0]))
        for k in range(at, len(text)):
            byte = text[k]
            node ^= byte
            unit = int(units[node]) if node < len(units) else 0
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                found = value, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Normalizer:
    """Normalised bytes and, for each of them and the end, the source offset it came from."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = not len(self.map.units) and not self.trim and self.escape

    def _char(self, text: bytes, at: int) -> tuple[bytes, int]:
        hit = self.map.longest(text, at)
        if hit:
            return hit
        lead = text[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + n], n

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, where = bytearray(), []
        space = _MARK_BYTES if self.escape else b" "

        def put(data: bytes, source: int) -> None:
            out.extend(data)
            where.extend([source] * len(data))

        at = 0
        if self.trim:
            while at < len(text):
                rep, n = self._char(text, at)
                if rep != b" ":
                    break
                at += n
        if at >= len(text):
            return b"", np.array([len(text)])
        if self.dummy:
            put(space, at)
        after_space = self.trim
        while at < len(text):
            rep, n = self._char(text, at)
            if self.trim and after_space:
                rep = rep.lstrip(b" ")
            for k in range(len(rep)):
                put(space if rep[k] == 32 else rep[k : k + 1], at)
            if rep:
                after_space = rep.endswith(b" ")
            at += n
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                at = where[-len(space)]
                del where[-len(space) :]
        return bytes(out), np.array([*where, at], np.int64)


class Codec:
    """Ids, spans and decoded texts of whole texts, exactly those of the library."""

    def __init__(self, model: str):
        import sentencepiece
        import sentencepiece.sentencepiece_model_pb2 as proto

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = proto.ModelProto()
        with open(model, "rb") as file:
            spec.ParseFromString(file.read())
        self.normalize = Normalizer(spec.normalizer_spec)
        inner = any(_MARK in p.piece.lstrip(_MARK) for p in spec.pieces if p.type != 6)
        user = any(p.type == 4 for p in spec.pieces)
        self.spliced = self.normalize.identity and self.normalize.dummy and not inner and not user and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix and spec.trainer_spec.byte_fallback
        #: Bytes of source (a space mark is one byte) and of normalised text of each id.
        self.source = np.array([1 if p.type == 6 else 0 if p.type == 3 else len(p.piece.replace(_MARK, " ").encode()) for p in spec.pieces], np.int32)
        self.normal = np.array([1 if p.type == 6 else 0 if p.type == 3 else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.unknown = np.array([i for i, p in enumerate(spec.pieces) if p.type == 2], np.int32)
        self.marked = np.array([p.piece.startswith(_MARK) for p in spec.pieces])
        self.digits = [str(i) for i in range(len(spec.pieces))]
        self.memo, self.pool = Memo(2), np.zeros(0, np.int32)
        self.mark = self.lib.piece_to_id(_MARK)

    def encode(self, buf: np.ndarray, offs: np.ndarray, step: int = STEP_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per row."""
        n = len(offs) - 1
        if not self.spliced:
            found = self.lib.encode([buf[a:b].tobytes().decode() for a, b in zip(offs, offs[1:])], num_threads=1)
            return np.fromiter((i for f in found for i in f), np.int32), np.array([len(f) for f in found], np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        if n == 1 and len(buf) > step and not any(_MARK_BYTES in buf[at : at + step + 2].tobytes() for at in range(0, len(buf), step)):
            parts = [self._spliced(buf[a:b], np.array([0, b - a]), bool(a))[0] for a, b in self._slices(buf, step)]
            return np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)
        return self._spliced(buf, offs)

    @staticmethod
    def _slices(buf: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
        """Slices of about ``step`` bytes that begin where a run of spaces does; longer ones where there is none."""
        at = 0
        while at < len(buf):
            stop, low = at + step, at + 1
            while True:
                stop = min(stop, len(buf))
                if stop == len(buf):
                    break
                cuts = np.flatnonzero((buf[low:stop] == 32) & (buf[low - 1 : stop - 1] != 32))
                if len(cuts):
                    stop = low + int(cuts[-1])
                    break
                low, stop = stop, stop + step
            yield at, stop
            at = stop

    def _spliced(self, buf: np.ndarray, offs: np.ndarray, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` by pieces between spaces; ``goes_on``: the buffer begins inside a text, with a space."""
        n = len(offs) - 1
        blank = buf == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        first[heads] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(buf))
        row = row_of(offs, start)
        inside = start.copy()
        head = np.zeros(len(start), bool)
        head[np.searchsorted(start, heads)] = not goes_on
        inside[~head] += 1  # the space before a piece is the one that encoding puts there
        # Space marks written out in a text would merge with spaces: such rows go to the library whole.
        marks = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
        whole = np.unique(row_of(offs, marks))
        if len(whole):
            spliced = ~np.isin(row, whole)
            inside, end, row = inside[spliced], end[spliced], row[spliced]
        hashes, index, inverse = distinct_spans(buf, inside, end)
        if self.memo.full:
            self.memo.clear()
            self.pool = np.zeros(0, np.int32)
        known, rows = self.memo.find(hashes)
        place, size = rows[:, 0], rows[:, 1]
        s, e = inside[index], end[index]
        ends_blank = np.zeros(len(index), bool)
        ends_blank[e > s] = blank[e[e > s] - 1]
        regular = np.flatnonzero((e > s) & ~ends_blank & ~known)
        flat: list[np.ndarray] = [self.pool]
        total = len(self.pool)
        cuts = np.searchsorted(np.cumsum(e[regular] - s[regular] + 1), np.arange(1, 1 + int((e[regular] - s[regular] + 1).sum()) // 65536 + 1) * 65536)
        for part in np.split(regular, np.unique(cuts[cuts < len(regular)])):
            if not len(part):
                continue
            lengths = e[part] - s[part] + 1
            joined = np.full(int(lengths.sum()), 32, np.uint8)
            body = np.cumsum(lengths) - lengths + 1
            joined[ragged(body, lengths - 1)] = buf[ragged(s[part], lengths - 1)]
            text = joined[1:].tobytes().decode()
            ids = np.array(self.lib.encode(text), np.int32)
            owned = np.searchsorted(np.cumsum(self.source[ids]), np.concatenate([[0], np.cumsum(lengths)]), "right")
            size[part], place[part] = np.diff(owned), total + owned[:-1]
            flat.append(ids)
            total += len(ids)
        for k in np.flatnonzero(((e <= s) | ends_blank) & ~known):
            text = buf[s[k] : e[k]].tobytes().decode()
            ids = np.array(self.lib.encode(text) if text else [self.mark], np.int32)
            size[k], place[k] = len(ids), total
            flat.append(ids)
            total += len(ids)
        self.pool = np.concatenate(flat)
        self.memo.add(hashes[~known], np.stack([place, size], 1)[~known])
        per_row = np.bincount(row, size[inverse], n).astype(np.int64)
        ids = self.pool[ragged(place[inverse], size[inverse])]
        if len(whole):
            parts = np.split(ids, np.cumsum(per_row)[:-1])
            for r in whole:
                parts[r] = np.array(self.lib.encode(buf[offs[r] : offs[r + 1]].tobytes().decode()), np.int32)
                per_row[r] = len(parts[r])
            ids = np.concatenate(parts)
        return ids, per_row

    def decode(self, ids: list[np.ndarray], step: int = 1 << 20) -> list[str]:
        """The library's decode of each row's ids."""
        out = self.lib.decode([x.tolist() if len(x) <= step else [] for x in ids], num_threads=1) if ids else []
        for r, x in enumerate(ids):
            if len(x) > step:
                cuts = [0]
                while len(x) - cuts[-1] > step and len(more := np.flatnonzero(self.marked[x[cuts[-1] + step // 2 : cuts[-1] + step]])):
                    cuts.append(cuts[-1] + step // 2 + int(more[-1]))
                parts = [self.lib.decode(x[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(x)])]
                # The decoder takes the first mark for the one that encoding puts before a text.
                out[r] = (" " if self.normalize.dummy and self.normalize.escape else "").join(parts)
        return out

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes [begin, end) of each piece of one text."""
        odd = any((ids == u).any() for u in self.unknown)
        if self.normalize.identity and not odd:
            after = np.cumsum(self.source[ids], dtype=np.int32) - np.int32(1 if self.normalize.dummy and len(ids) else 0)
            if _MARK_BYTES not in text:
                return np.concatenate([[0], after[:-1]]).clip(0) if len(ids) else after, after.clip(0)
        normal, where = self.normalize(text)
        lengths = self.normal[ids].copy()
        if odd:
            surfaces = self.lib.encode(text.decode(), return_type="proto").pieces
            lengths = np.array([len(p.piece.encode()) for p in surfaces], np.int64)
        at = np.minimum(np.concatenate([[0], np.cumsum(lengths)]), len(normal))
        return where[at[:-1]], where[at[1:]]


@lru_cache(1)
def codec_of(model: str) -> Codec:
    """One per Python worker, kept between its tasks."""
    return Codec(model)


def _runs(offs: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before them."""
    size = np.diff(offs)
    first = np.ones(len(size), bool)
    for r in np.flatnonzero(size[1:] == size[:-1]) + 1:
        first[r] = not np.array_equal(buf[offs[r] : offs[r + 1]], buf[offs[r - 1] : offs[r]])
    return first


def encode(docs: DataFrame, model: str, spans: bool = True, decoded: bool = True, carry: tuple[str, ...] = (), then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """(doc_id, ids[, begins, ends][, decoded]) of each row: token ids, each piece's span of source bytes, and the ids decoded;
    ``carry`` names columns to take along. ``then`` (a function of the output batches and its schema) goes on in the same worker."""

    def coded(texts: pa.Array, codec: Codec) -> Iterator[dict[str, pa.Array]]:
        buf, offs = utf8(texts)
        for i, j in steps(offs):
            part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            ids, per_row = codec.encode(part, at)
            where = np.concatenate([[0], np.cumsum(per_row)])
            bounds = pa.array(where, pa.int32())
            out = {"ids": pa.ListArray.from_arrays(bounds, pa.array(ids))}
            if spans:
                begins, ends = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
                for r in range(j - i):
                    a, b = where[r], where[r + 1]
                    begins[a:b], ends[a:b] = codec.spans(part[at[r] : at[r + 1]].tobytes(), ids[a:b])
                out |= {"begins": pa.ListArray.from_arrays(bounds, pa.array(begins)), "ends": pa.ListArray.from_arrays(bounds, pa.array(ends))}
            if decoded:
                out["decoded"] = pa.array(codec.decode([ids[a:b] for a, b in zip(where[:-1], where[1:])]), pa.string())
            yield out

    def kernel(batch: pa.RecordBatch, codec: Codec):
        texts, at = batch.column(1).fill_null(""), 0
        buf, offs = utf8(texts)
        first = _runs(offs, buf)
        source = np.cumsum(first) - 1  # the place of each row's text among the texts that are coded
        for out in coded(texts if first.all() else texts.filter(pa.array(first)), codec):
            n = len(out["ids"])
            lo, hi = np.searchsorted(source, [at, at + n])
            if hi - lo != n:
                out = {name: column.take(pa.array(source[lo:hi] - at)) for name, column in out.items()}
            at += n
            columns = {"doc_id": batch.column(0).slice(lo, hi - lo)} | out | {f: batch.column(2 + k).slice(lo, hi - lo) for k, f in enumerate(carry)}
            whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield then[0](whole, codec) if then else whole

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", begins array<int>, ends array<int>" * spans + ", decoded string" * decoded + "".join(f", `{f}` {docs.schema[f].dataType.simpleString()}" for f in carry)
    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text"), *[docs[f].alias(f"__{f}") for f in carry]), kernel, schema if then is None else f"doc_id {kind}, {then[1]}", lambda: codec_of(model))


def digest(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
    """Digests of a batch of ``encode``, with the spans."""
    ids, decoded = batch.column("ids"), batch.column("decoded")
    where, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    shas = []
    for a, b in zip(where[:-1], where[1:]):
        state = hashlib.sha256()
        for at in range(a, b, 1 << 18):
            state.update((("," if at > a else "") + ",".join([codec.digits[i] for i in flat[at : min(b, at + (1 << 18))].tolist()])).encode())
        shas.append(state.hexdigest())
    back = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
    columns = [batch.column("doc_id"), pa.array(np.diff(where).astype(np.int64)), pa.array(shas, pa.string()), pa.array(back, pa.string()), batch.column("begins"), batch.column("ends")]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "begins", "ends"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""

    def kernel(batch: pa.RecordBatch, codec: Codec):
        texts = codec.decode([np.zeros(0, np.int32) if not x.is_valid else x.values.to_numpy() for x in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), kernel, f"doc_id {kind}, text string", lambda: codec_of(model))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model(), then=(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, begins array<int>, ends array<int>"))
