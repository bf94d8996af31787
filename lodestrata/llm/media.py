"""Media columns: byte payloads as greyscale images.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become a 64-pixel-wide 8-bit image. It is stored as binary
Netpbm (P5) or, from BMP_ROWS rows on, as BMP, and decoded back to a numpy array. The array is written as NPY tiles, each with the
difference hash of its own area resize, and area-resized by an integral image to a small NPY tile and to the cells of the image's
hash. All of it is one narrow pass: no shuffle, nothing kept between rows. Of an integral image only the rows at cell edges are
kept where the image is tall, so memory stays within a few times a text's size.

Defined results: null text is the empty text (one row of zeros); equal texts give equal values; repeated rows stay repeated;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, utf8

WIDTH = 64
#: Images of so many rows or more are stored as BMP, if the form is left open.
BMP_ROWS = 64
#: Rows of an image that are summed at once.
BAND = 1 << 14


def payload(text: bytes) -> bytes:
    """Pad to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def encode_pgm(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def decode_netpbm(blob: bytes) -> np.ndarray:
    """P5 or P6, maxval below 256, comments allowed; (height, width) or (height, width, 3)."""
    at, fields = 2, []
    if blob[:2] not in (b"P5", b"P6"):
        raise ValueError("neither P5 nor P6")
    while len(fields) < 3:
        while blob[at : at + 1].isspace():
            at += 1
        if blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at) + 1
            continue
        end = at
        while blob[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(blob[at:end]))
        at = end
    width, height, top = fields
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples")
    depth = 3 if blob[:2] == b"P6" else 1
    pixels = np.frombuffer(blob, np.uint8, width * height * depth, at + 1)
    return pixels.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit greyscale, bottom row first, rows padded to four bytes."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    at = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_bmp(blob: bytes) -> np.ndarray:
    """Uncompressed 8-bit (through its palette) or 24-bit; greyscale palettes give (height, width), else (height, width, 3)."""
    if blob[:2] != b"BM":
        raise ValueError("not a BMP")
    at, = struct.unpack_from("<I", blob, 10)
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", blob, 14)
    if packing or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(blob, np.uint8, abs(height) * stride, at).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
    used = struct.unpack_from("<I", blob, 46)[0] or 256
    palette = np.frombuffer(blob, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
    shown = palette[rows[:, :width]]
    return shown[:, :, 0] if (palette[:, :1] == palette).all() else shown


class Integral:
    """The integral image of (..., height, width) arrays, by rows: all of them, or for tall images those that are asked for."""

    def __init__(self, image: np.ndarray):
        self.image, (self.height, self.width) = image, image.shape[-2:]
        self.whole = self._wide(np.cumsum(image, -2, dtype=np.int64)) if self.height <= BAND or image.ndim > 2 else None

    @staticmethod
    def _wide(columns: np.ndarray) -> np.ndarray:
        """Sums over all columns to the left, from sums over all rows above, with an empty row and column first."""
        total = np.zeros((*columns.shape[:-2], columns.shape[-2] + 1, columns.shape[-1] + 1))
        np.cumsum(columns, -1, out=total[..., 1:, 1:])
        return total

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The sums above the rows ``at`` (ascending)."""
        if self.whole is not None:
            return self.whole[..., at, :]
        out, base = np.zeros((len(at), self.width), np.int64), np.zeros(self.width, np.int64)
        for low in range(0, self.height, BAND):
            sums = np.cumsum(self.image[low : low + BAND], 0, dtype=np.int64)
            mine = np.flatnonzero((at > low) & (at <= low + len(sums)))
            out[mine] = base + sums[at[mine] - low - 1]
            base = base + sums[-1]
        return self._wide(out)[1:]

    def resize(self, height: int, width: int) -> np.ndarray:
        """Mean over each target cell's exact area, fractions included. Float64."""

        def edges(axis_len: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
            edge = np.arange(cells + 1) * (axis_len / cells)
            low = np.minimum(edge.astype(np.int64), axis_len - 1)
            return low, edge - low

        y, fy = edges(self.height, height)
        x, fx = edges(self.width, width)
        rows = self.rows(y) * (1 - fy)[:, None] + self.rows(y + 1) * fy[:, None]
        grid = rows[..., x] * (1 - fx) + rows[..., x + 1] * fx
        cells = grid[..., 1:, 1:] - grid[..., :-1, 1:] - grid[..., 1:, :-1] + grid[..., :-1, :-1]
        return cells / ((self.height / height) * (self.width / width))

    def hashes(self) -> np.ndarray:
        """(..., 8) bytes: is a cell brighter than its left neighbour, in an 8 x 9 area resize (to 1e-9)."""
        small = np.round(self.resize(8, 9), 9)
        return np.packbits((small[..., 1:] > small[..., :-1]).reshape(*small.shape[:-2], 64), axis=-1)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return Integral(image).resize(height, width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits."""
    return Integral(image).hashes().tobytes().hex()


@lru_cache(4096)
def _header(shape: tuple[int, ...], kind: str) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
    return out.getvalue()


def to_npy(array: np.ndarray) -> bytes:
    """An NPY file (version 1.0), as np.save writes it."""
    return _header(array.shape, array.dtype.str) + np.ascontiguousarray(array).tobytes()


@lru_cache(4096)
def _shape(header: bytes) -> tuple[tuple[int, ...], np.dtype]:
    stream = io.BytesIO(header)
    np.lib.format.read_magic(stream)
    shape, order, kind = np.lib.format.read_array_header_1_0(stream)
    if order or kind.hasobject:
        raise ValueError("only plain arrays in C order")
    return shape, kind


def from_npy(blob: bytes | memoryview) -> np.ndarray:
    """The array of an NPY file (version 1.0)."""
    at = 10 + int.from_bytes(bytes(blob[8:10]), "little")
    shape, kind = _shape(bytes(blob[:at]))
    return np.frombuffer(blob, kind, offset=at).reshape(shape)


def npy_tiles(image: np.ndarray, side: int = 64) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) of each tile; edge tiles are smaller."""
    for r in range(0, image.shape[0], side):
        for c in range(0, image.shape[1], side):
            yield r // side, c // side, to_npy(image[r : r + side, c : c + side])


def tile_hashes(image: np.ndarray, whole: Integral, side: int = 64) -> list[str]:
    """The difference hash of each of ``npy_tiles``, in its order."""
    height, width = image.shape
    if height <= side and width <= side:
        return [whole.hashes().tobytes().hex()]
    if width != side:
        return [difference_hash(image[r : r + side, c : c + side]) for r in range(0, height, side) for c in range(0, width, side)]
    full, found = height // side, []
    for k in range(0, full, 256):  # whole tiles of a column, many at a time
        found += [x.tobytes().hex() for x in Integral(image[k * side : min(full, k + 256) * side].reshape(-1, side, side)).hashes()]
    return found + ([difference_hash(image[full * side :])] if height % side else [])


def read_tiles(tiles: list[tuple[int, int, bytes | memoryview]]) -> np.ndarray:
    """The image again."""
    rows: dict[int, list] = {}
    for r, _, blob in sorted(tiles, key=lambda x: x[:2]):
        rows.setdefault(r, []).append(from_npy(blob))
    return np.concatenate([np.concatenate(rows[r], 1) for r in sorted(rows)], 0)


_TILES = "array<struct<row:int,col:int,npy:binary,hash:string>>"


def media_columns(docs: DataFrame, form: str = "auto", thumb: int = 16, then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, form, media, feature, thumb, tiles) of ``docs``' doc_id and text.

    ``media`` is the stored form ("pgm" or "bmp"; "auto": by the image's height); ``feature`` the difference hash of the decoded
    image; ``thumb`` a thumb x thumb NPY tile of its area resize; ``tiles`` the whole image as NPY tiles with a difference hash each.
    ``then`` (a function of the output batches and its schema) goes on in the same worker.
    """
    if form not in ("auto", "pgm", "bmp"):
        raise ValueError("form: auto, pgm or bmp")

    def row(raw: bytes) -> tuple:
        data = payload(raw)
        if form == "bmp" or form == "auto" and len(data) >= BMP_ROWS * WIDTH:
            kind, blob = "bmp", encode_bmp(np.frombuffer(data, np.uint8).reshape(-1, WIDTH))
        else:
            kind, blob = "pgm", encode_pgm(data)
        image = decode_bmp(blob) if kind == "bmp" else decode_netpbm(blob)
        whole = Integral(image)
        hashes = tile_hashes(image, whole)
        feature = hashes[0] if len(hashes) == 1 else whole.hashes().tobytes().hex()
        return len(raw), kind, blob, feature, to_npy(np.round(whole.resize(thumb, thumb), 6).astype(np.float32)), list(npy_tiles(image)), hashes

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, offs = utf8(batch.column(1))
        at, gathered, held = 0, [], 0
        for k in range(batch.num_rows):
            gathered.append(row(buf[offs[k] : offs[k + 1]].tobytes()))
            held += 2 * len(gathered[-1][2])
            if held > 4 << 20 or k == batch.num_rows - 1:
                n, kinds, blobs, features, thumbs, tiles, hashes = zip(*gathered)
                flat = [t for x in tiles for t in x]
                parts = [pa.array([t[0] for t in flat], pa.int32()), pa.array([t[1] for t in flat], pa.int32()), pa.array([t[2] for t in flat], pa.binary()), pa.array([h for x in hashes for h in x], pa.string())]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in tiles])]), pa.int32())
                listed = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(parts, ["row", "col", "npy", "hash"]))
                columns = [batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(kinds), pa.array(blobs, pa.binary()), pa.array(features), pa.array(thumbs, pa.binary()), listed]
                out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "form", "media", "feature", "thumb", "tiles"])
                at, gathered, held = k + 1, [], 0
                yield then[0](out) if then else out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"n_bytes long, form string, media binary, feature string, thumb binary, tiles {_TILES}"
    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text")), kernel, f"doc_id {kind}, {then[1] if then else schema}")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, form string, n_tiles long, tiles_sha256 string, thumb_sha256 string"


def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What reading the stored bytes of a batch of ``media_columns`` back gives: the payload's size and digests, those of the stored
    form, of all NPY tiles with their hashes, and of the small tile. Tiles that don't make up the decoded image are an error."""
    tiles, rows = batch.column("tiles"), []
    parts, bounds = tiles.flatten(), tiles.offsets.to_numpy() - tiles.offsets[0].as_py()
    places = [parts.field(k).to_pylist() for k in (0, 1, 3)]
    files = parts.field(2)
    for k, (cell, small) in enumerate(zip(batch.column("media"), batch.column("thumb"))):
        blob = cell.as_buffer()
        image = decode_netpbm(blob.to_pybytes()) if blob[0] == 80 else decode_bmp(blob.to_pybytes())
        data, state = np.ascontiguousarray(image), hashlib.sha256()
        mine = [(places[0][t], places[1][t], memoryview(files[t].as_buffer())) for t in range(bounds[k], bounds[k + 1])]
        if not np.array_equal(read_tiles(mine), image):
            raise ValueError("the tiles differ from the image")
        for t, (_, _, file) in zip(range(bounds[k], bounds[k + 1]), mine):
            state.update(file)
            state.update(places[2][t].encode())
        rows.append((data.size, hashlib.sha256(data).hexdigest(), zlib.crc32(data.reshape(-1)[-WIDTH:].tobytes()), len(blob), hashlib.sha256(blob).hexdigest(), len(mine), state.hexdigest(), hashlib.sha256(small.as_buffer()).hexdigest()))
    size, sha, crc, n, stored, count, cut, small = zip(*rows)
    long = lambda x: pa.array(x, pa.int64())
    columns = [batch.column("doc_id"), batch.column("n_bytes"), long(size), pa.array(sha), long(crc), long(n), pa.array(stored), batch.column("feature"), batch.column("form"), long(count), pa.array(cut), pa.array(small)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *[x.split()[0] for x in DIGESTS.split(", ")]])


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), then=(digest, DIGESTS))
