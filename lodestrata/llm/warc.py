"""WARC archives: segmented records written and reassembled.

``write_archive`` turns pages into gzip members, one per record. A response's HTTP block carries the payload in chunked transfer
framing; a block longer than ``segment`` bytes is cut into a first record and continuation records. Pages whose payload another
page has already become revisit records. ``read_archive`` parses the files again: whole records directly, segments grouped by their
origin record's identifier, put in order of segment number, checked for gaps and against the total length, joined and unframed.

Files are written through pyarrow's file systems into the shared folder; every attempt of a task writes names of its own and only
the manifest, itself a table committed by Spark, says which files count. A lost executor leaves stray files, never wrong records.
Payloads are compressed before anything else happens and only the records of revisits, when they are too many to broadcast
(BROADCAST_ROWS), make the compressed records cross a shuffle, on a key that is unique per row.

Defined results: null html is the empty payload; null url leaves the header out; null page_id is a page of its own (and sorts
last); of rows with equal page_id and payload one is the response and the others revisit it; an empty table gives no files and an
empty result; other columns are ignored. A record whose segments are missing, doubled or of a wrong total length, or whose framing is
broken, has a null payload and says so in ``problem``. Bytes that are no record (a file cut short, a damaged gzip member, a wrong
Content-Length, something else than WARC) give a row with nothing but a ``problem``, which names the file, and reading goes on with
the next gzip member. Segmented records get files of their own, so that each file is read once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch, small_batches, table

CRLF = b"\r\n"
_GZIP = b"\x1f\x8b\x08"
SEGMENT = 32 << 10
CHUNK = 8 << 10
FILE_BYTES = 64 << 20
BROADCAST_ROWS = 500_000
_DATE = b"2024-01-01T00:00:00Z"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def frame(data: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(data), size):
        piece = data[at : at + size]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unframe(data: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise ValueError("broken chunk")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("broken chunk")
        at = end + 2
        if not size:
            return b"".join(parts)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        parts.append(data[at : at + size])
        at += size + 2


def record(kind: bytes, identifier: str, block: bytes, **headers: bytes | None) -> bytes:
    """One WARC record as a gzip member."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + identifier.encode() + b">", b"WARC-Date: " + _DATE]
    lines += [k.replace("_", "-").encode() + b": " + v.replace(b"\r", b"%0D").replace(b"\n", b"%0A") for k, v in headers.items() if v is not None]
    lines += [b"Content-Length: %d" % len(block), b"", b""]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(CRLF.join(lines) + block + CRLF + CRLF) + packer.flush()


def page_identifier(page_id: int | None, row: int) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{row}"


def response(identifier: str, url: bytes | None, payload: bytes, digest: str, segment: int = SEGMENT) -> tuple[bytes, int]:
    """The gzip members of a page's response record and its continuations, and how many segments they are (0: one whole record)."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    common = {"WARC_Target_URI": url, "WARC_Payload_Digest": b"sha1:" + digest.encode(), "Content_Type": b"application/http; msgtype=response"}
    if len(parts) == 1:
        return record(b"response", identifier, block, **common), 0
    out = [record(b"response", identifier, parts[0], WARC_Segment_Number=b"1", **common)]
    for k, part in enumerate(parts[1:], 2):
        total = b"%d" % len(block) if k == len(parts) else None
        out.append(record(b"continuation", f"{identifier}:{k}", part, WARC_Target_URI=url, WARC_Segment_Origin_ID=f"<{identifier}>".encode(), WARC_Segment_Number=b"%d" % k, WARC_Segment_Total_Length=total))
    return b"".join(out), len(out)


def revisit(identifier: str, url: bytes | None, size: int, digest: str, refers_to: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    return record(b"revisit", identifier, block, WARC_Target_URI=url, WARC_Payload_Digest=b"sha1:" + digest.encode(), WARC_Profile=_PROFILE, WARC_Refers_To=f"<{refers_to}>".encode(), Content_Type=b"application/http; msgtype=response")


def members(stream) -> Iterator[bytes | ValueError]:
    """The gzip members of a file object, one at a time; an error stands for bytes that are none, up to the next member."""
    unpack, parts, rest, lost = zlib.decompressobj(31), [], b"", False
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            if parts:
                yield ValueError("the archive ends inside a record")
            return
        if lost:
            at = data.find(_GZIP)
            if at < 0:
                keep = data[-2:]
                more = stream.read(1 << 20)
                rest = keep + more if more else b""
                if not more:
                    return
                continue
            data, lost = data[at:], False
        try:
            parts.append(unpack.decompress(data))
        except zlib.error as error:
            yield ValueError(f"damaged gzip member: {error}")
            rest, parts, unpack, lost = data[1:], [], zlib.decompressobj(31), True
            if not rest:
                rest = stream.read(1 << 20)
            continue
        if unpack.eof:
            yield b"".join(parts)
            rest, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "warc-type" not in headers or "warc-record-id" not in headers or not headers.get("content-length", "").isdigit():
        raise ValueError("a WARC record without type, identifier or length")
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("the block's length differs from Content-Length")
    return headers, rest[:size]


def open_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP response, unframed if chunked."""
    head, _, body = block.partition(CRLF + CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, unframe(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_archive(pages: DataFrame, segment: int = SEGMENT, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns the manifest (path, bytes, records)."""
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.monotonically_increasing_id().alias("row"))

    def pack(batches):
        for batch in batches:
            ids, urls, texts, rows = (batch.column(k) for k in range(4))
            at, held, out = 0, 0, []
            for k in range(batch.num_rows):
                payload, url = (texts[k].as_py() or "").encode(), urls[k].as_py()
                digest = base32_sha1(payload)
                data, segments = response(page_identifier(ids[k].as_py(), rows[k].as_py()), None if url is None else url.encode(), payload, digest, segment)
                out.append((digest, len(payload), data, segments))
                held += len(data)
                if held > 4 << 20 or k == batch.num_rows - 1:
                    d, n, r, g = zip(*out)
                    m = len(out)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, m), urls.slice(at, m), rows.slice(at, m), pa.array(d, pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.binary()), pa.array(g, pa.int64())], ["page_id", "url", "row", "digest", "n", "data", "segments"])
                    at, held, out = k + 1, 0, []

    packed = save(source.mapInArrow(pack, "page_id long, url string, row long, digest string, n long, data binary, segments long"), "warc-records")
    first = packed.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = save(first.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row"), "copies"), "payload-groups")
    n_groups, narrow = firsts.count(), packed.select("row", "digest")
    if n_groups <= BROADCAST_ROWS:
        again = narrow.join(F.broadcast(firsts), "digest")
    else:
        from .common import join_keyed

        again = join_keyed(narrow, firsts.drop("copies"), "digest", "inner", counts=firsts.select("digest", F.col("copies").alias("n")), total=packed.count())
    again = again.filter("row <> first_row").select("row", "first_page", "first_row")
    n_again = firsts.agg(F.sum(F.col("copies") - 1)).first()[0] or 0
    side = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
    planned = packed.join(side, "row", "left").select("page_id", "url", "row", "digest", "n", F.when(F.col("first_row").isNull(), F.col("data")).alias("data"), F.when(F.col("first_row").isNull(), F.col("segments")).otherwise(0).alias("segments"), "first_page", "first_row")
    folder = folder or scratch(spark, "warc")

    def write(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        files: dict[bool, list] = {}  # whole records and segmented ones: stream, path, bytes, records, segments

        def close(kind: bool) -> pa.RecordBatch:
            stream, path, *numbers = files.pop(kind)
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([x], pa.int64()) for x in numbers]], ["path", "bytes", "records", "segments"])

        for batch in batches:
            for r in batch.to_pylist():
                kind = r["segments"] > 0
                if kind not in files:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    files[kind] = [system.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None), path, 0, 0, 0]
                data = r["data"]
                if data is None:
                    data = revisit(page_identifier(r["page_id"], r["row"]), None if r["url"] is None else r["url"].encode(), r["n"], r["digest"], page_identifier(r["first_page"], r["first_row"]))
                now = files[kind]
                now[0].write(data)
                now[2:] = now[2] + len(data), now[3] + 1, now[4] + r["segments"]
                if now[2] >= FILE_BYTES:
                    yield close(kind)
        for kind in list(files):
            yield close(kind)

    return save(planned.mapInArrow(write, "path string, bytes long, records long, segments long"), "warc-manifest")


_READ = "record_id string, warc_type string, target_uri string, refers_to string, header_digest string, stated_bytes long, origin string, segment int, total long, data binary, problem string"


def _strip(value: str | None) -> str | None:
    return value[1:-1] if value else None


def _number(value: str | None) -> int | None:
    if value is not None and not value.isdigit():
        raise ValueError(f"not a number: {value}")
    return None if value is None else int(value)


def _row(member: bytes, segmented: bool, damage: bool) -> tuple | None:
    """A row of _READ from a gzip member: None for a record of the other kind. Raises ValueError if it is no record."""
    try:
        headers, block = parse(member)
        number, total = _number(headers.get("warc-segment-number")), _number(headers.get("warc-segment-total-length"))
    except ValueError:
        if damage:
            raise
        return None
    if (number is not None) != segmented:
        return None
    identifier, digest = _strip(headers["warc-record-id"]), headers.get("warc-payload-digest")
    stated, data, problem = None, block, None
    if not segmented:
        try:
            inner, data = open_http(block)
            if headers["warc-type"] == "revisit":
                stated, data = _number(inner.get("content-length")), None
        except ValueError as error:
            data, problem = None, str(error)
    return identifier, headers["warc-type"], headers.get("warc-target-uri"), _strip(headers.get("warc-refers-to")), digest and digest.removeprefix("sha1:"), stated, _strip(headers.get("warc-segment-origin-id")) or identifier, number, total, data, problem


def _read(manifest: DataFrame, segmented: bool) -> DataFrame:
    """Records of the files: whole ones with their payload, or segments with their part of the block. Damage is reported by the one
    that reads whole records, or, in files that have none, by the other, under an origin of its own."""

    def run(batches):
        for batch in batches:
            for path, pure in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                damage = pure or not segmented
                system, local = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(local, compression=None) as stream:
                    for k, member in enumerate(members(stream)):
                        try:
                            if isinstance(member, ValueError):
                                raise member
                            row = _row(member, segmented, damage)
                        except ValueError as error:
                            row = (None, None, None, None, None, None, f"{path}#{k}", None, None, None, f"{path}: {error}") if damage else None
                        if row:
                            rows.append(row)
                            held += len(row[-2] or b"")
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    # Files of whole records and of segmented ones are read once each; without counts of segments every file is read for both.
    if "segments" in manifest.columns:
        pure = F.col("segments") > 0
        manifest = manifest.filter(pure if segmented else ~pure)
    else:
        pure = F.lit(False)
    # One file is a unit of work: spread them evenly, each to a task of its own where there are enough tasks.
    return manifest.select("path", pure.alias("pure")).repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(run, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_PAYLOADS = "record_id string, warc_type string, target_uri string, refers_to string, header_digest string, stated_bytes long, payload binary, problem string"


def assemble(group: pa.Table) -> pa.Table:
    """One record from its segments (or damage, which is a group of its own)."""
    rows = sorted(group.to_pylist(), key=lambda r: r["segment"] or 0)
    head, payload, problem = rows[0], None, rows[0].get("problem")
    block = b"".join(r["data"] or b"" for r in rows)
    if problem:
        pass
    elif [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] is None:
        problem = "segments missing or doubled"
    elif rows[-1]["total"] != len(block):
        problem = "total length differs"
    else:
        try:
            payload = open_http(block)[1]
        except ValueError as error:
            problem = str(error)
    return pa.Table.from_pylist([{"record_id": head["origin"] if head["record_id"] else None, "warc_type": head["warc_type"], "target_uri": head["target_uri"], "refers_to": head["refers_to"], "header_digest": head["header_digest"], "stated_bytes": None, "payload": payload, "problem": problem}], pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _PAYLOADS.split(", ")]))


def read_archive(manifest: DataFrame) -> DataFrame:
    """(record_id, warc_type, target_uri, refers_to, header_digest, stated_bytes, payload, problem): one row per logical record, and
    one for each stretch of damage. ``manifest``: path, and segments (the number of segment records in a file that has no others, else
    0) if it is known."""
    small_batches(manifest.sparkSession)
    whole = _read(manifest, False).select("record_id", "warc_type", "target_uri", "refers_to", "header_digest", "stated_bytes", F.col("data").alias("payload"), "problem")
    return whole.unionByName(_read(manifest, True).groupBy("origin").applyInArrow(assemble, _PAYLOADS))


def base32_of_sha1(hexa):
    """Base32 of a SHA-1 given as 40 hex digits: 5 hex digits are 4 letters."""
    parts = [F.lpad(F.upper(F.conv(F.substring(hexa, 1 + 5 * k, 5), 16, 32)), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(table(spark, sf_dir, "pages")))
    page = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(3)).try_cast("long")
    again = F.col("warc_type") == "revisit"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(again, F.col("stated_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.col("header_digest")).otherwise(base32_of_sha1(F.sha1("payload"))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


_LETTERS = "translate(to_base(('0x' || substr(h, {at}, 5))::BIGINT, 32, 4), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, {" || ".join(_LETTERS.format(at=1 + 5 * k) for k in range(8))} AS digest,
  row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN f END AS refers_to FROM d
"""
