"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints come from one narrow numpy pass (XXH64 of every shingle, vectorised). Equal fingerprints collapse before anything is
joined, so groups of copies cost one row. The 64 bits are split into ``m`` blocks; two fingerprints at most 3 bits apart share at
least m - 3 of them, so for every choice of m - 3 blocks the fingerprints with the same bits there meet in a bucket and are
verified by popcount. ``m`` grows with the number of distinct fingerprints, which keeps buckets small; any ``m`` gives the same
links. A pair that meets in several buckets counts in the first alone.

A text of more than ``STEP_BYTES`` goes through in slices that end at white space: bit counts add up, the last words of a slice go on
to the next, and shingles across a cut (or with a word longer than a slice) are hashed piece by piece. Memory doesn't grow with it.

Defined results: null and empty texts have fingerprint 0 and link like any other; texts of one or two words are one shingle;
repeated rows are documents of their own; a null doc_id is never the smallest of its group unless all are null; an empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``, which decides by rows,
never by ids: see there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, _WS, MARKS, STEP_BYTES, join_keyed, map_batches, marked, row_of, save, split_repeats, steps, table, utf8, words
from .graph import components, group_links, link_buckets

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


#: Spans of more bytes go to the library one by one.
_FAR = 2048


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of ``buf``; all spans advance together."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    w4 = np.ndarray(len(buf) + 1, "<u4", padded, 0, (1,))
    size = end - start
    at = start.copy()
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(start), s + _P5, np.uint64)
        far = np.flatnonzero(size > _FAR)  # a round of the loop below for each 32 bytes of the longest span
        if len(far):
            h[far] = [xxhash.xxh64_intdigest(buf[start[k] : end[k]].tobytes(), seed) for k in far]
            near = np.flatnonzero(size <= _FAR)
            h[near] = xxh64(buf, start[near], end[near], seed)
            return h
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes, p, live = size[long] // 32, at[long].copy(), np.arange(len(long))
            for k in range(int(stripes.max())):
                live = live[stripes[live] > k]
                for lane in range(4):
                    v[lane][live] = _round(v[lane][live], w8[p[live] + 8 * lane])
                p[live] += 32
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.uint64(0), x)) * _P1 + _P4
            h[long], at[long] = acc, p
        h += size.astype(np.uint64)
        for _ in range(3):
            live = np.flatnonzero(end - at >= 8)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), w8[at[live]]), 27) * _P1 + _P4
            at[live] += 8
        live = np.flatnonzero(end - at >= 4)
        h[live] = _rotl(h[live] ^ (w4[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[live] += 4
        for _ in range(3):
            live = np.flatnonzero(end > at)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


_ONES = np.uint64(0x0101010101010101)
#: Bit 8 * i + j is counted by byte i of the words that hold the bits j of each byte.
_BIT = np.array([8 * i + j for j in range(8) for i in range(8)])


def bit_counts(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(runs, 64): for each run [first, end) of hashes how many have each bit."""
    size = end - first
    out = np.zeros((len(first), 64), np.int64)
    used = np.flatnonzero(size > 0)
    if not len(used):
        return out
    # Byte counters: eight bits at a time, in chunks of at most 255 hashes.
    chunks = (size[used] + 254) // 255
    starts = np.repeat(first[used], chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    owner = np.cumsum(chunks) - chunks
    for j in range(8):
        packed = np.add.reduceat((h >> np.uint64(j)) & _ONES, starts)
        out[used[:, None], _BIT[8 * j : 8 * j + 8]] = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
    return out


def majority(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of ``size`` hashes."""
    return ((2 * counts > size[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def shingles(buf: np.ndarray, offs: np.ndarray, width: int, seed: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the rows' shingles, where each row's begin and how many they are. ``short``: fewer words than ``width`` are one."""
    n = len(offs) - 1
    none = np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not len(buf):
        return none
    space = _WS[buf]
    inner = np.ones(len(buf), bool)  # first white space behind a word of the same row
    inner[1:] = ~space[:-1]
    edge = offs[:-1][offs[:-1] < len(buf)]
    inner[edge] = False
    kept = ~space | inner
    low = np.where(space, np.uint8(32), _LOWER[buf])[kept]
    place = np.concatenate([[0], np.cumsum(kept)])
    rows = place[offs]
    blank = low == 32
    begin = ~blank
    begin[1:] &= blank[:-1]
    at_row = rows[:-1][rows[:-1] < rows[1:]]
    begin[at_row] |= ~blank[at_row]
    start = np.flatnonzero(begin)
    if not len(start):
        return none
    row = row_of(rows, start)
    # A word ends where the next blank or the row's end is.
    stop = ~blank
    stop[:-1] &= blank[1:]
    last = rows[1:][rows[1:] > rows[:-1]] - 1
    stop[last] |= ~blank[last]
    end = np.flatnonzero(stop) + 1
    per_row = np.bincount(row, minlength=n)
    first = np.cumsum(per_row) - per_row
    size = np.maximum(per_row - width + 1, (per_row > 0).astype(per_row.dtype) if short else 0)
    taken = np.cumsum(size) - size
    index = np.arange(int(size.sum())) - np.repeat(taken - first, size)
    final = np.minimum(index + width - 1, np.repeat(first + per_row - 1, size))
    return xxh64(low, start[index], end[final], seed), taken, size


def _hash_words(buf: np.ndarray, spans: list[tuple[int, int]], seed: int) -> int:
    """Hash of one shingle, a piece at a time."""
    state = xxhash.xxh64(seed=seed)
    for k, (a, b) in enumerate(spans):
        if k:
            state.update(b" ")
        for at in range(a, b, STEP_BYTES):
            state.update(_LOWER[buf[at : min(b, at + STEP_BYTES)]].tobytes())
    return state.intdigest()


def long_fingerprint(buf: np.ndarray, width: int = 3, seed: int = 42, step: int = STEP_BYTES) -> int:
    """SimHash of one long text, slice by slice."""
    total, size = np.zeros(64, np.int64), 0
    tail: list[tuple[int, int]] = []  # the last words so far, whose shingles may go on

    def add(h: np.ndarray, n: int) -> None:
        nonlocal size
        if n:
            total[:] += bit_counts(h, np.array([0]), np.array([n]))[0]
            size += n

    at = 0
    while at < len(buf):
        stop = min(len(buf), at + step)
        giant = False
        if stop < len(buf):
            blank = np.flatnonzero(_WS[buf[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
            else:  # one word fills the slice: to its end
                giant = True
                while stop < len(buf) and not _WS[buf[stop]]:
                    more = np.flatnonzero(_WS[buf[stop : stop + step]])
                    stop = stop + int(more[0]) if len(more) else min(len(buf), stop + step)
        if giant:
            spans, n = [(at, stop)], 1
            h, inside = np.zeros(0, np.uint64), 0
            head = spans
        else:
            start, end = words(buf[at:stop], np.array([0, stop - at]))
            n = len(start)
            near = list(zip((start[: width - 1] + at).tolist(), (end[: width - 1] + at).tolist()))
            spans = list(zip((start[-(width - 1) :] + at).tolist(), (end[-(width - 1) :] + at).tolist())) if width > 1 else []
            h, _, sizes = shingles(buf[at:stop], np.array([0, stop - at]), width, seed, short=False)
            inside, head = int(sizes[0]), near
        if giant and width == 1:
            h, inside = np.array([_hash_words(buf, spans, seed)], np.uint64), 1
        add(h, inside)
        seam = tail + head
        across = [_hash_words(buf, seam[k : k + width], seed) for k in range(len(tail)) if k + width <= len(seam)]
        add(np.array(across, np.uint64), len(across))
        tail = (tail + spans if n < width else spans)[-(width - 1) :] if width > 1 else []
        at = stop
    if not size and tail:
        add(np.array([_hash_words(buf, tail, seed)], np.uint64), 1)
    return int(majority(total[None], np.array([size]))[0])


def fingerprints(buf: np.ndarray, offs: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each row of a UTF-8 buffer."""
    if len(offs) == 2 and len(buf) > STEP_BYTES:
        return np.array([long_fingerprint(buf, width, seed)], np.uint64)
    h, taken, size = shingles(buf, offs, width, seed)
    return majority(bit_counts(h, taken, taken + size), size)


def simhash(docs: DataFrame, width: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, ``carry``) of each row."""

    def kernel(batch: pa.RecordBatch):
        buf, offs = utf8(batch.column(1))
        out = [fingerprints(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width, seed) for i, j in steps(offs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text"), *carry), kernel, f"doc_id {kind}, fp long" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry))


def block_masks(m: int, distance: int = 3) -> list[int]:
    """One mask for each choice of m - distance out of m blocks of the 64 bits."""
    cuts = [round(64 * k / m) for k in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m - distance)]


def blocks_for(n: int, distance: int = 3) -> int:
    """The fewest blocks whose shared part has more bits than there are fingerprints to tell apart (to a factor of 16)."""
    bits = max(n, 2).bit_length()
    return next(m for m in range(distance + 1, 65) if (m - distance) * 64 // m + 4 >= bits or m == distance + 5)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(groups: DataFrame, distance: int, m: int | None) -> DataFrame:
    """``groups`` (fp, copies, ...; a row for each fingerprint) with ``component`` (an fp) and ``near``: rows of other fingerprints linked."""
    masks = block_masks(m or blocks_for(groups.count(), distance), distance)
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("part")) for t, x in enumerate(masks)])).alias("at")
    rows = groups.select(tables, F.col("fp").alias("node"), F.col("copies").alias("w")).select(F.xxhash64("at.t", "at.part").alias("bucket"), "node", F.col("at.t").alias("t"), "w")
    wide = np.array(masks, np.uint64)

    def valid(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Close, sharing table t's blocks (bucket hashes may collide), and no earlier table's."""
        ok = np.bitwise_count(x) <= distance
        if ok.any():
            at = np.nonzero(ok)
            bits, own = x[at], t[at]
            sure = np.empty(len(bits), bool)
            for k in range(0, len(bits), 1 << 16):
                b, o = bits[k : k + (1 << 16)], own[k : k + (1 << 16)]
                sure[k : k + (1 << 16)] = (np.argmax((b[:, None] & wide) == 0, axis=1) == o) & ((b & wide[o]) == 0)
            ok[at] = sure
        return ok

    def kernel(cols, first, end):
        node, t, w, own = cols["node"].view(np.uint64), cols["t"], cols["w"], cols["own"]
        nodes, counts, a, b = [], [], [], []
        size = end - first
        small = size <= 64
        if small.any():
            f, e = first[small], end[small]
            limit = np.repeat(e, e - f)
            index = np.concatenate([np.arange(x, y) for x, y in zip(f, e)]) if len(f) < 64 else _expand(f, e)
            for d in range(1, int((e - f).max())):
                live = index + d < limit
                index, limit = index[live], limit[live]
                x, y = index, index + d
                same = t[x] == t[y]
                # Within a pair of blocks only pairs across count; a block with itself has own == own.
                across = (cols["i"][x] == cols["j"][x]) | (own[x] != own[y])
                ok = same & across
                ok[ok] = valid(node[x[ok]] ^ node[y[ok]], t[x[ok]])
                x, y = x[ok], y[ok]
                nodes += [node[x], node[y]]
                counts += [w[y], w[x]]
                a.append(node[x])
                b.append(node[y])
        for f, e in zip(first[~small], end[~small]):
            inside = np.arange(f, e)
            if cols["i"][f] == cols["j"][f]:
                ra = rb = inside
            else:
                ra, rb = inside[own[f:e] == cols["i"][f]], inside[own[f:e] == cols["j"][f]]
            x = node[ra][:, None] ^ node[rb]
            ok = valid(x, np.broadcast_to(t[ra][:, None], x.shape)) & (t[ra][:, None] == t[rb])
            if ra is rb:
                np.fill_diagonal(ok, False)
            r, c, u, v = group_links(ok, ra, rb, w, ra is rb)
            nodes.append(node[r])
            counts.append(c)
            a.append(node[u])
            b.append(node[v])
        join = lambda x, kind: np.concatenate(x).view(kind) if x else np.zeros(0, kind)
        return join(nodes, np.int64), join(counts, np.int64), join(a, np.int64), join(b, np.int64)

    links = save(link_buckets(rows, kernel, ["t", "w"]), "links")
    near = links.filter("kind = 0").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("near"))
    comp = components(links.filter("kind = 1").select("a", "b"))
    named = groups.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return named.join(near, "fp", "left").withColumn("near", F.coalesce("near", F.lit(0)))


def near_duplicates(docs: DataFrame, distance: int = 3, m: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, n_near, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    prints = save(simhash(docs), "simhash")
    groups = save(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "fingerprints")
    named = save(_linked(groups, distance, m), "named")
    members = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    # One component may hold a third of all fingerprints.
    per_print = join_keyed(named, members.drop("n"), "component", counts=members.select("component", "n"), total=named.count())
    per_print = per_print.select("fp", (F.col("copies") - 1 + F.col("near")).alias("n_near"), "component_id")
    out = join_keyed(prints, per_print, "fp", counts=groups.select("fp", F.col("copies").alias("n")), total=prints.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _expand(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .common import ragged

    return ragged(first, end - first)


def drop_near_duplicates(docs: DataFrame, distance: int = 3, broadcast_rows: int = 1_000_000, m: int | None = None) -> DataFrame:
    """One row of each component of ``docs``; all columns stay.

    The row of smallest doc_id stays (null ids come last); of rows that share that id the one of smallest fingerprint (signed), then of
    smallest row hash, so only rows alike in all columns are ever interchangeable, and one of those stays. Ids decide nothing else: a
    row goes only if its own text is in a component that keeps another row. Rows are told apart by 128 bits of hashes of all their
    columns. The marks of rows to drop are broadcast (16 bytes each) only while they are at most ``broadcast_rows``; beyond, the same
    anti-join shuffles.
    """
    prints = save(simhash(marked(docs, "doc_id", "text").drop("row"), carry=MARKS), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", *MARKS)
    groups = save(prints.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("copies")), "fingerprints")
    named = save(_linked(groups, distance, m), "named")
    members = named.groupBy("component").agg(F.min("low").alias("head"), F.count("*").alias("n"))
    per_print = join_keyed(named.select("fp", "component"), members.select("component", F.col("head.mark1").alias("head1"), F.col("head.mark2").alias("head2")), "component", counts=members.select("component", "n"), total=named.count())
    judged = join_keyed(prints, per_print.select("fp", "head1", "head2"), "fp", counts=groups.select("fp", F.col("copies").alias("n")), total=prints.count())
    stays = (F.col("mark1") == F.col("head1")) & (F.col("mark2") == F.col("head2"))
    judged = save(judged.groupBy(*MARKS).agg(F.first(stays).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "judged-rows")
    gone, again = judged.filter("not stays").select(*MARKS), judged.filter("stays").select(*MARKS)
    n_gone = gone.count()
    rows = marked(docs)
    left = rows.join(F.broadcast(gone) if n_gone <= broadcast_rows else gone, list(MARKS), "left_anti") if n_gone else rows
    once, repeats = split_repeats(left, again, broadcast_rows)
    return (once if repeats is None else once.unionByName(repeats)).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
