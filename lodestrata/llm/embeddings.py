"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, connected components.

1. Vectors with equal bytes collapse to a node. Each gets a sketch of WORDS * 64 signs, in whole numbers, so a vector's sketch doesn't
   depend on what it is computed with.
2. A table is a choice of ``bits`` signs; vectors with equal signs there meet in a bucket of up to FILL. Only (bucket, node, sketch)
   is shuffled, once a table. Inside a bucket, smaller choices of signs (``inner``) put together the pairs that are compared at all,
   and a pair goes on if its sketches differ in no more signs than a pair at the threshold would by far.
3. Nodes that go on fetch their vectors, once a bucket, and the exact cosine in double precision decides.

Whether a pair is compared follows from its two sketches alone, and it counts in the first table that both share, so counts add up
without listing pairs. Buckets of any size are worked in blocks (see ``graph``). ``plan`` takes bits and tables from the number of
nodes and from the recall wanted for a pair exactly at the threshold; there is no cap on buckets or candidates.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; components are scaled
before they are squared, so norms neither overflow nor vanish; vectors of different lengths never link; repeated rows link with each
other; a null vec_id is never the smallest of its component unless all are null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, map_batches, ragged, save, table
from .graph import LINKS, bucket_groups, components, forest, link_batches

#: 64-bit words of a sketch.
WORDS = 3
#: Nodes that a bucket may hold by the plan; a group of two blocks holds twice that.
FILL = 1 << 19
#: Nodes of a block where vectors are compared.
BLOCK = 4096
#: Pairs looked at in one step.
STEP = 1 << 18
_SCALE = 1 << 20


@dataclass(frozen=True)
class Plan:
    bits: int  # signs of a table
    tables: int
    inner_bits: int
    inner: int  # inner choices of signs
    differ: int  # most signs in which the sketches of a pair may differ


def plan(n: int, threshold: float, recall: float = 0.97) -> Plan:
    """Tables for ``recall`` of the pairs at the threshold among ``n`` nodes; at most FILL nodes to a bucket were they spread evenly."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    total = 64 * WORDS

    def times(chance: float, wanted: float) -> int:
        return 1 if chance >= 1 else max(1, math.ceil(math.log(1 - wanted) / math.log(1 - chance)))

    bits = min(48, max(0 if n <= 4096 else 3, math.ceil(math.log2(max(n, 2) / FILL))))
    inner_bits = min(16, max(0, math.ceil(math.log2(max(n, 2) / 2**bits / 32))))
    lost = (1 - recall) / 4  # by the inner choices, by the sketches; and twice that by the tables
    differ = total * (1 - same) + math.sqrt(-2 * math.log(lost) * total * same * (1 - same))
    return Plan(bits, times(same**bits, 1 - 2 * lost), inner_bits, times(same**inner_bits, 1 - lost), min(total, math.ceil(differ)))


def choices(bits: int, count: int, seed: int, spread: bool) -> np.ndarray:
    """(count, bits) choices out of all signs; ``spread``: without a sign in two of them as long as there are enough."""
    rng, total = np.random.default_rng([seed, bits, count]), 64 * WORDS
    out, deck = np.zeros((count, bits), np.int64), np.zeros(0, np.int64)
    for k in range(count):
        if not spread or len(deck) < bits:
            deck = rng.permutation(total)
        out[k], deck = deck[:bits], deck[bits:]
    return out


def masks(chosen: np.ndarray) -> np.ndarray:
    """(count, WORDS) of the choices."""
    out = np.zeros((len(chosen), WORDS), np.uint64)
    for k, row in enumerate(chosen.tolist()):
        for b in row:
            out[k, b // 64] |= np.uint64(1 << (b % 64))
    return out


def planes(length: int, seed: int) -> np.ndarray:
    """Whole numbers, normally distributed."""
    return np.rint(np.random.default_rng([seed, length]).normal(size=(length, 64 * WORDS)) * 64)


def sketches(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """(rows, WORDS) signs on the sides of random hyperplanes. All sums are of whole numbers below 2**53: exact in any order."""
    top = np.abs(vectors).max(1, keepdims=True)
    whole = np.rint(np.ldexp(vectors, -np.frexp(top)[1]) * _SCALE)
    signs = whole @ planes(vectors.shape[1], seed) > 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled by a power of two first, which is exact."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
    return v / np.sqrt(np.square(v).sum(1, keepdims=True))


def _shares(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which differences ``x`` (pairs, WORDS) have no sign of ``mask``."""
    return ~((x & mask).any(1))


def candidates(sketch: np.ndarray, inner: np.ndarray, differ: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, difference) of the pairs x < y of rows that share an inner choice of signs and differ little, each once."""
    n, mask = len(sketch), masks(inner)
    for k, chosen in enumerate(inner.tolist()):
        key = np.zeros(n, np.uint16)  # small enough for a radix sort
        for place, b in enumerate(chosen):
            key |= ((sketch[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.uint16) << np.uint16(place)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] ^ 1))
        size = np.diff(np.append(first, n))
        real = size > 1
        f, s = first[real], size[real]
        if not len(f):
            continue
        # Each row with all that follow it in its run, in steps of about STEP pairs.
        row = ragged(f, s)
        after = np.repeat(f + s, s) - row - 1
        bound = np.cumsum(after)
        at = 0
        while at < len(row):
            done = bound[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(bound, done + STEP, "right")))
            left = np.repeat(row[at:stop], after[at:stop])
            right = ragged(row[at:stop] + 1, after[at:stop])
            at = stop
            for j in range(0, len(left), STEP):
                p, q = order[left[j : j + STEP]], order[right[j : j + STEP]]
                x = sketch[p] ^ sketch[q]
                near = np.flatnonzero(np.bitwise_count(x).sum(1, dtype=np.int64) <= differ)
                x, p, q = x[near], p[near], q[near]
                ok = np.ones(len(x), bool)
                for earlier in mask[:k]:
                    ok &= ~_shares(x, earlier)
                if ok.any():
                    x, p, q = x[ok], p[ok], q[ok]
                    yield np.minimum(p, q), np.maximum(p, q), x


def _first_table(x: np.ndarray, outer: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which pairs share their own table and none before it."""
    ok, last = np.ones(len(x), bool), int(own.max(initial=0))
    for t in range(last + 1):
        shares = _shares(x, outer[t])
        ok &= np.where(own > t, ~shares, np.where(own == t, shares, True))
    return ok


def cosine_links(embeddings: DataFrame, threshold: float = 0.9, recall: float = 0.97, seed: int = 11, broadcast_rows: int = 500_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding).

    The nodes whose vectors are fetched are broadcast (24 bytes each) only while they are at most ``broadcast_rows``; beyond, the same
    join shuffles.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    single = embeddings.schema["embedding"].dataType.elementType.simpleString() == "float"
    number = np.float32 if single else np.float64
    names = [f"s{k}" for k in range(WORDS)]

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        n = len(lists)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        bad = np.zeros(len(flat), bool) if not flat.null_count else flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(number) + number(0)  # -0.0 becomes 0.0
        start = np.cumsum(size) - size
        out, signs = [None] * n, np.zeros((n, WORDS), np.uint64)
        for length in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == length)
            at = start[rows][:, None] + np.arange(length)
            v = values[at]
            fine = np.isfinite(v).all(1) & v.any(1) & ~bad[at].any(1)
            rows, v = rows[fine], v[fine]
            if len(rows):
                signs[rows] = sketches(v.astype(np.float64), seed)
                blob = v.tobytes()
                step = length * v.itemsize
                for k, r in enumerate(rows):
                    out[r] = blob[k * step : (k + 1) * step]
        columns = [batch.column(0), pa.array(out, pa.binary()), *[pa.array(np.ascontiguousarray(signs[:, k]).view(np.int64)) for k in range(WORDS)]]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", *names])

    # Read and packed again wherever vectors are needed: they are neither written nor shuffled as a whole.
    packed = map_batches(embeddings.select("vec_id", "embedding"), pack, f"vec_id {kind}, vec binary, " + ", ".join(f"{s} long" for s in names))
    packed = packed.withColumn("key", F.unhex(F.md5("vec")))
    reps = packed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first(F.octet_length("vec")).alias("length"), *[F.first(s).alias(s) for s in names])
    reps = save(reps.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    n_nodes = reps.count()
    p = plan(n_nodes, threshold, recall)
    outer, inner = masks(choices(p.bits, p.tables, seed, True)), choices(p.inner_bits, p.inner, seed + 1, False)

    def signed(x: np.uint64) -> int:
        return int(np.array(x).view(np.int64))

    keys = [F.xxhash64(F.lit(t), "length", *[F.col(s).bitwiseAND(F.lit(signed(mask[k]))) for k, s in enumerate(names)]) for t, mask in enumerate(outer)]
    placed = reps.select(F.posexplode(F.array(*keys)).alias("t", "bucket"), "node", *names)

    def sketch_of(cols: dict[str, np.ndarray], f: int, e: int) -> np.ndarray:
        return np.stack([cols[s][f:e].view(np.uint64) for s in names], 1)

    def meet(cols, first, end) -> Iterator[pa.RecordBatch]:
        """The nodes that have a pair to verify in a group, as members of a smaller group."""
        for f, e in zip(first, end):
            sketch, own, t = sketch_of(cols, f, e), cols["own"][f:e], cols["t"][f:e].astype(np.int64)
            single = cols["i"][f] == cols["j"][f]
            used = np.zeros(e - f, bool)
            for x, y, d in candidates(sketch, inner, p.differ):
                ok = t[x] == t[y] if single else (t[x] == t[y]) & (own[x] != own[y])
                if ok.any():
                    x, y, d = x[ok], y[ok], d[ok]
                    ok = _first_table(d, outer, t[x])
                    used[x[ok]] = used[y[ok]] = True
            at = np.flatnonzero(used)
            if len(at):
                side = np.full(len(at), 2, np.int32) if single else (own[at] == cols["j"][f]).astype(np.int32)
                whole = lambda v: pa.array(np.full(len(at), v, np.int64))
                columns = [whole(cols["bucket"][f]), whole(int(cols["i"][f]) << 32 | int(cols["j"][f])), pa.array(side), pa.array(t[at]), pa.array(cols["node"][f:e][at])]
                yield pa.RecordBatch.from_arrays(columns, ["from", "blocks", "side", "t", "node"])

    met = save(bucket_groups(placed, meet, ["t", *names], "from long, blocks long, side int, t long, node long", FILL), "meetings")
    wanted = save(met.select("node").distinct().join(reps.drop("length"), "node"), "wanted-vectors")
    few = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    source = packed.select(F.col("key").alias("own_key"), "vec_id", "vec")
    known = few.join(source, (F.col("own_key") == F.col("key")) & F.col("vec_id").eqNullSafe(F.col("low")))
    vectors = known.groupBy("node").agg(F.first("copies").alias("w"), *[F.first(few[s]).alias(s) for s in names], F.first("vec").alias("vec"))
    members = met.join(vectors, "node").withColumn("bucket", F.xxhash64("from", "blocks"))

    def verify(cols, first, end) -> Iterator[pa.RecordBatch]:
        nodes, counts, a, b = [], [], [], []
        for f, e in zip(first, end):
            sketch, node, w, n = sketch_of(cols, f, e), cols["node"][f:e], cols["w"][f:e], e - f
            same = [cols[c][f:e] for c in ("t", "from", "blocks")]
            own, side, single = cols["own"][f:e], cols["side"][f:e], cols["i"][f] == cols["j"][f]
            blobs = cols["vec"][f:e]
            size = np.array([len(x) for x in blobs])
            where, unit = np.zeros(n, np.int64), {}
            for length in np.unique(size):  # one, unless hashes of buckets collide
                rows = np.flatnonzero(size == length)
                where[rows] = np.arange(len(rows))
                unit[length] = units(np.frombuffer(b"".join(blobs[rows]), number).reshape(len(rows), -1))
            count = np.zeros(n)
            for x, y, d in candidates(sketch, inner, p.differ):
                ok = (size[x] == size[y]) & ((side[x] != side[y]) | (side[x] == 2))
                for c in same:
                    ok &= c[x] == c[y]
                if not single:
                    ok &= own[x] != own[y]
                x, y, d = x[ok], y[ok], d[ok]
                ok = _first_table(d, outer, same[0][x])
                x, y = x[ok], y[ok]
                close = np.zeros(len(x), bool)
                for at in range(0, len(x), 1 << 15):
                    left, right = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                    for length, u in unit.items():
                        mine = np.flatnonzero(size[left] == length)
                        close[at + mine] = np.einsum("ij,ij->i", u[where[left[mine]]], u[where[right[mine]]]) >= threshold
                x, y = x[close], y[close]
                if len(x):
                    count += np.bincount(x, w[y], n) + np.bincount(y, w[x], n)
                    u, v = forest(node[x], node[y])
                    a.append(u)
                    b.append(v)
            used = np.flatnonzero(count)
            nodes.append(node[used])
            counts.append(count[used])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield from link_batches(join(nodes), join(counts), join(a), join(b))

    links = save(bucket_groups(members, verify, ["t", "from", "blocks", "side", "w", *names, "vec"], LINKS, BLOCK), "links")
    near = links.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = reps.select("node", "key", "low", "copies").join(components(links.filter("kind = 1").select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = save(named.join(near, "node", "left"), "named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    # One component may hold a third of all nodes, one vector a third of all rows.
    per_node = join_keyed(named, lows.drop("size"), "component", counts=lows.select("component", F.col("size").alias("n")), total=n_nodes)
    per_key = per_node.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = join_keyed(packed.select("vec_id", "key"), per_key, "key", counts=reps.select("key", F.col("copies").alias("n")), total=embeddings.count())
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(table(spark, sf_dir, "embeddings"))
