"""Links inside buckets and connected components, without emitting the pairs of a group.

``bucket_groups`` takes rows already assigned to buckets. A bucket of more than ``block`` rows is cut into blocks by a hash of the
node, and each pair of blocks becomes a task group of its own, so the work of a hot bucket spreads over the cluster while every pair
is still compared exactly once. ``link_buckets`` are such groups that yield one partial count per node and the edges of a spanning
forest, never their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, save, small_batches

#: Rows of a block; a group holds two at most.
BLOCK = 1024
#: Up to so many edges one task finishes the components; beyond, rounds of large and small stars go on.
FINISH = 1_000_000


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each index's component, for edges (a, b) among range(n)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component), nodes other than the smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = min_labels(index[: len(a)], index[len(a) :], len(nodes))
    kept = label != np.arange(len(nodes))
    return nodes[kept], nodes[label[kept]]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = [b for b in batches if b.num_rows]
    if kept:
        x, y = forest(np.concatenate([b.column(0).to_numpy() for b in kept]), np.concatenate([b.column(1).to_numpy() for b in kept]))
        for at in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]), pa.array(y[at : at + (1 << 16)])], ["a", "b"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step; edges (a, b) with a > b."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        joined = join_keyed(both, low.select("a", "m"), "a", "inner", counts=low.select("a", "n"), total=2 * edges.count())
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_keyed(edges, low.select("a", "m"), "a", "inner", counts=low.select("a", "n"), total=edges.count())
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component): for each node on an edge (a, b: long, not null) the smallest node it reaches. Loops and repeats are fine."""
    small_batches(edges.sparkSession)
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = save(edges.mapInArrow(_forest_batches, "a long, b long"), "edges")
    seen = None
    while True:
        if now.count() <= finish:
            return now.repartition(1).mapInArrow(_finish, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component")).transform(_with_roots)
        now = save(_stars(now, True).distinct(), "large")
        now = save(_stars(now, False).distinct().mapInArrow(_forest_batches, "a long, b long").distinct(), "small")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return _with_roots(now.select(F.col("a").alias("node"), F.col("b").alias("component")))
        seen = sign


def _with_roots(labels: DataFrame) -> DataFrame:
    labels = save(labels, "labels")
    return labels.union(labels.select("component", "component").distinct())


Kernel = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]
LINKS = "kind int, a long, b long, n long"


def link_batches(node: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """LINKS of some groups: their nodes' counts, and a forest of their edges (a, b)."""
    if len(node):
        node, back = np.unique(node, return_inverse=True)
        count = np.bincount(back, count).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(node), np.int32)), pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(count)], ["kind", "a", "b", "n"])
    if len(a):
        x, y = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], ["kind", "a", "b", "n"])


def link_buckets(rows: DataFrame, kernel: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple], extra: list[str]) -> DataFrame:
    """(kind, a, b, n): kind 0 gives node ``a`` ``n`` more links, kind 1 is an edge of a spanning forest. ``kernel`` returns (nodes,
    counts, edges a, edges b); see ``bucket_groups``."""
    return bucket_groups(rows, lambda cols, first, end: link_batches(*kernel(cols, first, end)), extra, LINKS, BLOCK)


def bucket_groups(rows: DataFrame, kernel: Kernel, extra: list[str], schema: str, block: int) -> DataFrame:
    """What ``kernel`` yields for the groups of ``rows``.

    ``rows``: bucket (long), node (long), and the ``extra`` columns (long, binary, or array columns of one length). ``kernel`` gets
    numpy columns, among them i, j and own (a group with i = j is one block, any other the pair of its rows with own = i and with
    own = j), and the first row and end of some groups of more than one row.
    """
    small_batches(rows.sparkSession)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > block)
    hot = save(sizes, "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        sized = rows.join(F.broadcast(hot), "bucket", "left") if n_hot <= 50_000 else join_keyed(rows, hot, "bucket", counts=hot.select("bucket", F.col("size").alias("n")))
        placed = sized.withColumn("nb", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")).drop("size")
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int")
        placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        placed = placed.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *extra)
    else:
        placed = rows.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "node", *extra)
    placed = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {}
            for name in part.column_names:
                column = part.column(name).combine_chunks()
                if pa.types.is_list(column.type):
                    flat = column.flatten()
                    cols[name] = flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
                else:
                    cols[name] = column.to_numpy(zero_copy_only=False)
            change = np.ones(len(part), bool)
            change[1:] = (cols["bucket"][1:] != cols["bucket"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])
            first = np.flatnonzero(change)
            end = np.append(first[1:], len(part))
            real = end - first > 1
            if not real.any():
                return
            yield from kernel(cols, first[real], end[real])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Complete groups go ahead; the last may continue in the next batch.
            keys = [batch.column(k).to_numpy() for k in (0, 1, 2)]
            last = np.ones(batch.num_rows, bool)
            for k in keys:
                last &= k == k[-1]
            at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if held:
                tail = held[-1].slice(held[-1].num_rows - 1)
                same = all(tail.column(k)[0].as_py() == keys[k][0] for k in (0, 1, 2))
                if not same:
                    yield from work(pa.Table.from_batches(held))
                    held = []
            if at:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at))
        if held:
            yield from work(pa.Table.from_batches(held))

    return placed.mapInArrow(run, schema)


def group_links(linked: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, weight: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and forest of one group's link matrix. ``square``: both sides are the same rows and the matrix is symmetric.

    Returns (rows, counts, edge rows a, edge rows b).
    """
    to_a = linked @ weight[rows_b].astype(np.float64)
    if square:
        x, y = np.nonzero(np.triu(linked, 1)) if len(rows_a) <= 64 else _thin(linked)
        return rows_a, to_a.astype(np.int64), rows_a[x], rows_a[y]
    to_b = weight[rows_a].astype(np.float64) @ linked
    x, y = np.nonzero(linked)
    if len(x) > 4 * (len(rows_a) + len(rows_b)):
        u, v = forest(x, y + len(rows_a))
        both = np.concatenate([rows_a, rows_b])
        return both, np.concatenate([to_a, to_b]).astype(np.int64), both[u], both[v]
    return np.concatenate([rows_a, rows_b]), np.concatenate([to_a, to_b]).astype(np.int64), rows_a[x], rows_b[y]


def _thin(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.nonzero(np.triu(linked, 1))
    return forest(x, y) if len(x) > 4 * len(linked) else (x, y)
