"""Mixing sources to target weights by the cube method.

Targets: the sources, in code-point order with null last, weigh 3, 1, 2 in turn and share 150 % of all words; a source's target stops
at twice its size and the excess is shared again by weight. A document of a source with target/size = r enters floor(r) times for
sure and once more with probability r - floor(r).

Which documents enter once more is drawn by balanced sampling: the flight phase moves three fractional units at a time along the null
space of the two constraints (documents, words), so both totals stay exactly where the probabilities put them, until no more than two
units of a block are fractional. Blocks of about BLOCK units are cut from each source by a hash, so a source with a third of all
rows spreads over many tasks; what the blocks leave over is regrouped and flown again, each time a thousandth of the units, until
one block per source is left. There the landing problem (two units) is solved by dropping the document constraint, then by
chance, and one to three exchanges between units of that last block bring the word total back to its expectation.

Rows that agree in (doc_id, source, size) are one unit with c copies, whose c * r expected entries are split the same way. Blocks,
order and random numbers depend on these values alone, so reruns agree. ``apply_mix`` hands a unit's entries to its rows in the order
of hashes of all their columns: the same rows at any partitioning, and rows alike in all columns count as so many of one.

Defined results: null or empty text: size 0, taken 0; null source: a source of its own, last; repeated rows: copies of a unit, ordered by
nothing else; empty table: empty result; other columns, whatever their names, are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MARKS, join_keyed, marked, save, small_batches, split_repeats, table

BLOCK = 4096
#: A table of at most so many sources is broadcast; beyond, only hot sources are.
FEW_SOURCES = 20_000
SHARE = (3, 2)  # 150 % of all words
#: A row that stands for more rows than this is cut into parts of so many before they are spread over tasks and written out.
PART = 10_000
#: Distinct rows of one unit that a task ranks at once.
RANKED = 4096
_EPS = 1e-9


def words(column: str = "text"):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` saved in a global order, with each of ``sums`` over all rows before a row: sums within the sort's partitions plus each
    partition's offset, which is one row a partition on the driver."""
    ordered = save(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", 33)), "ordered")
    totals = {r[0]: r[1:] for r in ordered.groupBy("__p").agg(*[F.sum(c) for c in sums.values()]).collect()}
    offsets, total = {}, [0] * len(sums)
    for p in sorted(totals):
        offsets[p] = list(total)
        total = [x + y for x, y in zip(total, totals[p])]
    before = Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    for k, (name, c) in enumerate(sums.items()):
        offset = F.create_map(*[F.lit(x) for p, v in offsets.items() for x in (p, v[k])])[F.col("__p")] if offsets else F.lit(0)
        ordered = ordered.withColumn(name, F.coalesce(F.sum(c).over(before), F.lit(0)) + offset)
    return ordered.drop("__at", "__p")


def targets(units: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, n, target) from (source, size, c): one row per source.

    A source is full when the water stands at 2 * size / weight. In the order of that height, the sums of all lower sources give the
    level at which the budget is used up, in one pass for any number of sources.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.count("*").alias("n"))
    ranked = _running(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("full", 2.0 * F.col("source_size") / F.col("w"))
    filled = save(_running(weighed, [F.col("full"), F.col("rank")], {"stopped": 2 * F.col("source_size"), "closed": F.col("w")}), "weights")
    total, weight = filled.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit((total or 0) * SHARE[0] / SHARE[1]) - F.col("stopped")) / (F.lit(weight or 0) - F.col("closed"))
    water = filled.select("full", "rank", level.alias("level")).filter("level <= full").agg(F.min_by("level", F.struct("full", "rank"))).first()[0]
    most = 2.0 * F.col("source_size")
    return filled.select("source", "source_size", "n", (most if water is None else F.least(most, F.col("w") * F.lit(water))).alias("target"))


def flight(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move probabilities to 0 or 1 while sum(pi) and sum(pi * size) stay; at most two stay fractional."""
    pi = list(pi)
    todo = iter([k for k, p in enumerate(pi) if _EPS < p < 1 - _EPS])
    for k, p in enumerate(pi):
        if not _EPS < p < 1 - _EPS:
            pi[k] = float(round(p))
    work: list[int] = []
    while True:
        while len(work) < 3:
            k = next(todo, None)
            if k is None:
                break
            work.append(k)
        if len(work) < 2:
            return pi
        if len(work) == 3:
            a, b, c = (size[k] for k in work)
            u = [b - c, c - a, a - b]
            if a == b:
                u = [1.0, -1.0, 0.0]
        elif size[work[0]] == size[work[1]]:
            u = [1.0, -1.0]
        else:
            return pi
        _move(pi, work, u, rng)
        work = [k for k in work if 0.0 < pi[k] < 1.0]


def _move(pi: list[float], work: list[int], u: list[float], rng: random.Random) -> None:
    """One step along u, up or down at random so that each expectation stays, to where a unit is decided."""
    up = min((1 - pi[k]) / v if v > 0 else pi[k] / -v for k, v in zip(work, u) if v)
    down = min(pi[k] / v if v > 0 else (1 - pi[k]) / -v for k, v in zip(work, u) if v)
    step = up if rng.random() * (up + down) < down else -down
    for k, v in zip(work, u):
        p = pi[k] + step * v
        pi[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def landing(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Decide what the flight left: keep the word total as long as two units are open, then draw."""
    pi = list(pi)
    while True:
        work = [k for k, p in enumerate(pi) if 0.0 < p < 1.0]
        if not work:
            return pi
        if len(work) == 1:
            pi[work[0]] = float(rng.random() < pi[work[0]])
            return pi
        pair = work[:2]
        a, b = size[pair[0]], size[pair[1]]
        _move(pi, pair, [b, -a] if a and b else [0.0, 1.0] if a else [1.0, 0.0], rng)


def repair(taken: list[float], pi: list[float], size: list[float], rounds: int = 3) -> list[float]:
    """Undo the landing's error in words: add, drop or exchange the units that bring the total closest to its expectation."""
    x, s = np.array(taken), np.array(size)
    error = float(((x - np.array(pi)) * s).sum())
    for _ in range(rounds):
        out = np.flatnonzero(x == 0)
        out = out[np.argsort(s[out], kind="stable")]
        used = np.flatnonzero(x == 1)
        # Nothing (-1) may stand on either side of an exchange.
        sizes_out = np.concatenate([[0.0], s[out]])
        names_out = np.concatenate([[-1], out])
        sizes_in, names_in = np.concatenate([[0.0], s[used]]), np.concatenate([[-1], used])
        at = np.searchsorted(sizes_out, sizes_in - error)
        best = (abs(error), -1, -1)
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(sizes_out) - 1)):
            left = np.abs(error + sizes_out[near] - sizes_in)
            k = int(left.argmin())
            if left[k] < best[0] - 1e-6:
                best = (float(left[k]), int(names_in[k]), int(names_out[near[k]]))
        if best[1] < 0 and best[2] < 0:
            break
        error += (s[best[2]] if best[2] >= 0 else 0.0) - (s[best[1]] if best[1] >= 0 else 0.0)
        if best[1] >= 0:
            x[best[1]] = 0.0
        if best[2] >= 0:
            x[best[2]] = 1.0
    return x.tolist()


def _fly(group: pa.Table, last: bool) -> pa.Table:
    group = group.sort_by([("size", "descending"), ("h", "ascending")])
    rng = random.Random(f"{group.column('block')[0]}/{group.column('h')[0]}/{len(group)}")
    size = [float(x) for x in group.column("size").to_pylist()]
    before = group.column("pi").to_pylist()
    pi = flight(before, size, rng)
    if last:
        pi = repair(landing(pi, size, rng), before, size)
    return group.set_column(group.column_names.index("pi"), "pi", pa.array(pi, pa.float64()))


def _flyer(last: bool):
    def run(group: pa.Table) -> pa.Table:
        return _fly(group, last)

    return run


def cube(units: DataFrame, largest: int) -> DataFrame:
    """``units`` (source, size, h, pi, ...) with ``pi`` moved to 0 or 1; ``largest``: most units in one source."""
    level, done = 0, None
    open_units = units.withColumn("block", F.lit(0).cast("long"))
    while True:
        blocks = max(1, math.ceil(largest / BLOCK))
        last = blocks == 1
        # As many blocks as the source's own size asks for at the first level, afterwards as its leftovers can need.
        per_source = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(BLOCK) * (BLOCK / 4) ** level))).cast("long")
        placed = open_units.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), per_source))
        kind = placed.schema

        flown = placed.groupBy("source", "block").applyInArrow(_flyer(last), kind)
        if last:
            return flown if done is None else done.unionByName(flown)
        flown = save(flown, f"flight-{level}")
        settled = flown.filter("pi = 0 or pi = 1")
        done = settled if done is None else done.unionByName(settled)
        open_units = flown.filter("pi > 0 and pi < 1")
        largest = math.ceil(largest / (BLOCK / 4))
        level += 1


def repeated(df: DataFrame, times: str, number: str, parts: bool) -> DataFrame:
    """Each row of ``df`` ``times`` times, numbered from 1 by the new column ``number``. ``parts``: some rows stand for more than
    PART; these are cut into parts, which go to tasks of their own."""

    def spread(rows: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
        return rows.select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias(name))

    if not parts:
        return spread(df.filter(F.col(times) > 0), number, F.lit(1), F.col(times))
    few = spread(df.filter((F.col(times) > 0) & (F.col(times) <= PART)), number, F.lit(1), F.col(times))
    cut = spread(df.filter(F.col(times) > PART), "__part", F.lit(0), F.floor((F.col(times) - 1) / PART)).repartition("__part", times)
    many = spread(cut, number, F.col("__part") * PART + 1, F.least((F.col("__part") + 1) * PART, F.col(times)))
    return few.unionByName(many.drop("__part"))


def _units(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, c), saved."""
    return save(sized.groupBy("doc_id", "source", "size").agg(F.sum("m").alias("c")), "units")


def mix_units(units: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(doc_id, source, size, c, source_size, target, total): ``total`` entries for the c rows that agree in doc_id, source and size."""
    small_batches(units.sparkSession)
    by_source = save(targets(units, weights), "targets")
    n_sources, n_units = by_source.count(), units.count()
    if n_sources <= FEW_SOURCES:
        side = F.broadcast(by_source.withColumnRenamed("source", "__source"))
        placed = units.join(side, units["source"].eqNullSafe(side["__source"]), "left").drop("__source")
    else:
        placed = join_keyed(units, by_source, "source", counts=by_source.select("source", "n"), total=n_units)
    largest = by_source.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.when(F.col("size") > 0, ratio * F.col("c")).otherwise(0.0)
    near = F.round(expected)
    expected = F.when(F.abs(expected - near) < 1e-9, near).otherwise(expected)
    placed = placed.withColumn("sure", F.floor(expected).cast("long")).withColumn("pi", expected - F.floor(expected)).withColumn("h", F.xxhash64("doc_id", "source", "size"))
    settled = placed.filter("pi = 0").withColumn("block", F.lit(0).cast("long"))
    flown = cube(placed.filter("pi > 0"), largest)
    return settled.unionByName(flown).select("doc_id", "source", "size", "c", "source_size", "target", (F.col("sure") + F.round("pi").cast("long")).alias("total"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, source, text)."""
    units = _units(docs.select("doc_id", "source", words().alias("size"), F.lit(1).cast("long").alias("m")))
    mixed, parts = mix_units(units, weights), units.filter(F.col("c") > PART).limit(1).count() > 0
    rows = repeated(save(mixed, "mixed-units") if parts else mixed, "c", "k", parts)
    copies = F.floor(F.col("total") / F.col("c")) + (F.col("k") <= F.col("total") % F.col("c")).cast("long")
    return rows.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (copies * F.col("size")).cast("long").alias("taken"))


def shares(contents: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(MARKS, m, times) from (doc_id, source, size, MARKS, m): how often the m rows with these marks are taken, together.

    A unit's entries are dealt evenly to its rows and what is left goes to the first ones by their marks. Units with many distinct
    rows are ranked in parts: sums of the parts before, then within the part.
    """
    unit = ["doc_id", "source", "size"]
    key = [F.xxhash64(*[c.isNull().cast("int") for c in map(F.col, unit)], *unit).alias("u1"), F.xxhash64(F.lit("second"), *[c.isNull().cast("int") for c in map(F.col, unit)], *unit).alias("u2")]
    contents = save(contents.select("*", *key), "contents")
    units = save(contents.groupBy(*unit, "u1", "u2").agg(F.sum("m").alias("c"), F.count("*").alias("kinds")), "units")
    totals = mix_units(units.select(*unit, "c"), weights).filter("total > 0").select(*key, "c", "total")
    rows = contents.select("u1", "u2", *MARKS, "m").join(totals, ["u1", "u2"])
    several = units.filter("kinds > 1").select("u1", "u2", "kinds")
    if not several.limit(1).count():
        return rows.select(*MARKS, "m", F.col("total").alias("times"))
    rows = save(rows.join(several, ["u1", "u2"], "left"), "entries")
    alone = rows.filter("kinds is null").select(*MARKS, "m", F.col("total").alias("times"))
    parts = rows.filter("kinds is not null").withColumn("part", F.pmod("mark1", F.ceil(F.col("kinds") / RANKED)))
    sums = parts.groupBy("u1", "u2", "part").agg(F.sum("m").alias("s"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("s").over(Window.partitionBy("u1", "u2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = F.coalesce(F.sum("m").over(Window.partitionBy("u1", "u2", "part").orderBy(*MARKS).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumn("within", within).join(sums, ["u1", "u2", "part"])
    left = F.greatest(F.lit(0), F.least(F.col("m"), F.col("total") % F.col("c") - F.col("ahead") - F.col("within")))
    return alone.unionByName(ranked.select(*MARKS, "m", (F.floor(F.col("total") / F.col("c")) * F.col("m") + left).cast("long").alias("times")).filter("times > 0"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns kept. Rows without words are not taken.

    The texts are read twice, once to count their words and once to write them out; between, only hashes of rows move. How often a
    row is taken (24 bytes) is broadcast while no more than ``broadcast_rows`` rows are; beyond, the same join shuffles.
    """
    sized = marked(docs, "doc_id", "source", words().alias("size")).drop("row")
    contents = sized.groupBy("doc_id", "source", "size", *MARKS).agg(F.count("*").alias("m"))
    taken = save(shares(contents, weights), "taken")
    once, again = split_repeats(marked(docs), taken.filter("m > 1").select(*MARKS), broadcast_rows)
    rows = once if again is None else once.unionByName(again)
    taken = taken.select(*MARKS, "times")
    joined = rows.join(F.broadcast(taken) if taken.count() <= broadcast_rows else taken, list(MARKS))
    return repeated(joined, "times", "k", taken.filter(F.col("times") > PART).limit(1).count() > 0).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def waterfill(sizes: Iterable[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Targets by the rule itself, for small tables and tests."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size = dict(order)
    budget, free, out = sum(size.values()) * SHARE[0] / SHARE[1], set(size), {}
    while free:
        unit = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * size[s]}
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 2.0 * size[s]
            budget -= out[s]
        free -= over
    return out
