"""Hierarchical pivots: rows are summed up by all axes once, then the few groups are rolled up; sums are exact decimals."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError, EngineError
from ..schema import CollectionSchema

LEVEL = "level"  # number of axes that a row is grouped by


def pivot(df: DataFrame, schema: CollectionSchema, axes: Iterable[str], values: Iterable[str], scale: int = 10, strict: bool = True) -> DataFrame:
    """One row per group of each level: level, the axes, count and ``sum_<value>`` as decimal(38, ``scale``).

    A null axis value is a group of its own, told from a subtotal by ``level``. ``strict``: a null value to sum is an error, found
    in the same pass.
    """
    axes, values = [schema[a] for a in axes], [schema[v] for v in values]
    if not values:
        raise BindError("a pivot needs a value to aggregate")
    for f in axes:
        if f.is_collection:
            raise BindError(f"{f.name}: a collection cannot be an axis")
    for f in values:
        if f.is_collection or not isinstance(f.type, T.NumericType):
            raise BindError(f"{f.name}: only numbers can be summed")
    kind = T.DecimalType(28, scale)
    sums = []
    for f in values:
        c = F.col(f"`{f.name}`").cast(kind)
        if strict:
            c = F.when(F.col(f"`{f.name}`").isNull(), F.raise_error(F.lit(f"{f.name} is null in a pivot"))).otherwise(c)
        sums.append(F.sum(c).alias(f"sum_{f.name}"))
    names = [f.name for f in axes]
    if not names:
        out = df.agg(F.count("*").alias("count"), *sums)
        return out.select(F.lit(0).alias(LEVEL), "count", *[f"sum_{f.name}" for f in values])
    keys = [F.col(f"`{n}`") for n in names]
    groups = df.groupBy(*keys).agg(F.count("*").alias("count"), *sums)
    # grouping_id has a bit for each axis that is rolled up; the ones stand on the right.
    level = F.lit(len(names)) - F.bit_count(F.grouping_id())
    whole = T.DecimalType(38, scale)
    upper = [F.sum(f"`sum_{f.name}`").cast(whole).alias(f"sum_{f.name}") for f in values]
    rolled = groups.rollup(*keys).agg(level.cast("int").alias(LEVEL), F.sum("count").alias("count"), *upper)
    return rolled.select(LEVEL, *keys, F.coalesce("count", F.lit(0)).alias("count"), *[f"sum_{f.name}" for f in values])


@dataclass
class Node:
    """A group of the tree."""

    axis: str | None
    value: object
    count: int
    sums: dict[str, Decimal]
    children: dict[object, Node] = field(default_factory=dict)

    def check(self) -> None:
        """Children add up to their parent, at every level."""
        if not self.children:
            return
        kids = self.children.values()
        if sum(k.count for k in kids) != self.count:
            raise EngineError(f"{self.axis}={self.value}: counts differ")
        for name, total in self.sums.items():
            if sum((k.sums[name] for k in kids), Decimal(0)) != total:
                raise EngineError(f"{self.axis}={self.value}: sums of {name} differ")
        for k in kids:
            k.check()

    def merge(self, other: Node) -> None:
        """Add another part's tree to this one."""
        self.count += other.count
        for name, value in other.sums.items():
            self.sums[name] = self.sums.get(name, Decimal(0)) + value
        for key, child in other.children.items():
            if key in self.children:
                self.children[key].merge(child)
            else:
                self.children[key] = child

    def __str__(self) -> str:
        return "\n".join(self._lines(0))

    def _lines(self, depth: int) -> list[str]:
        title = "total" if self.axis is None else f"{self.axis} = {self.value}"
        sums = ", ".join(f"{n} = {s.normalize():f}" for n, s in self.sums.items())
        out = ["    " * depth + f"{title}: count = {self.count}" + f", {sums}" * bool(sums)]
        for _, child in sorted(self.children.items(), key=lambda x: (x[0] is not None, str(x[0]))):
            out += child._lines(depth + 1)
        return out


def tree(pivoted: DataFrame) -> Node:
    """The result as a tree on the driver; its size is that of the report, not of the data."""
    value_names = [c for c in pivoted.columns if c.startswith("sum_")]
    axes = [c for c in pivoted.columns if c not in (LEVEL, "count", *value_names)]
    rows = sorted((r.asDict() for r in pivoted.toLocalIterator()), key=lambda r: r[LEVEL])
    zero = {c[4:]: Decimal(0) for c in value_names}
    root = Node(None, None, 0, zero)
    for r in rows:
        sums = {c[4:]: r[c] if r[c] is not None else Decimal(0) for c in value_names}
        if r[LEVEL] == 0:
            root.count, root.sums = r["count"], sums
            continue
        at = root
        for a in axes[: r[LEVEL] - 1]:
            at = at.children[r[a]]
        axis = axes[r[LEVEL] - 1]
        at.children[r[axis]] = Node(axis, r[axis], r["count"], sums)
    return root
