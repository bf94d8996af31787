"""The query model: a disjunction of conjunctions of comparisons, with projection, order and bounds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import BindError
from ..functions.values import show

EQ, NE, GT, GE, LT, LE = "=", "<>", ">", ">=", "<", "<="
IN, NOT_IN, CONTAINS, NOT_CONTAINS = "in", "not in", "contains", "not contains"
STARTS, ENDS, HOLDS = "starts", "ends", "holds"  # text begins with, ends with, has inside; without regard to case
NOT_STARTS, NOT_ENDS, NOT_HOLDS = "not starts", "not ends", "not holds"
GE_LE, GE_LT, GT_LT, GT_LE = "[]", "[)", "()", "(]"

RANGES = {GE_LE: (GE, LE), GE_LT: (GE, LT), GT_LT: (GT, LT), GT_LE: (GT, LE)}
NEGATED = {EQ: NE, NE: EQ, IN: NOT_IN, NOT_IN: IN, CONTAINS: NOT_CONTAINS, NOT_CONTAINS: CONTAINS, STARTS: NOT_STARTS, NOT_STARTS: STARTS, ENDS: NOT_ENDS, NOT_ENDS: ENDS, HOLDS: NOT_HOLDS, NOT_HOLDS: HOLDS, LT: GE, GE: LT, GT: LE, LE: GT}
FLIPPED = {LT: GT, GT: LT, LE: GE, GE: LE, EQ: EQ, NE: NE}
_TEXT = {STARTS: "{}%", ENDS: "%{}", HOLDS: "%{}%"}


@dataclass(frozen=True)
class Atom:
    """One comparison; ``values`` are already of the column's type. Ranges hold (low, high)."""

    column: str
    op: str
    values: tuple

    @property
    def value(self):
        return self.values[0]

    def sql(self, shape: bool = False) -> str:
        shown = ["?" if shape else show(v) for v in self.values]
        if self.op in RANGES:
            low, high = RANGES[self.op]
            return f"{self.column} {low} {shown[0]} and {self.column} {high} {shown[1]}"
        if self.op in (IN, NOT_IN):
            return f"{self.column} {self.op} ({'?' if shape else ', '.join(shown)})"
        base = self.op.removeprefix("not ")
        if base in _TEXT:
            pattern = "?" if shape else show(_TEXT[base].format(self.value))
            return f"{self.column} {'not ' if base != self.op else ''}like {pattern}"
        return f"{self.column} {self.op} {shown[0]}"

    def negated(self) -> Atom:
        if self.op not in NEGATED:
            raise BindError(f"{self.sql()} cannot be negated")
        return replace(self, op=NEGATED[self.op])


@dataclass(frozen=True)
class Query:
    collection: str
    branches: tuple[tuple[Atom, ...], ...] = ()  # empty: everything
    select: tuple[tuple[str, str], ...] = ()  # (column, alias)
    distinct: bool = False
    order_by: str | None = None
    descending: bool = False
    take: int = 0  # 0: no bound
    skip: int = 0
    count: bool = False
    full_text: str | None = None
    only_if_complete: bool = False
    verb: str = "select"
    into: str | None = None
    explain: bool = False

    def where_sql(self, shape: bool = False) -> str:
        return " or ".join(" and ".join(a.sql(shape) for a in b) for b in self.branches if b)

    def sql(self, shape: bool = False) -> str:
        out = [self.verb if not self.count else "count"]
        if self.distinct:
            out.append("distinct")
        if self.select:
            out.append(", ".join(c if c.lower() == a.lower() else f"{c} {a}" for c, a in self.select))
        out.append(f"from {self.collection}")
        if where := self.where_sql(shape):
            out.append(f"where {where}")
        if self.order_by:
            out.append(f"order by {self.order_by}" + " descending" * self.descending)
        if self.skip:
            out.append(f"skip {self.skip}")
        if self.take:
            out.append(f"take {'?' if shape else self.take}")
        if self.into:
            out.append(f"into {self.into}")
        return " ".join(out)

    def describe(self) -> str:
        """The query as text; ``shape`` is the same with its values blanked."""
        return self.sql()

    @property
    def shape(self) -> str:
        return self.sql(True)

    @property
    def unconditional(self) -> bool:
        return not self.branches or any(not b for b in self.branches)


def conjoin(a: tuple, b: tuple) -> tuple:
    """AND of two disjunctions, distributed; an empty one is true."""
    if not a or not b:
        return a or b
    return tuple((*x, *y) for x in a for y in b)


def fuse(query: Query) -> Query:
    """Two opposite bounds on one column become one range; all other tests stay as they are."""
    out = []
    for branch in query.branches:
        lows = {}
        highs = {}
        for a in branch:
            (lows if a.op in (GT, GE) else highs if a.op in (LT, LE) else {}).setdefault(a.column, []).append(a)
        kept = list(branch)
        for column, low in lows.items():
            high = highs.get(column, [])
            if len(low) == len(high) == 1 and None not in (low[0].value, high[0].value):
                op = next(k for k, v in RANGES.items() if v == (low[0].op, high[0].op))
                at = min(kept.index(low[0]), kept.index(high[0]))
                kept = [a for a in kept if a not in (low[0], high[0])]
                kept.insert(at, Atom(column, op, (low[0].value, high[0].value)))
        out.append(tuple(kept))
    return replace(query, branches=tuple(out))
