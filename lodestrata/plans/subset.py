"""Is every row that one query selects sure to satisfy another? A sound proof on the two disjunctions, never a guess.

Each branch of the asked query must be inside one branch of the domain; a branch is inside when each of the domain's comparisons
follows from one comparison (or the intersection of bounds) on the same column.
"""

from __future__ import annotations

from . import query as Q
from .query import Atom, Query

_LOW, _HIGH = (Q.GT, Q.GE), (Q.LT, Q.LE)


def _bounds(atoms: list[Atom]) -> tuple:
    """(low, low closed, high, high closed) that the comparisons leave; None for an open end. A closed low end shuts nulls out."""
    low = high = None
    low_closed = high_closed = True
    for a in atoms:
        parts = zip(Q.RANGES[a.op], a.values) if a.op in Q.RANGES else [(a.op, a.value)] if a.op in (*_LOW, *_HIGH) else [(Q.GE, a.value), (Q.LE, a.value)] if a.op == Q.EQ else []
        for op, v in parts:
            if v is None:
                continue
            if op in _LOW and (low is None or v > low or v == low and op == Q.GT):
                low, low_closed = v, op == Q.GE
            if op in _HIGH and (high is None or v < high or v == high and op == Q.LT):
                high, high_closed = v, op == Q.LE
    return low, low_closed, high, high_closed


def _values(atoms: list[Atom]) -> set | None:
    """The only values possible, when there are some such comparisons."""
    out = None
    for a in atoms:
        if a.op in (Q.EQ, Q.IN):
            out = set(a.values) if out is None else out & set(a.values)
    return out


def implies(atoms: list[Atom], goal: Atom) -> bool:
    """Does the conjunction of ``atoms`` (all on the goal's column) force ``goal``?"""
    from ..functions.predicates import holds

    if goal in atoms:
        return True
    known = _values(atoms)
    if known is not None and goal.op not in (Q.CONTAINS, Q.NOT_CONTAINS):
        return all(holds(goal, {goal.column: v}) for v in known)
    base = goal.op.removeprefix("not ")
    if goal.op in (Q.STARTS, Q.ENDS, Q.HOLDS):
        v = goal.value.lower()
        for a in atoms:
            if a.op not in (Q.STARTS, Q.ENDS, Q.HOLDS):
                continue
            w = a.value.lower()
            if goal.op == Q.HOLDS and v in w or goal.op == Q.STARTS == a.op and w.startswith(v) or goal.op == Q.ENDS == a.op and w.endswith(v):
                return True
        return False
    if base in (Q.STARTS, Q.ENDS, Q.HOLDS):
        return False
    if goal.op == Q.IN or goal.op == Q.EQ or goal.op in (Q.CONTAINS, Q.NOT_CONTAINS):
        return False
    out_of = {v for a in atoms if a.op in (Q.NE, Q.NOT_IN) for v in a.values}
    low, low_closed, high, high_closed = _bounds(atoms)

    def outside(v) -> bool:
        if v in out_of:
            return True
        if v is None:
            return low is not None
        return low is not None and (v < low or v == low and not low_closed) or high is not None and (v > high or v == high and not high_closed)

    if goal.op in (Q.NE, Q.NOT_IN):
        return all(outside(v) for v in goal.values)
    parts = list(zip(Q.RANGES[goal.op], goal.values)) if goal.op in Q.RANGES else [(goal.op, goal.value)]
    for op, v in parts:
        if v is None:
            ok = op == Q.GE or op == Q.GT and (low is not None or None in out_of)
        elif op in _LOW:
            ok = low is not None and (low > v or low == v and (op == Q.GE or not low_closed))
        else:
            ok = high is not None and (high < v or high == v and (op == Q.LE or not high_closed))
        if not ok:
            return False
    return True


def inside(branch: tuple[Atom, ...], domain: tuple[Atom, ...]) -> bool:
    return all(implies([a for a in branch if a.column == goal.column], goal) for goal in domain)


def is_subset(asked: Query, domain: Query) -> bool:
    """True only if the domain holds every row that ``asked`` selects."""
    if domain.unconditional:
        return True
    if asked.unconditional:
        return False
    return all(any(inside(b, d) for d in domain.branches) for b in asked.branches)
