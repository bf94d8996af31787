"""The SQL dialect.

    [explain] select [distinct] [* | column [alias], ...] from collection
        [where comparison {and | or} ...] [order by column [asc | desc[ending]]] [skip n] [take n] [into file]
    count from collection [where ...] [take n]
    delete from collection [where ...]

``and`` binds tighter than ``or``; there are no parentheses but those after ``in``. Values need no quotes, keywords and names no
particular case. ``like`` knows one wildcard, %, at either end. Clauses after ``where`` may come in any order.
"""

from __future__ import annotations

import re
from dataclasses import replace

from ..errors import BindError, ParseError
from ..functions.values import bind, unquote
from ..schema import CollectionSchema, Field
from . import query as Q

_TOKEN = re.compile(r"""\s*(?:('(?:\\.|[^'\\])*')|("(?:\\.|[^"\\])*")|(<>|!=|>=|<=|==|=|<|>)|([(),])|([^\s'"<>=!(),]+))""")
_COMPARE = {"=": Q.EQ, "==": Q.EQ, "<>": Q.NE, "!=": Q.NE, "<": Q.LT, "<=": Q.LE, ">": Q.GT, ">=": Q.GE}
_CLAUSES = ("from", "where", "order", "take", "skip", "into")


class Token(str):
    """A token's text, with where it stood and whether it was quoted."""

    quoted: bool
    at: int
    end: int

    @property
    def low(self) -> str:
        return "" if self.quoted else self.lower()


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    stripped = text.rstrip()
    while at < len(stripped):
        m = _TOKEN.match(stripped, at)
        if not m:
            raise ParseError(f"cannot read: {stripped[at:at + 20]!r}")
        body = next(g for g in m.groups() if g is not None)
        t = Token(body)
        t.quoted, t.at, t.end = body[0] in "'\"", m.end() - len(body), m.end()
        out.append(t)
        at = m.end()
    return out


def _split(tokens: list[Token], word: str) -> list[list[Token]]:
    parts: list[list[Token]] = [[]]
    for t in tokens:
        if t.low == word:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


class _Text:
    """The statement's text, to give back values as they were written."""

    def __init__(self, sql: str):
        self.sql = sql

    def of(self, tokens: list[Token]) -> str:
        """Adjacent tokens as one value; blanks between unquoted words count as one."""
        if not tokens:
            raise ParseError("a value is missing")
        if len(tokens) == 1:
            return str(tokens[0])
        out = str(tokens[0])
        for a, b in zip(tokens, tokens[1:]):
            out += (" " if b.at > a.end else "") + str(b)
        return out

    def listed(self, tokens: list[Token]) -> list[str]:
        """A list of values, with or without parentheses; a comma inside a token is no separator only in quotes."""
        if tokens and tokens[0] == "(":
            if tokens[-1] != ")":
                raise ParseError("a parenthesis isn't closed")
            tokens = tokens[1:-1]
        if any(t in "()" and not t.quoted for t in tokens):
            raise ParseError("parentheses are only allowed around a list")
        parts: list[list[Token]] = [[]]
        for t in tokens:
            if t == "," and not t.quoted:
                parts.append([])
            else:
                parts[-1].append(t)
        return [self.of(p) for p in parts]


def _name(tokens: list[Token], what: str) -> str:
    if len(tokens) != 1:
        raise ParseError(f"{what}: one name is expected, not {' '.join(tokens)!r}")
    return unquote(tokens[0])


def _comparison(tokens: list[Token], text: _Text, schema: CollectionSchema) -> Q.Atom:
    words = [t.low for t in tokens]
    for k, t in enumerate(tokens):
        op = None if t.quoted else _COMPARE.get(t)
        if op is None:
            continue
        left, right = tokens[:k], tokens[k + 1 :]
        if any(not x.quoted and x in _COMPARE for x in right):
            raise ParseError(f"two comparisons without and: {' '.join(tokens)!r}")
        if len(left) == 1 and not left[0].quoted and schema.find(left[0]):
            field, value = schema[left[0]], right
        elif len(right) == 1 and not right[0].quoted and schema.find(right[0]):
            field, value, op = schema[right[0]], left, Q.FLIPPED[op]
        elif len(left) != 1:
            raise ParseError(f"no column stands before {t}: {' '.join(left)!r}")
        else:
            field, value = schema[unquote(left[0])], right
        return Q.Atom(field.name, op, (_bound(_value(value, text, field), field),))
    at = next((k for k, w in enumerate(words) if w in ("in", "contains", "like")), None)
    if at is None:
        raise ParseError(f"no operator in {' '.join(tokens)!r}")
    negative = at > 0 and words[at - 1] == "not"
    field = schema[_name(tokens[: at - negative], "left of " + words[at])]
    rest = tokens[at + 1 :]
    if words[at] == "in":
        values = tuple(_bound(v, field) for v in text.listed(rest))
        return Q.Atom(field.name, Q.NOT_IN if negative else Q.IN, values)
    if words[at] == "contains":
        return Q.Atom(field.name, Q.NOT_CONTAINS if negative else Q.CONTAINS, (_bound(_value(rest, text, field), field),))
    pattern = unquote(text.of(rest))
    return like(field, pattern, negative)


def like(field: Field, pattern: str, negative: bool = False) -> Q.Atom:
    """% at the ends is the only wildcard; without one the pattern is an error."""
    start, end = pattern.startswith("%"), len(pattern) > 1 and pattern.endswith("%")
    if not (start or end):
        raise ParseError(f"like needs % at one end: {pattern!r}")
    op = Q.HOLDS if start and end else Q.ENDS if start else Q.STARTS
    value = pattern[int(start) : len(pattern) - int(end)]
    atom = Q.Atom(field.name, op, (value,))
    return atom.negated() if negative else atom


def _value(tokens: list[Token], text: _Text, field: Field) -> str:
    """One value; a decimal comma joins the number around it."""
    if len(tokens) == 3 and tokens[1] == "," and not any(t.quoted for t in tokens):
        return f"{tokens[0]},{tokens[2]}"
    if any(not t.quoted and t in "()," for t in tokens):
        raise ParseError(f"one value is expected for {field.name}: {' '.join(tokens)!r}")
    return text.of(tokens)


def _bound(value: str, field: Field):
    return bind(value, field.scalar, field.name)


def _number(tokens: list[Token], what: str) -> int:
    if len(tokens) != 1 or not tokens[0].isdigit():
        raise ParseError(f"{what}: a whole number is expected")
    return int(tokens[0])


def collection_of(sql: str) -> str:
    """The name of the collection that a statement is about."""
    tokens = tokenize(sql)
    at = next((k for k, t in enumerate(tokens) if t.low == "from"), None)
    if at is None or at + 1 >= len(tokens):
        raise ParseError("from and a collection are expected")
    return unquote(tokens[at + 1])


def parse(sql: str, schema: CollectionSchema) -> Q.Query:
    """The statement as a query over ``schema``'s columns."""
    tokens = tokenize(sql)
    if not tokens:
        raise ParseError("the statement is empty")
    text = _Text(sql)
    explain = tokens[0].low == "explain"
    tokens = tokens[explain:]
    verb = tokens[0].low if tokens else ""
    if verb not in ("select", "count", "delete"):
        raise ParseError(f"select, count or delete is expected, not {tokens[0] if tokens else 'nothing'!r}")
    clauses: dict[str, list[Token]] = {"head": []}
    now = "head"
    for k, t in enumerate(tokens[1:], 1):
        starts = t.low in _CLAUSES and (t.low != "order" or k + 1 < len(tokens) and tokens[k + 1].low == "by")
        if starts and (t.low == "from" or "from" in clauses):
            if t.low in clauses:
                raise ParseError(f"{t.low} stands twice")
            now = t.low
            clauses[now] = []
        else:
            clauses[now].append(t)
    if "from" not in clauses:
        raise ParseError("from is missing")
    name = _name(clauses["from"], "from")
    if name.lower() != schema.name.lower():
        raise BindError(f"{name} is not {schema.name}")
    out = Q.Query(schema.name, verb=verb, count=verb == "count", explain=explain)
    head = clauses["head"]
    if verb != "select" and head:
        raise ParseError(f"{verb} takes no columns")
    if head and head[0].low == "distinct":
        out, head = replace(out, distinct=True), head[1:]
    if head and not (len(head) == 1 and head[0] == "*"):
        columns = []
        for part in _split_commas(head):
            if not 1 <= len(part) <= 2:
                raise ParseError(f"a column and at most an alias: {' '.join(part)!r}")
            field = schema[unquote(part[0])]
            columns.append((field.name, unquote(part[-1]) if len(part) == 2 else field.name))
        out = replace(out, select=tuple(columns))
    if out.distinct and not out.select:
        raise ParseError("distinct needs columns")
    if "where" in clauses:
        branches = tuple(tuple(_comparison(p, text, schema) for p in _split(b, "and")) for b in _split(clauses["where"], "or"))
        out = replace(out, branches=branches)
    if "order" in clauses:
        rest = clauses["order"][1:]
        way = rest[-1].low if len(rest) == 2 else "asc"
        if len(rest) not in (1, 2) or way not in ("asc", "ascending", "desc", "descending"):
            raise ParseError("order by takes one column and a direction")
        out = replace(out, order_by=schema[unquote(rest[0])].name, descending=way.startswith("desc"))
    if "take" in clauses:
        out = replace(out, take=_number(clauses["take"], "take"))
    if "skip" in clauses:
        out = replace(out, skip=_number(clauses["skip"], "skip"))
    if "into" in clauses:
        out = replace(out, into=unquote(text.of(clauses["into"])))
    return replace(out, take=0) if verb == "delete" else out


def _split_commas(tokens: list[Token]) -> list[list[Token]]:
    parts: list[list[Token]] = [[]]
    for t in tokens:
        if t == "," and not t.quoted:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts
