"""Literals of the dialect: how a token becomes a value, alone or bound to a column's type."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from ..errors import BindError

_DATE = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})[/-](\d{1,2})[/-](\d{4})")
_CLOCK = re.compile(r"[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,7}))?)?\s*(Z|[+-]\d{2}:?\d{2})?$")
UTC = dt.timezone.utc


def parse_date(text: str, us: bool = False) -> dt.datetime | None:
    """``yyyy-MM-dd`` or ``dd/MM/yyyy`` or ``dd-MM-yyyy`` (months first if ``us``), with or without a time; naive means UTC."""
    text = text.strip()
    head = _DATE.match(text)
    if not head:
        return None
    if head[1]:
        year, month, day = int(head[1]), int(head[2]), int(head[3])
    else:
        a, b, year = int(head[4]), int(head[5]), int(head[6])
        month, day = (a, b) if us else (b, a)
    rest, clock, zone = text[head.end() :], (0, 0, 0, 0), None
    if rest:
        tail = _CLOCK.match(rest)
        if not tail:
            return None
        clock = int(tail[1]), int(tail[2]), int(tail[3] or 0), int((tail[4] or "0").ljust(6, "0")[:6])
        zone = tail[5]
    try:
        out = dt.datetime(year, month, day, *clock)
    except ValueError:
        return None
    if zone and zone != "Z":
        sign = -1 if zone[0] == "-" else 1
        out -= sign * dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
    return out


def unquote(text: str) -> str:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1]
    return text.replace("\\'", "'")


def guess(text: str):
    """The value of a token without knowing the column: null, boolean, date, number, else text."""
    raw = text.strip()
    quoted = raw[:1] in ("'", '"')
    if quoted:
        return unquote(raw)
    low = raw.lower()
    if low == "null":
        return None
    if low in ("true", "false"):
        return low == "true"
    if raw[:1].isalpha():
        return raw
    if "-" in raw[1:] or "/" in raw:
        return parse_date(raw) or raw
    if "." in raw or "," in raw:
        if raw.count(",") > 1:
            raise BindError(f"{raw}: a number has one decimal comma at most")
        try:
            return float(raw.replace(",", "."))
        except ValueError:
            return raw
    try:
        return int(raw)
    except ValueError:
        return raw


def bind(value, kind: T.DataType, column: str = "value"):
    """``value`` (a token or a Python value) as a value of ``kind``; None stays None."""
    if value is None:
        return None
    if isinstance(value, str):
        quoted = value.strip()[:1] in ("'", '"')
        plain = unquote(value)
        if not quoted and plain.strip().lower() == "null":
            return None
        if isinstance(kind, T.StringType):
            return plain
        return _from_text(plain.strip(), kind, column)
    return _from_python(value, kind, column)


def _wrong(value, kind: T.DataType, column: str) -> BindError:
    return BindError(f"{column}: {value!r} is not a {kind.simpleString()}")


def _from_text(text: str, kind: T.DataType, column: str):
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False, "1": True, "0": False}[text.lower()]
        if isinstance(kind, T.IntegralType):
            try:
                return int(text)
            except ValueError:
                number = float(_decimal_comma(text))
                return int(number) if number.is_integer() else number
        if isinstance(kind, T.FractionalType):
            if isinstance(kind, T.DecimalType):
                return Decimal(_decimal_comma(text))
            return float(_decimal_comma(text))
    except (KeyError, ValueError, InvalidOperation):
        raise _wrong(text, kind, column) from None
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        moment = parse_date(text)
        if moment is None:
            raise _wrong(text, kind, column)
        return moment.date() if isinstance(kind, T.DateType) else moment if isinstance(kind, T.TimestampNTZType) else moment.replace(tzinfo=UTC)
    raise _wrong(text, kind, column)


def _decimal_comma(text: str) -> str:
    if text.count(",") > 1:
        raise ValueError(text)
    return text.replace(",", ".")


def _from_python(value, kind: T.DataType, column: str):
    if isinstance(kind, T.StringType):
        raise _wrong(value, kind, column)
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
    elif isinstance(kind, T.NumericType):
        if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
            if isinstance(kind, T.DecimalType):
                return value if isinstance(value, Decimal) else Decimal(str(value))
            return value
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, dt.datetime):
            if isinstance(kind, T.DateType):
                return value.date()
            aware = value if value.tzinfo else value.replace(tzinfo=UTC)
            return aware if isinstance(kind, T.TimestampType) else aware.astimezone(UTC).replace(tzinfo=None)
        if isinstance(value, dt.date):
            if isinstance(kind, T.DateType):
                return value
            return _from_python(dt.datetime(value.year, value.month, value.day), kind, column)
    raise _wrong(value, kind, column)


def show(value) -> str:
    """A value as a token that ``bind`` reads back."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        value = value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
        return value.strftime("%Y-%m-%d") if value.time() == dt.time() else value.isoformat(" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return str(value)
