"""Tokens of full-text search, all in built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
#: A run of one class; inside letters a capital behind a small letter begins a token.
TOKEN = rf"\p{{Lu}}+{_LOW}*|{_LOW}+|\p{{Nd}}+|[^\p{{L}}\p{{Nd}}\s\p{{Z}}]+"
SYMBOL = r"^[^\p{L}\p{Nd}]+$"


def _latin() -> tuple[str, str]:
    """Letters that lose a mark when decomposed, and what is left of them."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin()


def tokens(line: Column, squeeze: bool = True) -> Column:
    """Normalised tokens of a line in order: no marks, small letters, repeated characters once.

    Tokens hold no white space, so they are joined by blanks, normalised as one string and split again: no work per token.
    """
    found = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    out = F.lower(F.translate(F.array_join(found, " "), _MARKED, _PLAIN))
    out = F.when(out.rlike(r"\p{Mn}"), F.regexp_replace(out, r"\p{Mn}", "")).otherwise(out)
    if squeeze:
        out = F.regexp_replace(out, r"(\S)\1+", "$1")
    return F.when(F.size(found) > 0, F.split(out, " ")).otherwise(F.array().cast("array<string>"))


def normalize_text(token: str, squeeze: bool = True) -> str:
    """The same on the driver."""
    table = str.maketrans(_MARKED, _PLAIN)
    out = "".join(c for c in token.translate(table) if unicodedata.category(c) != "Mn").lower()
    if squeeze:
        out = "".join(c for k, c in enumerate(out) if not k or c != out[k - 1])
    return out


def split_text(line: str) -> list[str]:
    """Raw tokens of a line on the driver."""
    import regex

    return regex.findall(TOKEN, line)


def is_symbol(token: str) -> bool:
    return not any(c.isalpha() or c.isdigit() for c in token)
