"""The raw predicate of a job, and helpers for keys and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERAL = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")")
_DATE = re.compile(r"\b(DATE_SUB|DATE_ADD)\s*\(", re.IGNORECASE)


def to_spark(where: str) -> str:
    """A MySQL predicate for Spark: DATE_SUB(x, INTERVAL n u) is (x - INTERVAL n u), DATE_ADD likewise, outside of literals."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    text = _LITERAL.sub(hold, where)
    while m := _DATE.search(text):
        depth, comma, at = 1, -1, m.end()
        while at < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            if text[at] == "," and depth == 1 and comma < 0:
                comma = at
            at += 1
        inside = text[comma + 1 : at - 1].strip()
        if depth or comma < 0 or not re.match(r"INTERVAL\b", inside, re.IGNORECASE):
            # Spark's own date_sub(date, days): spelled so that it is not met again
            text = f"{text[: m.start()]}{m[1].lower().replace('_', chr(1))}{text[m.end() - 1 :]}"
            continue
        sign = "-" if m[1].upper() == "DATE_SUB" else "+"
        text = f"{text[: m.start()]}({text[m.end() : comma].strip()} {sign} {inside}){text[at:]}"
    text = text.replace("\x01", "_")
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)


def where(predicate: str | None) -> Column | None:
    """The predicate in parentheses, or None for all rows."""
    text = (predicate or "").strip()
    return None if not text or re.fullmatch(r"1\s*=\s*1", text) else F.expr(f"({to_spark(text)})")


def root_key(text: str | None, kind: T.DataType) -> int:
    """A stored root key as a number; empty, non-numeric and out-of-range ones are errors."""
    if not isinstance(kind, (T.IntegralType, T.DecimalType)) or (isinstance(kind, T.DecimalType) and kind.scale):
        raise ValueError(f"a root key must be an integer, not {kind.simpleString()}")
    if text is None or not re.fullmatch(r"[+-]?\d+", text):
        raise ValueError(f"not a root key: {text!r}")
    n = int(text)
    low, high = (-(1 << 63), (1 << 63) - 1) if isinstance(kind, T.IntegralType) else (0, (1 << 64) - 1)
    if not low <= n <= high:
        raise ValueError(f"root key out of range: {text}")
    return n


def one_line(text: str) -> str:
    return text.replace("\r", " ").replace("\n", " ")


def safe_name(text: str) -> str:
    """A name for locks and files: anything but letters, digits, _ and - becomes _."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", text)


def fold_equal(a: str, b: str) -> bool:
    """Equal but for the case of ASCII letters."""
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    return fold(a) == fold(b)


def plain_type(column_type: str) -> str:
    """A column type without the display width of integers."""
    return re.sub(r"^((?:tiny|small|medium|big)?int)\(\d+\)", r"\1", column_type.strip().lower())


def same_type(a: str, b: str) -> bool:
    return plain_type(a) == plain_type(b)
