"""The filter language: nested lists such as ``["and", [">", "price", 0], ["isin", "kind", ["a", "b"]]]`` as boolean Columns.

A bare string value names a column, ``str:x`` is the text ``x``. Ordered comparisons of numeric columns read null as 0;
every other comparison with null is false (``!=`` and ``notin``: true). NaN counts as null. Catalyst folds, pushes down
and orders the result like any other predicate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "xor": lambda a, b: a != b,
    "nand": lambda a, b: ~(a & b),
    "nor": lambda a, b: ~(a | b),
    "xnor": lambda a, b: a == b,
}
ORDERED: dict[str, Callable[[Column, object], Column]] = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def resolve_name(df: DataFrame, name: str, renames: dict[str, str] | None = None) -> str | None:
    """The column that ``name`` means: itself, or what it was renamed from or to (``renames``: old to new)."""
    back = {new: old for old, new in (renames or {}).items()}
    return next((c for c in (name, back.get(name), (renames or {}).get(name)) if c is not None and c in df.columns), None)


def text_of(value):
    """A literal without its ``str:`` mark; lists item by item."""
    if isinstance(value, list):
        return [text_of(v) for v in value]
    return value[4:] if isinstance(value, str) and value.startswith("str:") else value


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


sure = _sure


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def without_nan(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def _any(c: Column, patterns, prefix: str = "") -> Column:
    each = patterns if isinstance(patterns, list) else [patterns]
    return _sure(reduce(lambda a, b: a | b, [c.rlike(prefix + str(p)) for p in each]))


def condition(df: DataFrame, f: list, renames: dict[str, str] | None = None, exact: bool = True) -> Column:
    """The filter ``f`` as a boolean Column over ``df``; an empty filter holds nowhere.

    With ``exact`` it is never null. Without, it may be null instead of false, which is the same to ``where``, and plain
    comparisons are left as they are, so that they reach the scan.
    """
    sure = _sure if exact else lambda c: c
    if not f:
        return F.lit(False)
    op, *rest = f
    if op == "not":
        if len(rest) != 1:
            raise ValueError("'not' takes exactly one filter")
        return ~condition(df, rest[0], renames)
    if op in FOLDS:
        if not rest:
            raise ValueError(f"'{op}' needs at least one filter")
        # the pairs are folded from the left, so the negated ones negate each pair, not the whole
        return reduce(FOLDS[op], [condition(df, r, renames, exact or op not in ("and", "or")) for r in rest])
    name = resolve_name(df, rest[0], renames)
    if name is None:
        raise ValueError(f"no column {rest[0]!r}")
    c = without_nan(df, name)
    value = rest[1] if len(rest) > 1 else None
    if isinstance(value, str):
        if value.startswith("str:"):
            value = value[4:]
        elif (other := resolve_name(df, value, renames)) is not None:
            value = without_nan(df, other)
        else:
            raise ValueError(f"no column {value!r}; write 'str:{value}' for the text")
    blank = c.isNull() | (F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "") == "")
    if op in ORDERED:
        if is_numeric(df, name) and isinstance(value, (int, float)):
            raw = F.col(f"`{name}`")
            plain = ORDERED[op](raw, value)
            nan = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
            if ORDERED[op](0, value):
                return sure(plain) | (raw.isNull() | F.isnan(raw) if nan else raw.isNull())
            return sure(plain & ~F.isnan(raw) if nan and op in (">", ">=") else plain)
        return sure(ORDERED[op](F.coalesce(c, F.lit(0)) if is_numeric(df, name) else c, value))
    if op == "==":
        return sure(F.col(f"`{name}`") == value if not isinstance(value, Column) else c == value)
    if op == "!=":
        return ~_sure(c == value)
    if op in ("isin", "notin"):
        inside = (sure if op == "isin" else _sure)(c.isin(text_of(value))) if value else F.lit(False)
        return inside if op == "isin" else ~inside
    if op == "isempty":
        return blank
    if op in ("iszero", "iszeroempty"):
        zero = _sure(c == 0) if is_numeric(df, name) else F.lit(False)
        return zero if op == "iszero" else zero | blank
    if op == "contains":
        return _any(c, value)
    if op == "contains_case_insensitive":
        return _any(c, text_of(value), "(?i)")
    raise ValueError(f"unknown filter {op!r}")


def select(df: DataFrame, f: list, renames: dict[str, str] | None = None) -> DataFrame:
    """The rows for which ``f`` holds."""
    return df.where(condition(df, f, renames, exact=False))


def validate(f: list) -> bool:
    """Whether operators and value types fit; raises ValueError if not."""
    op = f[0]
    if op == "not" or op in FOLDS:
        return all(validate(x) for x in f[1:])
    value = f[2] if len(f) > 2 else None
    want = {">": (int, float), "<": (int, float), ">=": (int, float), "<=": (int, float), "isin": list, "notin": list, "contains": str}.get(op)
    if want is not None and not isinstance(value, want):
        raise ValueError(f"{op!r} can't take {value!r}")
    return True
