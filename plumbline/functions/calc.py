"""The expression language: nested lists such as ``["/0", "price", ["asfloat", "area"]]`` as Columns.

A bare string names a column, ``str:x`` is the text ``x``, numbers and lists of literals stand for themselves, any other
list is an expression. Operators are kept in two tables by what they take; nothing here runs a job or leaves the JVM
except ``geo_area`` (Arrow batches).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import filters, geo

#: Texts that count as empty.
EMPTY_WORDS = ["", "none", "null", "n/a", "na", "nan", "<na>"]
#: strptime directives as date patterns.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "p": "a", "j": "DDD", "z": "xx", "a": "EEE", "A": "EEEE", "%": "%"}
#: Square metres to other units.
AREA_UNITS = {"sqm": 1.0, "sqft": 10.7639, "acres": 10.7639 / 43560, "sqkm": 1e-6, "hectares": 1e-4}


def date_pattern(strptime: str) -> str:
    """A strptime format as a date pattern; letters outside directives are quoted."""
    out, i = "", 0
    while i < len(strptime):
        ch = strptime[i]
        if ch == "%" and i + 1 < len(strptime):
            if strptime[i + 1] not in DIRECTIVES:
                raise ValueError(f"date directive %{strptime[i + 1]}")
            out += DIRECTIVES[strptime[i + 1]]
            i += 2
            continue
        out += f"'{ch}'" if ch.isalpha() else ch
        i += 1
    return out


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def divide(a: Column, b: Column) -> Column:
    """IEEE-like division: infinite over zero, but null for 0/0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf"))).otherwise(a / b)


def _extreme(pick: Callable) -> Callable:
    def run(a: Column, b: Column) -> Column:
        nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        return F.when(a.isNull() | b.isNull(), None).when(nan, float("nan")).otherwise(pick(a, b))

    return run


def _nearest(a: Column, b: Column) -> Column:
    return F.rint(F.try_divide(a.cast("double"), b.cast("double"))) * b


def _whole(f: Callable, c: Column) -> Column:
    """Floor or ceiling as a double; NaN, infinities and numbers without fraction bits stay as they are."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) >= 2.0**53), c).otherwise(f(c).cast("double"))


UNARY: dict[str, Callable[[Column], Column]] = {
    "asint": lambda c: c.try_cast("double").try_cast("bigint"),
    "asfloat": lambda c: c.try_cast("double"),
    "asstr": lambda c: c.cast("string"),
    "floor": lambda c: _whole(F.floor, c),
    "ceil": lambda c: _whole(F.ceil, c),
    "round": lambda c: F.rint(c.cast("double")),
    "abs": F.abs,
    "strip": trimmed,
    "striplzero": lambda c: F.regexp_replace(c.cast("string"), "^0+", ""),
    "stripkey": lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"\s+", ""), "^0+", ""),
    "set": lambda c: c,
    "not": lambda c: ~c,
}
NUMERIC: dict[str, Callable[[Column, Column], Column]] = {
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "min": _extreme(F.least),
    "max": _extreme(F.greatest),
    "//": lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("bigint"),
    "/0": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "round_nearest": _nearest,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "fillna": lambda a, b: F.coalesce(a, b),
}


class Compiler:
    """Compiles expressions against the columns of one data frame."""

    def __init__(self, df: DataFrame, renames: dict[str, str] | None = None):
        self.df, self.renames = df, renames

    def field(self, name: str) -> Column:
        found = filters.resolve_name(self.df, name, self.renames)
        if found is None:
            raise ValueError(f"no column {name!r}; write 'str:{name}' for the text")
        c = F.col(f"`{found}`")
        # NaN counts as null, in every operator alike
        return F.nanvl(c, F.lit(None)) if isinstance(self.df.schema[found].dataType, (T.DoubleType, T.FloatType)) else c

    def operand(self, v):
        """A Column, or the plain value if it is a literal."""
        if isinstance(v, str):
            return v[4:] if v.startswith("str:") else self.field(v)
        if isinstance(v, list) and not all(isinstance(x, (int, float)) or isinstance(x, str) and x.startswith("str:") for x in v):
            return self.compile(v)
        return v

    def column(self, v) -> Column:
        got = self.operand(v)
        return got if isinstance(got, Column) else F.lit(got)

    def is_text(self, c: Column) -> bool:
        return isinstance(self.df.select(c).schema[0].dataType, T.StringType)

    def compile(self, entry: list) -> Column:
        if not entry:
            raise ValueError("empty expression")
        op, *args = entry
        if op == "?":
            return filters.condition(self.df, args[0], self.renames)
        if op == "where":
            return F.when(filters.condition(self.df, args[0], self.renames), self.column(args[1])).otherwise(self.column(args[2]))
        if op == "join":
            parts = args[0][1:] if isinstance(args[0], list) and args[0] and args[0][0] == "values" else [args[0]]
            return F.concat_ws(str(self.operand(args[1])), *[self.column(p).cast("string") for p in parts])
        if op == "geo_area":
            return self.area(args[0][4:] if args[0].startswith("str:") else args[0])
        if op in UNARY:
            return UNARY[op](self.column(args[0]))
        if op in NUMERIC:
            return NUMERIC[op](self.column(args[0]), self.column(args[1]))
        special = getattr(self, f"_{op}" if op.isidentifier() else {"+": "_plus", "==": "_equal", "!=": "_unequal"}.get(op, "_"), None)
        if special is None or len(args) < 2:
            raise ValueError(f"unknown operation {op!r}")
        return special(self.column(args[0]), self.operand(args[1]))

    def area(self, unit: str) -> Column:
        if unit not in AREA_UNITS:
            raise ValueError(f"area unit {unit!r}")
        if "geometry" not in self.df.columns:
            raise ValueError("geo_area needs a column geometry")
        return sphere_area(F.col("geometry")) * F.lit(AREA_UNITS[unit])

    def _plus(self, a: Column, b) -> Column:
        b = b if isinstance(b, Column) else F.lit(b)
        return F.concat(a.cast("string"), b.cast("string")) if self.is_text(a) or self.is_text(b) else a + b

    def _equal(self, a: Column, b) -> Column:
        return filters.sure(trimmed(a) == b.strip()) if isinstance(b, str) else filters.sure(a == b)

    def _unequal(self, a: Column, b) -> Column:
        return ~self._equal(a, b)

    def _map(self, a: Column, b: dict) -> Column:
        if not b:
            return a.cast("string")
        table = F.create_map(*[F.lit(str(x)) for kv in b.items() for x in kv])
        return F.coalesce(F.try_element_at(table, a.cast("string")), a.cast("string"))

    def _fillempty(self, a: Column, b) -> Column:
        value = b if isinstance(b, Column) else F.lit(b)
        return F.when(a.isNull() | F.lower(trimmed(a)).isin(EMPTY_WORDS), value).otherwise(a)

    def _replace(self, a: Column, b: dict) -> Column:
        return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), b.items(), a.cast("string"))

    def _replace_regex(self, a: Column, b: dict) -> Column:
        refs = lambda s: re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: f"${m[1] or m[2]}", s.replace("$", r"\$"))
        return reduce(lambda c, kv: F.regexp_replace(c, kv[0], refs(kv[1])), b.items(), a.cast("string"))

    def _contains(self, a: Column, b) -> Column:
        return filters.sure(a.cast("string").rlike(str(b)))

    def _contains_case_insensitive(self, a: Column, b) -> Column:
        each = [str(x).upper() for x in (filters.text_of(b) if isinstance(b, list) else [b])]
        return filters.sure(reduce(lambda x, y: x | y, [F.upper(a.cast("string")).rlike(p) for p in each], F.lit(False)))

    def _isin(self, a: Column, b) -> Column:
        values = filters.text_of(b) if isinstance(b, list) else [b]
        if not values:
            return F.lit(False)
        if all(isinstance(v, str) for v in values):
            return filters.sure(trimmed(a).isin([v.strip() for v in values]))
        return filters.sure(a.isin(values))

    def _split_before(self, a: Column, b) -> Column:
        return F.substring_index(a.cast("string"), str(b), 1)

    def _split_after(self, a: Column, b) -> Column:
        s, sep = a.cast("string"), str(b)
        at = F.instr(s, sep)
        return F.when(at == 0, s).otherwise(F.substring(s, at + len(sep), F.length(s)))

    def _datetime(self, a: Column, b) -> Column:
        return F.try_to_timestamp(a.cast("string"), F.lit(date_pattern(str(b))))

    def _datetimestr(self, a: Column, b) -> Column:
        return F.date_format(self._datetime(a, b), "yyyy-MM-dd")

    def _substr(self, a: Column, b) -> Column:
        if not isinstance(b, dict):
            raise ValueError("substr takes {'left': , 'right': }")
        s = a.cast("string")
        n = F.length(s)
        at = lambda k, default: default if k is None else F.lit(k) if k >= 0 else F.greatest(F.lit(0), n + k)
        lo, hi = at(b.get("left"), F.lit(0)), F.least(n, at(b.get("right"), n))
        return F.when(s.isNotNull(), F.substring(s, lo + 1, F.greatest(F.lit(0), hi - lo)))


@F.pandas_udf(T.DoubleType())
def sphere_area(shapes):
    """The area in square metres of WKB polygons on the sphere (holes taken off); null where unreadable."""
    import math

    import pandas as pd

    def one(g):
        parts = geo.wkb_rings(g)
        if not parts:
            return None
        total = 0.0
        for rings in parts:
            for i, r in enumerate(rings):
                if len(r) < 3:
                    continue
                s = sum(math.radians(x2 - x1) * (math.sin(math.radians(y1)) + math.sin(math.radians(y2))) for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True))
                total += abs(s) / 2 * (1 if i == 0 else -1)
        return total * geo.EARTH_RADIUS_M**2

    return pd.Series([one(g) for g in shapes], dtype="float64")


def calculate(df: DataFrame, spec: dict[str, list], renames: dict[str, str] | None = None) -> DataFrame:
    """Adds the columns of ``spec`` in order; later ones see earlier ones; ``__temp_`` columns are dropped in the end.

    Entries that don't need each other share one projection, so plans stay flat.
    """
    batch: dict[str, list] = {}
    for name, entry in spec.items():
        if name in batch or fields_of(entry) & batch.keys():
            df = _project(df, batch, renames)
            batch = {}
        batch[name] = entry
    df = _project(df, batch, renames)
    return df.drop(*[c for c in df.columns if c.startswith("__temp_")])


def _project(df: DataFrame, batch: dict[str, list], renames) -> DataFrame:
    c = Compiler(df, renames)
    return df.withColumns({n: c.compile(e) for n, e in batch.items()}) if batch else df


def fields_of(entry) -> set[str]:
    """The columns that an expression mentions."""
    if isinstance(entry, list):
        return set().union(*[fields_of(e) if isinstance(e, list) else {e} if isinstance(e, str) and not e.startswith("str:") else set() for e in entry[1:]])
    return set()


def tweak(df: DataFrame, changes: list[dict], renames: dict[str, str] | None = None) -> DataFrame:
    """Sets ``field`` to a value where ``key`` equals a given one, change by change."""
    for change in changes:
        field, key = (filters.resolve_name(df, change[k], renames) for k in ("field", "key"))
        if field is None or key is None:
            raise ValueError(f"no column {change['field']!r} or {change['key']!r}")
        kind = df.schema[field].dataType
        out = F.col(f"`{field}`")
        for k, v in change.get("values", {}).items():
            out = F.when(F.col(f"`{key}`") == F.lit(k).cast(df.schema[key].dataType), F.lit(v).cast(kind)).otherwise(out)
        df = df.withColumn(field, out)
    return df
