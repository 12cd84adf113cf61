"""Declarative settings: merging, comments, variables, and running a document over tables.

All of it is driver-side work on a small JSON document; what it yields are lazy data frames.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import calc, dates, filters, text
from plumbline.operators import dedupe, frames, groups


def load(document: str | dict, template: dict | None = None) -> dict:
    """A settings document (path or object), merged into its template, without comments, with variables replaced."""
    if isinstance(document, str):
        with open(document, encoding="utf-8") as f:
            document = json.load(f)
    merged = merge(template or {}, document)
    return replace_variables(without_comments(without_flags(merged)))


def _plain(key: str) -> str:
    return key[1:] if key[:1] in "+!" and len(key) > 1 else key


def merge(template: dict, local: dict) -> dict:
    """``local`` over ``template``: objects merge, other values replace. A template key marked ``+`` appends lists (each item
    once); a local key marked ``!`` replaces whatever there is."""
    out = copy.deepcopy(template)
    names = {_plain(k): k for k in out}
    for key, value in local.items():
        base = _plain(key)
        there = names.get(base)
        if there is None or key.startswith("!"):
            if there is not None:
                del out[there]
            out[base if key.startswith("!") else key] = copy.deepcopy(value)
        elif isinstance(out[there], dict) and isinstance(value, dict):
            out[there] = merge(out[there], value)
        elif isinstance(out[there], list) and isinstance(value, list) and there.startswith("+"):
            out[there] = out[there] + [v for v in value if v not in out[there]]
        else:
            out[there] = copy.deepcopy(value)
    return out


def without_flags(node):
    if isinstance(node, dict):
        return {_plain(k): without_flags(v) for k, v in node.items()}
    return node


def without_comments(node):
    """Keys that start with ``__`` are comments (in objects, not inside lists)."""
    if isinstance(node, dict):
        return {k: without_comments(v) for k, v in node.items() if not k.startswith("__")}
    return node


def replace_variables(settings: dict, rounds: int = 999) -> dict:
    """``$$a.b`` becomes the node at a, b; repeated until nothing changes. Unknown names and endless cycles are errors."""

    def at(name: str):
        node = settings
        for part in name.split("."):
            if not isinstance(node, dict) or part not in node:
                raise ValueError(f"unknown variable $${name}")
            node = node[part]
        return copy.deepcopy(node)

    def walk(node):
        if isinstance(node, str) and node.startswith("$$"):
            return at(node[2:])
        if isinstance(node, dict):
            return {k: walk(v) for k, v in node.items()}
        if isinstance(node, list):
            return [walk(v) for v in node]
        return node

    for _ in range(rounds):
        new = walk(settings)
        if new == settings:
            if _names_variable(settings):
                break
            return settings
        settings = new
    raise ValueError("variables refer to each other in a circle")


def _names_variable(node) -> bool:
    if isinstance(node, dict):
        return any(_names_variable(v) for v in node.values())
    if isinstance(node, list):
        return any(_names_variable(v) for v in node)
    return isinstance(node, str) and node.startswith("$$")


CASTS = {"string": "string", "float": "double", "double": "double", "int": "bigint", "bool": "boolean", "boolean": "boolean"}


def load_table(spark: SparkSession, entry: dict, base: str = "") -> DataFrame:
    """One ``data.load`` entry: ``filename``, ``load`` = {new: old | [old, type[, extra]]}, ordered calc and tweak blocks,
    ``dupes`` and ``drop``. Only the columns that are mapped, or that expressions mention, are read."""
    path = f"{base}/{entry['filename']}" if base else entry["filename"]
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "geoparquet"):
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"can't read .{kind} files")
    wanted = {new: [spec] if isinstance(spec, str) else list(spec) for new, spec in entry.get("load", {c: c for c in df.columns}).items()}
    renames = {spec[0]: new for new, spec in wanted.items()}
    steps = [(k, v) for k, v in entry.items() if "calc" in k or "tweak" in k]
    mentioned = set().union(*[calc.fields_of(e) for k, v in steps if "calc" in k for e in v.values()]) if steps else set()
    made = {n for k, v in steps if "calc" in k for n in v}
    extra = [c for c in df.columns if c in mentioned - made and c not in renames and c not in wanted]
    df = df.select(*[_cast(df, *spec).alias(new) for new, spec in wanted.items()], *extra)
    for name, block in steps:
        df = calc.calculate(df, block, renames) if "calc" in name else calc.tweak(df, block, renames)
    df = df.drop(*[c for c in extra if c not in made])
    if dupes := entry.get("dupes"):
        if dupes.get("drop") == "all":
            df = dedupe.drop_repeated(df, dupes["subset"])
        elif dupes.get("agg"):
            df = dedupe.collapse(df, dupes["subset"], dupes.get("sort_by", dupes["subset"]), dupes["agg"])
        else:
            df = dedupe.keep_first(df, dupes["subset"], dupes.get("sort_by", dupes["subset"]))
    return df.drop(*entry.get("drop", []))


def _cast(df: DataFrame, old: str, kind: str | None = None, extra: str | None = None):
    c = F.col(f"`{old}`")
    if kind is None:
        return c
    if kind in ("datetime", "date"):
        return F.try_to_timestamp(c.cast("string"), F.lit(calc.date_pattern(extra))) if extra else c.try_cast("timestamp")
    if CASTS[kind] == "boolean":
        return text.to_bool(c, df.schema[old].dataType, extra == "na_true")
    if CASTS[kind] == "double":
        return F.when(~F.lower(calc.trimmed(c)).isin(calc.EMPTY_WORDS), calc.trimmed(c)).try_cast("double")
    return c.try_cast(CASTS[kind])


def tag_first(df: DataFrame, rules: dict[str, list], out: str, other: str = "UNKNOWN") -> DataFrame:
    """The name of the first rule that holds, else ``other``; one CASE expression."""
    c = F.lit(other)
    for name, f in reversed(list(rules.items())):
        c = F.when(filters.condition(df, f), name).otherwise(c)
    return df.withColumn(out, c)


def assemble(spark: SparkSession, settings: dict, base: str = "") -> frames.ParcelSales:
    """Runs ``data.load``, ``data.process.merge``, ``fill``, model-group rules and date parts of a settings document."""
    data = settings["data"]
    tables = {name: load_table(spark, entry, base) for name, entry in data["load"].items()}
    process = data.get("process", {})
    sides = {}
    for side, key in (("universe", "key"), ("sales", "key_sale")):
        steps = [{"id": s} if isinstance(s, str) else s for s in process["merge"][side]]
        sides[side] = frames.merge(list(tables.items()), steps, process.get("reconcile", {}).get(side), key)
    for side, fills in process.get("fill", {}).items():
        for how, fields in fills.items():
            for field in fields:
                sides[side] = groups.fill_by_group(sides[side], ["model_group"] if "model_group" in sides[side].columns else [], field, how) if how not in ("zero", "unknown", "none", "false") else groups.fill_by_group(sides[side], [], field, how)
    if rules := settings.get("modeling", {}).get("model_groups"):
        sides["universe"] = tag_first(sides["universe"], {k: v["filter"] for k, v in rules.items()}, "model_group")
    if "sale_date" in sides["sales"].columns:
        sides["sales"] = dates.parts(sides["sales"], "sale_date", "sale")
    return frames.ParcelSales(sides["universe"], sides["sales"])
