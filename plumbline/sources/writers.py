"""Writing tables, named checkpoints, differential caches, reports."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    flattened(df).withColumns({f.name: F.base64(f.name) for f in df.schema if isinstance(f.dataType, T.BinaryType)}).write.mode("overwrite").option("header", True).csv(path)


def write_geojson_lines(df: DataFrame, path: str, lon: str, lat: str) -> None:
    """One GeoJSON point feature per line."""
    props = F.to_json(F.struct(*[c for c in df.columns if c not in (lon, lat)]))
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.col(lon).cast("string"), F.lit(","), F.col(lat).cast("string"), F.lit(']},"properties":'), props, F.lit("}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_with_formats(df: DataFrame, path: str, formats: dict[str, str]) -> None:
    """A CSV and a JSON description of column formats beside it (``<path>.formats`` as one JSON line)."""
    write_csv(df, path)
    df.sparkSession.createDataFrame([(json.dumps(formats, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".formats")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def memoised(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], use: bool = True) -> DataFrame:
    """A step's result as a Parquet table under its name: read if it is there, else made and written (which cuts lineage)."""
    path = f"{folder}/{name}.parquet"
    if not (use and exists(spark, path)):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _content(df: DataFrame, columns: list[str]) -> list[Column]:
    """Three order-free sums over the rows' values in ``columns``."""
    kinds = dict(df.dtypes)
    h = F.xxhash64(*[F.to_json(F.map_entries(F.col(f"`{c}`"))) if kinds[c].startswith("map") else F.col(f"`{c}`") for c in columns])
    return [F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))]


def signature(df: DataFrame, key: str, extra: dict | None = None) -> str:
    """A hash of the columns, the rows with all their values, and further settings; one aggregation. Rows may come in any order."""
    r = df.agg(*_content(df, [key, *sorted(c for c in df.columns if c != key)])).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), [str(x) for x in r], extra or {}], sort_keys=True, default=str).encode()).hexdigest()


def cached_columns(df: DataFrame, folder: str, name: str, key: str, enrich: Callable[[DataFrame], DataFrame], extra: dict | None = None) -> DataFrame:
    """``enrich(df)``, of which only the columns it adds or changes are stored, under the input's signature; a later call
    with the same rows, values and settings joins them back instead of computing.

    Rows that ``enrich`` leaves out stay out. Where it repeats keys or adds rows, or ``df`` repeats or lacks keys, the
    whole result is stored.
    """
    spark, path = df.sparkSession, f"{folder}/{name}-{signature(df, key, extra)[:24]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        whole = f"{path}.whole"
        enrich(df).write.mode("overwrite").parquet(whole)
        made = spark.read.parquet(whole)
        n = made.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        m = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        plain = n[0] == n[1] and m[0] == m[1] and made.join(df, key, "left_anti").isEmpty()
        same = [c for c in df.columns if c in made.columns and c != key]
        if plain and same:
            kept = df.join(made.select(key), key, "left_semi")
            sums = [x for c in same for x in _content(df, [key, c])]
            a, b = kept.agg(*sums).first(), made.agg(*sums).first()
            same = [c for i, c in enumerate(same) if a[3 * i : 3 * i + 3] == b[3 * i : 3 * i + 3] and dict(df.dtypes)[c] == dict(made.dtypes)[c]]
        how = {"columns": made.columns, "joined": same if plain else []}
        spark.createDataFrame([(json.dumps(how),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.how")
        made.drop(*how["joined"]).write.mode("overwrite").parquet(path)
        delete(spark, whole)
    stored, how = spark.read.parquet(path), json.loads(spark.read.text(f"{path}.how").first()[0])
    return (stored.join(df.select(key, *how["joined"]), key) if how["joined"] else stored).select(*how["columns"])


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys that were added and keys that are gone."""
    return new.select(key).join(old.select(key), key, "left_anti"), old.select(key).join(new.select(key), key, "left_anti")


def fill_template(text: str, values: dict) -> str:
    """Replaces ``{{name}}``; unknown names stay."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values.get(m[1], m[0])), text)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report table")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def html_page(title: str, markdown: str) -> str:
    """Headings, paragraphs and tables of Markdown as a page."""
    import html

    out, rows = [], []

    def end():
        if rows:
            head, *body = [[html.escape(c.strip()) for c in r.strip("|").split("|")] for r in rows if not re.fullmatch(r"[|\s:-]+", r)]
            out.append("<table><tr>" + "".join(f"<th>{c}</th>" for c in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in body) + "</table>")
            rows.clear()

    for ln in markdown.split("\n"):
        if ln.startswith("|"):
            rows.append(ln)
            continue
        end()
        if m := re.match(r"(#{1,6}) (.*)", ln):
            out.append(f"<h{len(m[1])}>{html.escape(m[2])}</h{len(m[1])}>")
        elif ln.strip():
            out.append(f"<p>{html.escape(ln)}</p>")
    end()
    return f"<!doctype html><title>{html.escape(title)}</title>" + "\n".join(out)


def histogram(df: DataFrame, field: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of equal bins; 0 below and bins + 1 at or above the range; nulls and NaN left out."""
    c = F.col(field).cast("double")
    return df.where(c.isNotNull() & ~F.isnan(c)).groupBy(F.width_bucket(c, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
