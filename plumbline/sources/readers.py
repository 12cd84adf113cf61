"""Reading tables: Parquet and CSV, footprints with nested columns, feature tables, census joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from a Parquet footer or a CSV header, without reading rows."""
    return read_any(spark, path).columns


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, GeoParquet (WKB stays binary) or CSV file; other extensions are an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "geoparquet"):
        return spark.read.parquet(path)
    if kind == "csv":
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema else r).csv(path)
    raise ValueError(f"can't read .{kind} files")


def read_pair(spark: SparkSession, folder: str):
    """``universe.parquet`` and ``sales.parquet`` of a folder."""
    from plumbline.operators.frames import ParcelSales

    return ParcelSales(spark.read.parquet(f"{folder}/universe.parquet"), spark.read.parquet(f"{folder}/sales.parquet"))


def in_box(df: DataFrame, box: tuple[float, float, float, float], field: str = "bbox") -> DataFrame:
    """Rows whose struct ``field`` (xmin, ymin, xmax, ymax) meets a box; pushed down into nested Parquet columns."""
    x0, y0, x1, y1 = box
    b = lambda k: F.col(f"{field}.{k}")
    return df.where((b("xmin") <= x1) & (b("xmax") >= x0) & (b("ymin") <= y1) & (b("ymax") >= y0))


def with_heights(df: DataFrame, floor_height_m: float = 3.2) -> DataFrame:
    """``height_best`` (height, estimate, or floors x floor height), ``floors_best`` (floors, or height over floor height, at
    least 1) and ``confidence`` (the largest of ``sources[].confidence``), where those columns exist."""
    have = set(df.columns)
    col = lambda c, kind="double": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    height = F.coalesce(col("height"), col("est_height"), col("num_floors") * F.lit(floor_height_m))
    floors = F.coalesce(col("num_floors"), F.when(height.isNotNull(), F.greatest(F.lit(1.0), F.rint(height / floor_height_m))))
    out = df.withColumns({"height_best": height, "floors_best": floors})
    return out.withColumn("confidence", F.array_max(F.transform("sources", lambda s: s["confidence"]))) if "sources" in have else out


def features(df: DataFrame, min_area: float, min_length: float) -> DataFrame:
    """Features large or long enough, with ``name_clean``: lower case, blanks as underscores."""
    big = F.coalesce(F.col("area") >= min_area, F.lit(False)) | F.coalesce(F.col("length") >= min_length, F.lit(False))
    return df.where(big).withColumn("name_clean", F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("_")))


def census_geoid(df: DataFrame, state: str = "state", county: str = "county", tract: str = "tract", block_group: str = "block_group") -> DataFrame:
    """``std_geoid``: the parts padded to 2 + 3 + 6 + 1 digits."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return df.withColumn("std_geoid", F.concat(pad(state, 2), pad(county, 3), pad(tract, 6), pad(block_group, 1)))
