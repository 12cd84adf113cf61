"""Matches by date offset: the next event after a row, or the best event before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_after(rows: DataFrame, events: DataFrame, key: str, row_id: str, at: str, event_at: str, keep: list[str]) -> DataFrame:
    """``row_id, days`` and ``keep`` of the first event of the same key strictly after each row's date (ties: smallest ``keep``).

    The match is an equality join reduced by a partial minimum per row.
    """
    j = rows.select(key, row_id, at).join(events.select(key, event_at, *keep), key).withColumn("days", F.datediff(event_at, at)).where("days > 0")
    return j.groupBy(row_id).agg(F.min(F.struct("days", *keep)).alias("b")).select(row_id, "b.days", *[F.col(f"b.{c}").alias(c) for c in keep])


def best_before(rows: DataFrame, events: DataFrame, key: str, row_id: str, at: str, event_at: str, prefer: Column, keep: list[str]) -> DataFrame:
    """``row_id, days`` (negative) and ``keep`` of the event strictly before each row's date with the largest ``prefer``, then the latest."""
    j = rows.select(key, row_id, at).join(events.select(key, event_at, prefer.alias("__p"), *keep), key).withColumn("days", F.datediff(event_at, at)).where("days < 0")
    return j.groupBy(row_id).agg(F.max(F.struct("__p", "days", *keep)).alias("b")).select(row_id, "b.days", *[F.col(f"b.{c}").alias(c) for c in keep])
