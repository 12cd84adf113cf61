"""Last-known matches: for each event, the latest entry of every history that is in force at its position.

The engine's as-of join. Events and histories are merged into one stream, sorted once by (key, position), and a
running maximum per history carries the last entry forward, so there is no theta join and no per-key Python.

Scale: one shuffle of narrow rows. Keys that hold a large share of the rows are found first by a counted pass
(map-side combined) and are then cut into slices of the position axis, each slice again spread over salts; what a
slice must inherit from the slices before it is a carry table of at most ``1 / HOT_SHARE`` keys x ``SLICES`` rows,
which is why it may be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with more than this share of the rows is treated as hot; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 64
#: Below so many rows a key is never worth splitting (the result is the same either way).
HOT_ROWS = 200_000
#: Slices of the position axis of a hot key, and salts that the events of a slice are spread over.
SLICES = 16
SALTS = 8


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> list:
    """Keys with more than ``share`` of all rows and more than ``rows`` rows; at most ``1 / share`` values, nulls left out."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    big = counts.orderBy(F.col("__n").desc()).limit(int(1 / share) + 1).collect()
    if not big:
        return []
    total = df.count()
    return [r[0] for r in big if r["__n"] > share * total]


def _in(key: Column, keys: list) -> Column:
    return key.isin(keys) if keys else F.lit(False)


def scan(events: DataFrame, histories: DataFrame, key: str, at: str, kinds: list[int], hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events with a column ``known_<kind>`` for each history kind: its last entry at or before the event.

    ``events`` has ``key``, the position ``at`` (a long) and any other columns; ``histories`` has ``key``, ``at``,
    ``kind`` (int) and ``entry`` (a struct; where several entries precede an event, the largest is taken). Events
    with a null key or position come out with null entries. Repeated events stay repeated; extra columns stay as
    they are unless they start with ``__`` or are named ``known_<kind>``.
    """
    kept = [c for c in events.columns if c not in (key, at)]
    usable = F.col(key).isNotNull() & F.col(at).isNotNull()
    payload = F.struct(F.lit(True).alias("__event"), *[F.col(f"`{c}`") for c in kept])
    e = events.select(F.col(key).alias("__key"), F.col(at).cast("long").alias("__at"), F.when(usable, 1).otherwise(2).alias("__side"), payload.alias("__row"))
    h = histories.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("__key"), F.col(at).cast("long").alias("__at"), F.lit(0).alias("__side"), F.col("kind").alias("__kind"), F.col("entry").alias("__entry")
    )
    both = events.select(F.col(key).alias("__key")).unionByName(histories.select(F.col(key).alias("__key")))
    hot = hot_keys(both, "__key", hot_share, hot_rows)
    # A null key would gather all its rows in one task; those events match nothing, so they are spread by their content.
    spread = F.pmod(F.hash("__row"), F.lit(1 << 16))
    slice_of = _slices(e, h, hot) if hot else F.lit(0)
    is_hot = _in(F.col("__key"), hot)
    e = e.withColumn("__slice", F.when(F.col("__side") == 2, -1).otherwise(slice_of)).withColumn("__salt", F.when(F.col("__side") == 2, spread).when(is_hot, F.pmod(F.hash("__row"), F.lit(SALTS))).otherwise(0))
    h = h.withColumn("__slice", slice_of)
    carry = None
    if hot:
        last = h.where(is_hot).groupBy("__key", "__slice", "__kind").agg(F.max("__entry").alias("__entry"))
        carry = _carry(last, kinds)
        h = h.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    else:
        h = h.withColumn("__salt", F.lit(0))
    stream = e.withColumns({"__kind": F.lit(None).cast("int")}).unionByName(h, allowMissingColumns=True)
    w = Window.partitionBy("__key", "__slice", "__salt").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = stream.withColumns({f"known_{k}": F.max(F.when(F.col("__kind") == k, F.col("__entry"))).over(w) for k in kinds}).where(F.col("__side") > 0)
    if carry is not None:
        out = out.join(F.broadcast(carry), ["__key", "__slice"], "left")
        out = out.withColumns({f"known_{k}": _larger(F.col(f"known_{k}"), F.col(f"__carry_{k}")) for k in kinds})
    usable_now = F.col("__side") == 1
    return out.select(
        F.col("__key").alias(key), F.col("__at").alias(at), *[F.col("__row").getField(c).alias(c) for c in kept], *[F.when(usable_now, F.col(f"known_{k}")).alias(f"known_{k}") for k in kinds]
    )


def _larger(a: Column, b: Column) -> Column:
    """The larger of two structs, a null one losing (``greatest`` does not take structs)."""
    return F.when(a.isNull() | (b > a), F.coalesce(b, a)).otherwise(a)


def _slices(events: DataFrame, histories: DataFrame, hot: list) -> Column:
    """An expression for the slice of a hot key's position; cuts are percentiles of each hot key's own positions."""
    probs = [i / SLICES for i in range(1, SLICES)]
    ats = events.select("__key", "__at").unionByName(histories.select("__key", "__at")).where(_in(F.col("__key"), hot))
    cuts = {r[0]: sorted(set(r[1] or [])) for r in ats.groupBy("__key").agg(F.percentile_approx("__at", probs, 1000)).collect()}
    expr = F.lit(0)
    for k, bounds in cuts.items():
        if bounds:
            place = reduce(lambda acc, b: acc + (F.col("__at") > F.lit(b)).cast("int"), bounds, F.lit(0))
            expr = F.when(F.col("__key") == F.lit(k), place).otherwise(expr)
    return F.coalesce(expr, F.lit(0))


def _carry(last: DataFrame, kinds: list[int]) -> DataFrame:
    """What each slice of a hot key inherits: the largest entry of the slices before it, per kind. At most keys x SLICES rows."""
    wide = last.groupBy("__key", "__slice").agg(*[F.max(F.when(F.col("__kind") == k, F.col("__entry"))).alias(f"__last_{k}") for k in kinds])
    every = wide.select("__key").distinct().withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    w = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return every.join(wide, ["__key", "__slice"], "left").select("__key", "__slice", *[F.max(f"__last_{k}").over(w).alias(f"__carry_{k}") for k in kinds])


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    key: str,
    event_time: str,
    effective: str,
    recorded: str,
    version_id: str,
    attributes: list[str],
    hot_share: float = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    version: str | None = None,
) -> DataFrame:
    """Each event with every attribute's value as it was in force and already recorded at the event's time.

    Every attribute has its own change history (key, effective, recorded, id, value), made from the versions in
    which the attribute is not null; each history is matched on its own, and the values come back as one column
    ``known_<attribute>`` per attribute, with the version it stems from in ``known_<attribute>_id``. So attributes
    that change at different times do not need wide versions, and a version that leaves an attribute out does not
    hide the last known value.

    An entry qualifies if ``effective <= event_time`` and ``recorded <= event_time`` (null never qualifies); the
    latest effective one wins, then the latest recorded, then the largest id. Because an entry qualifies from
    ``greatest(effective, recorded)`` on, the match is a running maximum over that order. Events stay as they are,
    repeated ones included; those without any qualifying entry, or with a null key or time, get nulls. NaN counts as
    null. No versions: all nulls; no events: no rows. Columns of ``events`` with the name of an output are replaced.

    ``version`` names a further column with the id of the version in force: of what the separate matches give, the entry
    that comes last in that order. Versions that leave every attribute out have a history of their own for it.
    """
    types = dict(versions.dtypes)
    micros = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    clean = lambda c: F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)
    cells = [F.struct(F.lit(i).alias("kind"), clean(a).cast("string").alias("v")) for i, a in enumerate(attributes)]
    if version:
        given = [clean(a).isNotNull() for a in attributes]
        cells.append(F.struct(F.lit(len(attributes)).alias("kind"), F.when(~reduce(lambda x, y: x | y, given, F.lit(False)), F.lit("")).alias("v")))
    entries = F.array(*cells)
    long = (
        versions.where(F.col(key).isNotNull() & F.col(effective).isNotNull() & F.col(recorded).isNotNull())
        .select(F.col(key).alias("__k"), micros(effective).alias("__eff"), micros(recorded).alias("__rec"), F.col(version_id).alias("__id"), F.explode(F.filter(entries, lambda x: x["v"].isNotNull())).alias("__x"))
        .select(F.col("__k").alias("__k"), F.greatest("__eff", "__rec").alias("__t"), F.col("__x.kind").alias("kind"), F.struct("__eff", "__rec", "__id", F.col("__x.v").alias("v")).alias("entry"))
    )
    e = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__e"), F.col(f"`{key}`").alias("__k"), micros(event_time).alias("__t"))
    kinds = list(range(len(cells)))
    out = scan(e, long, "__k", "__t", kinds, hot_share, hot_rows)
    made = {x for a in attributes for x in (f"known_{a}", f"known_{a}_id")} | {version}
    in_force = []
    if version:
        order = [F.when(F.col(f"known_{k}").isNotNull(), F.struct(f"known_{k}.__eff", f"known_{k}.__rec", f"known_{k}.__id")) for k in kinds]
        in_force = [F.array_max(F.array(*order))["__id"].alias(version)]
    return out.select(
        *[F.col("__e").getField(c).alias(c) for c in events.columns if c not in made],
        *[x for i, a in enumerate(attributes) for x in (F.col(f"known_{i}.v").cast(types[a]).alias(f"known_{a}"), F.col(f"known_{i}.__id").alias(f"known_{a}_id"))],
        *in_force,
    )
