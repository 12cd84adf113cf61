"""Best representative of each duplicate group (problem 4).

Groups: records are linked by identifiers written in many ways; identifiers are brought to one form, and records that
share one, also through others, form a group (connected components over the distinct identifier pairs, not over
record pairs).

Survivors: one value per field by weighted token consensus. Each value of a group is cut into tokens, the values are
aligned progressively (heaviest first), each aligned column elects a token by weight, and the existing value closest to
the elected tokens survives. Two weightings:

* ``vote``: every record has a finite weight; values are first added up by (group, field, value), so a copy repeated a
  million times is one row, and large groups are aligned in blocks whose profiles are aligned again.
* ``order``: records are ranked and each outweighs all later ones together (a value counts by the first record that
  has it, with half the weight of the one before it). TESTDATA's rule for p4_found is this weighting.

Values that are the only one of their group and field are their own consensus; only the others are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import salted_join
from plumbline.session import cut

#: What stands for a missing value, in any case and with blanks around it.
NULL_TOKENS = ["none", "nan", "null", "na", "n/a", "-", "unknown", ""]
#: Distinct values aligned at once.
BLOCK = 32


def is_missing(df: DataFrame, field: str) -> Column:
    """Null, NaN, blank or a null token."""
    kind = dict(df.dtypes)[field]
    c = F.col(f"`{field}`")
    if kind in ("double", "float"):
        return c.isNull() | F.isnan(c)
    if kind == "string":
        return c.isNull() | F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")).isin(NULL_TOKENS)
    return c.isNull()


def _numbers(c: Column) -> Column:
    """The runs of digits, without leading zeros."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))


def sale_identity(key_sale: Column) -> Column:
    """One form for all writings of a sale key: parcel numbers, date and running number without zeros and separators.

    Reads ``2-7-3---Y-M-D[-n]`` with any prefix and separators, and the compact form with 2 + 7 + more digits and an
    eight-digit date. What has another shape is taken as it stands (trimmed, upper case); missing gives null.
    """
    c = F.upper(F.regexp_replace(key_sale, r"^\s+|\s+$", ""))
    spread = F.regexp_replace(c, r"^(\D*)(\d{2})(\d{7})(\d{3,})(\D+)(\d{4})(\d{2})(\d{2})(?!\d)", "$1$2-$3-$4$5$6-$7-$8")
    spread = F.regexp_replace(spread, r"^(\D*\d+\D+\d+\D+\d+\D+)(\d{4})(\d{2})(\d{2})(?!\d)", "$1$2-$3-$4")
    n = _numbers(spread)
    return F.when(c.isNull() | F.lower(c).isin(NULL_TOKENS), None).when(F.size(n).isin(6, 7), F.array_join(n, "-")).otherwise(F.concat(F.lit("="), c))


def deed_identity(key: Column, book: Column, page: Column) -> Column:
    """One form for a deed on a parcel; null unless key, book and page are known. ``book/page`` in the book is read too."""
    tidy = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    known = lambda c: F.when(~F.lower(tidy(c)).isin(NULL_TOKENS), F.upper(tidy(c)))
    first = lambda c, g=r"\d+": F.nullif(F.regexp_replace(F.regexp_extract(c, f"({g})", 1), r"^0+(?=\d)", ""), F.lit(""))
    k, b, p = known(key), known(book), known(page)
    both = F.regexp_extract(b, r"\d\s*/\s*(\d+)", 1)
    p = F.coalesce(first(p), F.nullif(F.regexp_replace(both, r"^0+(?=\d)", ""), F.lit("")))
    kn = _numbers(k)
    return F.concat_ws("|", F.when(F.size(kn) == 3, F.array_join(kn, "-")).otherwise(k), first(b), p), k.isNotNull() & first(b).isNotNull() & p.isNotNull()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the graph of ``a, b`` pairs: the smallest node of each component.

    Alternates large-star and small-star, which needs a logarithmic number of rounds even on long chains; every round
    is cut into the shared checkpoint folder, and only counts come to the driver.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        small = cut(small)
        if small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty():
            break
        e = small
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def linked_groups(records: DataFrame, first: str, second: str) -> DataFrame:
    """``records`` with ``group``: the class of records linked through two kinds of identifiers (null if a record has neither).

    Only identifiers that meet more than one of the other kind go through the component search; the rest are groups
    already. A group of any size costs one row per distinct identifier pair. Other columns stay; one named ``group`` is replaced.
    """
    kept = [c for c in records.columns if c != "group"]
    records = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("__r"), F.col(f"`{first}`").cast("string").alias("__x"), F.col(f"`{second}`").cast("string").alias("__y"))
    first, second = "__x", "__y"
    pairs = cut(records.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.lit(1).alias("one")).drop("one"))
    of_y = pairs.groupBy("y").agg(F.min("x").alias("x0"), F.count(F.lit(1)).alias("n"))
    busy_x = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    busy_y = of_y.where("n > 1").select("y")
    tangled = pairs.join(busy_x, "x", "left_semi").unionByName(pairs.join(busy_y, "y", "left_semi")).distinct()
    label = components(tangled.select(F.concat(F.lit("x:"), "x").alias("a"), F.concat(F.lit("y:"), "y").alias("b")))
    label = label.select(F.col("node").alias("group"), "label")
    with_first = records.where(F.col(first).isNotNull()).withColumn("group", F.concat(F.lit("x:"), first))
    rest = records.where(F.col(first).isNull())
    rest = salted_join(rest, of_y.select(F.col("y").alias(second), "x0"), second, "left").withColumn("group", F.coalesce(F.concat(F.lit("x:"), "x0"), F.concat(F.lit("y:"), second))).drop("x0")
    every = with_first.unionByName(rest)
    # an x may be tangled through its y; a y that meets one busy x only is labelled through that x
    got = salted_join(every, label, "group", "left")
    return got.select(*[F.col("__r").getField(c).alias(c) for c in kept], F.coalesce("label", "group").alias("group"))


def repeated(records: DataFrame, group: str, row_id: str) -> DataFrame:
    """``g, group_id``: the groups of two or more records, with their smallest row id; null groups are no groups."""
    n = records.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.min(row_id).alias("group_id"), F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").drop("n")


def surviving_rows(records: DataFrame, group: str, row_id: str, fields: list[str], rank: list[Column], record_type: str) -> DataFrame:
    """The ``order`` consensus: ``record_type, group_id, field, row_id`` for groups of two or more records.

    ``rank``: columns of which the largest wins, nulls last, compared one after the other; the largest ``row_id``
    decides in the end. Fields that no record of the group has give no row; null groups are no groups; an empty table
    gives no rows; further columns don't matter. A value counts once per group however often it is repeated, and large
    groups are aligned in blocks, so a group that holds a third of all rows is no task of its own.
    """
    place = F.struct(*[x for i, r in enumerate(rank) for x in (r.isNotNull().alias(f"h{i}"), r.alias(f"r{i}"))], F.col(row_id).alias("id"))
    got = _consensus(records, group, row_id, fields, place)
    return got.select(F.lit(record_type).alias("record_type"), "group_id", "field", F.col("best.place.id").alias("row_id"))


def surviving_values(records: DataFrame, group: str, row_id: str, fields: list[str], weight: Column) -> DataFrame:
    """The ``vote`` consensus: ``group_id, field, value, consensus, row_id`` for groups of two or more records.

    ``value`` is the existing value closest to the consensus (fewest edits, then most weight, then smallest text) and
    ``row_id`` the smallest row that has it. Missing values have no vote.
    """
    got = _consensus(records, group, row_id, fields, None, weight)
    return got.select("group_id", "field", F.col("best.value").alias("value"), "consensus", F.col("best.id").alias("row_id"))


def _consensus(records: DataFrame, group: str, row_id: str, fields: list[str], place: Column | None, weight: Column | None = None) -> DataFrame:
    """``group_id, field, consensus, best`` (the closest value with its ``place``, or with its weight and smallest row)."""
    groups = cut(repeated(records, group, row_id))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(~is_missing(records, f), F.trim(F.col(f"`{f}`").cast("string"))).alias("value")) for f in fields])
    long = records.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), (weight.cast("double") if place is None else place).alias("w"), F.col(row_id).alias("id"), cells.alias("c"))
    long = salted_join(long, groups, "g").select("g", "group_id", "w", "id", F.explode(F.filter("c", lambda c: c["value"].isNotNull())).alias("c")).select("g", "group_id", "w", "id", "c.field", "c.value")
    values = long.groupBy("g", "group_id", "field", "value").agg(*([F.sum("w").alias("w"), F.min("id").alias("id")] if place is None else [F.max("w").alias("w")]))
    values = cut(values)
    # equal values of a group and field in any writing of blanks are one sequence of tokens
    seq = F.array_join(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), " ")
    count = values.groupBy("g", "field").agg(F.count(F.lit(1)).alias("k"), F.first("value").alias("only"))
    many = count.where("k > 1").select("g", "field", "k")
    start = values.join(many, ["g", "field"]).select("g", "field", F.pmod(F.xxhash64("value"), F.ceil(F.col("k") / BLOCK)).alias("block"), F.struct("w", "value").alias("v"))
    first = start.groupBy("g", "field", "block").agg(F.sort_array(F.collect_list("v"), asc=False).alias("vs"))
    profile = "array<struct<tokens:array<string>,weights:array<double>>>"
    ordered = place is not None
    tops = first.select("g", "field", "block", F.col("vs")[0]["w"].alias("top"))
    kinds = f"g {dict(first.dtypes)['g']}, field string, block long, w double, profile {profile}"
    # Python sees the weights themselves, or only the order of the values
    weights = lambda c: F.lit(None).cast("array<double>") if ordered else F.transform(c, lambda v: v["w"])
    blocks = cut(first.select("g", "field", "block", weights("vs").alias("ws"), F.transform("vs", lambda v: v["value"]).alias("values")).mapInPandas(_profiles, kinds))
    while True:
        most = blocks.groupBy("g", "field").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        if most.isEmpty():
            break
        again = blocks.join(most, ["g", "field"]).join(tops, ["g", "field", "block"]).withColumn("block", F.pmod(F.xxhash64("block", F.lit(1)), F.ceil(F.col("k") / BLOCK)))
        order = F.struct("top", "w", "block0", "profile") if ordered else F.struct("w", "block0", "profile")
        again = again.withColumn("block0", F.hash("profile.tokens")).groupBy("g", "field", "block").agg(F.sort_array(F.collect_list(order), asc=False).alias("vs"), F.max("top").alias("top"))
        tops = cut(again.select("g", "field", "block", "top"))
        merged = again.select("g", "field", "block", weights("vs").alias("ws"), F.transform("vs", lambda v: F.struct(v["profile"].alias("profile"))).alias("values")).mapInPandas(_merge, kinds)
        blocks = cut(blocks.join(most, ["g", "field"], "left_anti").unionByName(merged))
    top = lambda c: F.array_max(F.arrays_zip(c["weights"], c["tokens"]))["tokens"]
    elected = blocks.select("g", "field", F.array_join(F.filter(F.transform("profile", top), lambda t: t != ""), " ").alias("consensus"))
    near = values.join(elected, ["g", "field"], "left").withColumn("consensus", F.coalesce("consensus", seq))
    near = near.withColumn("d", F.when(seq == F.col("consensus"), 0).otherwise(F.levenshtein(seq, F.col("consensus"))))
    # the fewest edits, then the largest place; or the fewest edits, the most weight, the smallest text
    best = F.max(F.struct((-F.col("d")).alias("d"), F.col("w").alias("place"))) if ordered else F.min(F.struct("d", (-F.col("w")).alias("w"), "value", "id"))
    return near.groupBy("g", "group_id", "field").agg(best.alias("best"), F.first("consensus").alias("consensus"))


def _weights(ws, n: int) -> list[float]:
    """The weights of the values; without any, each value outweighs all later ones together."""
    return [2.0**-i for i in range(n)] if ws is None else [float(w) for w in ws]


def _profiles(batches: Iterator):
    import pandas as pd

    for pdf in batches:
        out = []
        for g, f, b, ws, values in pdf.itertuples(index=False):
            prof, weights = None, _weights(ws, len(values))
            for w, v in zip(weights, values, strict=True):
                new = [{t: w} for t in v.split()]
                prof = new if prof is None else align(prof, new, sum(weights))
            out.append((g, f, b, float(sum(weights)), _pack(prof)))
        yield pd.DataFrame(out, columns=["g", "field", "block", "w", "profile"])


def _merge(batches: Iterator):
    import pandas as pd

    for pdf in batches:
        out = []
        for g, f, b, ws, values in pdf.itertuples(index=False):
            prof = None
            for i, v in enumerate(values):
                new = [dict(zip(c["tokens"], c["weights"], strict=True)) for c in v["profile"]]
                if ws is None:  # the first value of a block outweighs the rest of it by 2**-31, so later blocks must weigh less than that
                    new = [{t: w * 2.0 ** (-40 * i) for t, w in c.items()} for c in new]
                prof = new if prof is None else align(prof, new, 0.0)
            out.append((g, f, b, float(sum(ws)) if ws is not None else 1.0, _pack(prof)))
        yield pd.DataFrame(out, columns=["g", "field", "block", "w", "profile"])


def _pack(profile: list[dict]) -> list[dict]:
    return [{"tokens": sorted(c), "weights": [float(c[t]) for t in sorted(c)]} for c in profile]


def align(a: list[dict], b: list[dict], total: float) -> list[dict]:
    """Aligns two profiles (columns of token weights; '' is a gap) by their shared weight and adds them up."""
    wa, wb = max((sum(c.values()) for c in a), default=0.0), max((sum(c.values()) for c in b), default=0.0)
    n, m = len(a), len(b)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = sum(min(w / max(wa, 1e-12), b[j][t] / max(wb, 1e-12)) for t, w in a[i].items() if t and t in b[j])
            # columns without a common token may stand under each other, so a replaced word is one column
            score[i][j] = max(score[i + 1][j + 1] + (same if same else 0.05), score[i + 1][j], score[i][j + 1])
    i = j = 0
    out = []
    while i < n or j < m:
        if i < n and j < m:
            same = sum(min(w / max(wa, 1e-12), b[j][t] / max(wb, 1e-12)) for t, w in a[i].items() if t and t in b[j])
            if score[i][j] == score[i + 1][j + 1] + (same if same else 0.05):
                out.append({t: a[i].get(t, 0.0) + b[j].get(t, 0.0) for t in a[i].keys() | b[j].keys()})
                i, j = i + 1, j + 1
                continue
        if j >= m or (i < n and score[i][j] == score[i + 1][j]):
            out.append({**a[i], "": a[i].get("", 0.0) + wb})
            i += 1
        else:
            out.append({**b[j], "": b[j].get("", 0.0) + wa})
            j += 1
    return out


def trusted(records: DataFrame, feeds: DataFrame) -> DataFrame:
    """``records`` with ``trust_rank`` of their feed (null if none or not listed); ``feeds`` has one row per feed."""
    return salted_join(records.drop("trust_rank"), feeds.where(F.col("feed").isNotNull()).select("feed", "trust_rank").dropDuplicates(["feed"]), "feed", "left")
