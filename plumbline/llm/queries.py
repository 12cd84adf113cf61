"""Queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import addresses, leaks, mixture
from plumbline.llm import percentiles as pct
from plumbline.llm import survivors as sv
from plumbline.llm import truncation
from plumbline.operators.skew import maybe_known, salted_join
from plumbline.plans.tables import table
from plumbline.session import cut

#: p05, p25, median, p75, p95 in basis points, and the relative error of the combined partial results.
BASIS_POINTS = [500, 2500, 5000, 7500, 9500]
REL_ERROR = 0.001


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Sale prices by model group and by census tract (through the parcel key), with the month they were recorded in."""
    sales = table(spark, d, "sales").select("key", "model_group", "sale_price", F.coalesce(F.date_format("recorded_at", "yyyy-MM"), F.lit("unknown")).alias("period"))
    tracts = table(spark, d, "universe").where(F.col("key").isNotNull() & F.col("census_tract").isNotNull()).select("key", "census_tract").distinct()
    by_group = sales.select(F.lit("model_group").alias("grouping"), F.col("model_group").alias("member"), "period", "sale_price")
    by_tract = salted_join(sales.select("key", "period", "sale_price").where(F.col("key").isNotNull()), tracts, "key")
    return by_group.unionByName(by_tract.select(F.lit("census_tract").alias("grouping"), F.col("census_tract").alias("member"), "period", "sale_price"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Partial results per month and the whole combined from them (period ``all``), each within REL_ERROR."""
    months = pct.value_counts(_prices(spark, d), ["grouping", "member", "period"], "sale_price", REL_ERROR)
    both = months.unionByName(pct.combine(months, ["grouping", "member"]).withColumn("period", F.lit("all")))
    got = pct.percentiles(both, ["grouping", "member", "period"], BASIS_POINTS)
    return got.select("grouping", "member", "period", "n", *[F.round(f"p{b}", 4).alias(f"p{b}") for b in BASIS_POINTS])


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same groups over the whole period, without error."""
    return pct.percentiles(pct.value_counts(_prices(spark, d), ["grouping", "member"], "sale_price"), ["grouping", "member"], BASIS_POINTS)


SALE_FIELDS = ["sale_price", "sale_date", "deed_book", "deed_page", "valid_sale"]
PARCEL_FIELDS = ["address", "bldg_area_finished_sqft", "land_area_sqft", "neighborhood"]


def _grouped_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales that belong to a transaction with other sales, with its ``group``; the rest is left in the scan by a filter of row ids."""
    sales = table(spark, d, "sales").select("row_id", "key_sale", "key", "feed", "recorded_at", *SALE_FIELDS)
    deed, whole = sv.deed_identity(F.col("key"), F.col("deed_book"), F.col("deed_page"))
    named = cut(sales.select("row_id", sv.sale_identity(F.col("key_sale")).alias("s"), F.when(whole, deed).alias("d")))
    grouped = sv.linked_groups(named, "s", "d").where(F.col("group").isNotNull())
    grouped = cut(grouped.select("row_id", "group"))
    members = cut(salted_join(grouped, sv.repeated(grouped, "group", "row_id").select(F.col("g").alias("group")), "group", "left_semi"))
    some = sales.where(maybe_known(sales, "row_id", members.select("row_id"))).join(members, "row_id")
    return sv.trusted(cut(some.drop("key")), table(spark, d, "feeds"))


def _rank() -> list:
    return [-F.col("trust_rank"), F.col("recorded_at")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    sales = sv.surviving_rows(_grouped_sales(spark, d), "group", "row_id", SALE_FIELDS, _rank(), "sale")
    parcels = sv.trusted(table(spark, d, "universe").select("record_id", "key", "feed", "recorded_at", *PARCEL_FIELDS), table(spark, d, "feeds"))
    return sales.unionByName(sv.surviving_rows(parcels, "key", "record_id", PARCEL_FIELDS, _rank(), "parcel"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Token-level consensus of the fields of sales and parcels; a record's weight falls with its feed's trust rank."""
    parcels = sv.trusted(table(spark, d, "universe").select("record_id", "key", "feed", *PARCEL_FIELDS), table(spark, d, "feeds"))
    weight = F.lit(1.0) / F.coalesce(F.col("trust_rank"), F.lit(10))
    sales = sv.surviving_values(_grouped_sales(spark, d), "group", "row_id", ["key_sale", *SALE_FIELDS], weight).select(F.lit("sale").alias("record_type"), "*")
    return sales.unionByName(sv.surviving_values(parcels, "key", "record_id", PARCEL_FIELDS, weight).select(F.lit("parcel").alias("record_type"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """The character spans to remove, with the items found in them."""
    return leaks.removal_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", mixture.token_count(F.col("text")).alias("n_tokens"))
    return mixture.mix(docs, "doc_id", "source", "n_tokens", table(spark, d, "source_targets"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents taken and how often, sized to the tokens of the targets' sources."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, d)[1]


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "documents"), "doc_id", "source", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where(F.col("evidence").isNotNull()).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source's texts are cut."""
    return truncation.truncation_rates(_truncated(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_place_pairs(table(spark, d, "universe").select("key", "address", "city"), "key", "address", "city")


QUERIES = {"p1_percentiles": p1_percentiles, "p1_exact": p1_exact, "p3_found": p3_found, "p4_found": p4_found, "p4_consensus": p4_consensus, "p6_found": p6_found, "p6_spans": p6_spans, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found, "p8_rates": p8_rates}

_PRICES = """
WITH t AS (SELECT DISTINCT key, census_tract FROM universe WHERE key IS NOT NULL AND census_tract IS NOT NULL),
s AS (SELECT key, model_group, sale_price, coalesce(strftime(recorded_at, '%Y-%m'), 'unknown') AS period FROM sales WHERE sale_price IS NOT NULL AND NOT isnan(sale_price)),
x AS (SELECT 'model_group' AS grouping, model_group AS member, period, sale_price FROM s
      UNION ALL SELECT 'census_tract', t.census_tract, s.period, s.sale_price FROM s JOIN t USING (key)),
"""
_REACH = ", ".join(f"min(CASE WHEN reached >= greatest(1, ({b} * total + 9999) // 10000) THEN v END) AS p{b}" for b in BASIS_POINTS)
_G = (1 + REL_ERROR) / (1 - REL_ERROR)
SQL = {
    "p1_percentiles": _PRICES
    + f"""r AS (SELECT grouping, member, period, CASE WHEN sale_price = 0 THEN 0.0::DOUBLE ELSE sign(sale_price) * pow({_G!r}::DOUBLE, ceil(ln(abs(sale_price)) / ln({_G!r}::DOUBLE))) * {2 / (_G + 1)!r}::DOUBLE END AS v FROM x),
y AS (SELECT * FROM r UNION ALL SELECT grouping, member, 'all', v FROM r),
c AS (SELECT grouping, member, period, v, count(*) AS n FROM y GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY grouping, member, period ORDER BY v) AS reached, sum(n) OVER (PARTITION BY grouping, member, period) AS total FROM c),
g AS (SELECT grouping, member, period, max(total)::BIGINT AS n, {_REACH} FROM k GROUP BY ALL)
SELECT grouping, member, period, n, {", ".join(f"round(p{b}, 4) AS p{b}" for b in BASIS_POINTS)} FROM g""",
    "p1_exact": _PRICES
    + f"""c AS (SELECT grouping, member, sale_price AS v, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY grouping, member ORDER BY v) AS reached, sum(n) OVER (PARTITION BY grouping, member) AS total FROM c)
SELECT grouping, member, max(total)::BIGINT AS n, {_REACH} FROM k GROUP BY ALL""",
}

_MISS = "({0} IS NULL OR lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) IN ('none', 'nan', 'null', 'na', 'n/a', '-', 'unknown', ''))"
_KNOWN = "CASE WHEN NOT " + _MISS + " THEN upper(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) END"
_DIGITS = "regexp_replace(regexp_extract({0}, '[0-9]+'), '^0+([0-9])', '\\1')"
_ABSENT = {f: _MISS.format(f) for f in ("deed_book", "deed_page", "address", "neighborhood")} | {"sale_price": "(sale_price IS NULL OR isnan(sale_price))"}


def _survivor_sql(kind: str, source: str, group: str, row: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS record_type, group_id, '{f}' AS field, {row} AS row_id FROM (SELECT *, min({row}) OVER (PARTITION BY {group}) AS group_id, count(*) OVER (PARTITION BY {group}) AS n FROM {source}) "
        f"WHERE n > 1 AND NOT {_ABSENT.get(f, f'{f} IS NULL')} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY trust_rank NULLS LAST, recorded_at DESC NULLS LAST, {row} DESC) = 1"
        for f in fields
    )


SQL["p4_found"] = f"""WITH RECURSIVE t AS (SELECT s.*, f.trust_rank, {_KNOWN.format('key_sale')} AS c, {_KNOWN.format('s.key')} AS k, {_KNOWN.format('deed_book')} AS b, {_KNOWN.format('deed_page')} AS p FROM sales s LEFT JOIN feeds f ON f.feed = s.feed),
t1 AS (SELECT *, regexp_replace(regexp_replace(c, '^(\\D*)(\\d{{2}})(\\d{{7}})(\\d{{3,}})(\\D+)(\\d{{4}})(\\d{{2}})(\\d{{2}})(\\D|$)', '\\1\\2-\\3-\\4\\5\\6-\\7-\\8\\9'), '^(\\D*\\d+\\D+\\d+\\D+\\d+\\D+)(\\d{{4}})(\\d{{2}})(\\d{{2}})(\\D|$)', '\\1\\2-\\3-\\4\\5') AS spread,
coalesce(nullif({_DIGITS.format('p')}, ''), nullif(regexp_replace(regexp_extract(b, '[0-9]\\s*/\\s*([0-9]+)', 1), '^0+([0-9])', '\\1'), '')) AS page, nullif({_DIGITS.format('b')}, '') AS book FROM t),
t2 AS (SELECT *, list_transform(regexp_extract_all(spread, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')) AS sn, list_transform(regexp_extract_all(k, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')) AS kn FROM t1),
t3 AS (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN len(sn) IN (6, 7) THEN array_to_string(sn, '-') ELSE '=' || c END AS s, CASE WHEN k IS NOT NULL AND book IS NOT NULL AND page IS NOT NULL THEN CASE WHEN len(kn) = 3 THEN array_to_string(kn, '-') ELSE k END || '|' || book || '|' || page END AS d FROM t2),
e AS (SELECT DISTINCT 'x' || s AS a, 'y' || d AS b FROM t3 WHERE s IS NOT NULL AND d IS NOT NULL),
r(a, x) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e2.a FROM r JOIN e e1 ON e1.a = r.x JOIN e e2 ON e2.b = e1.b),
lab AS (SELECT a, min(x) AS label FROM r GROUP BY 1), dlab AS (SELECT b, min(label) AS label FROM e JOIN lab USING (a) GROUP BY 1),
g AS (SELECT t3.*, coalesce(lab.label, dlab.label, 'x' || s, 'y' || d) AS g FROM t3 LEFT JOIN lab ON lab.a = 'x' || s LEFT JOIN dlab ON dlab.b = 'y' || d),
gs AS (SELECT * FROM g WHERE g IS NOT NULL), u AS (SELECT u.*, f.trust_rank FROM universe u LEFT JOIN feeds f ON f.feed = u.feed WHERE key IS NOT NULL)
{_survivor_sql('sale', 'gs', 'g', 'row_id', SALE_FIELDS)} UNION ALL {_survivor_sql('parcel', 'u', 'key', 'record_id', PARCEL_FIELDS)}"""

_WORDS = r"""list_transform(regexp_extract_all(regexp_replace(text, '\\(?:(?:cite|ref|eqref|label|input|include)\b\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}|[A-Za-z]+\*?|(?s:.))', ' ', 'g'), '[\pL\pN]+'), lambda w: lower(w))"""
SQL["p6_found"] = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
dg AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
