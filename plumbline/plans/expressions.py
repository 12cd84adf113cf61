"""Queries of the expression and filter languages, and of scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import calc, dates, filters, text
from plumbline.plans.registry import Family
from plumbline.plans.tables import table

family = Family()
query = family.query

_N = "CASE WHEN NOT isnan({0}) THEN {0} END"


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_tax AS plus, l_quantity - l_discount AS minus, l_quantity * l_tax AS times,
l_extendedprice / nullif(l_quantity, 0) AS per_unit FROM lineitem""")
def calc_arith(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    df = calc.calculate(df, {"plus": ["+", "l_quantity", "l_tax"], "minus": ["-", "l_quantity", "l_discount"], "times": ["*", "l_quantity", "l_tax"], "per_unit": ["/0", "l_extendedprice", "l_quantity"]})
    return df.drop("l_quantity", "l_tax", "l_discount", "l_extendedprice")


@query("""SELECT record_id, CASE WHEN bldg_area_finished_sqft = 0 THEN CASE WHEN total_value > 0 THEN 'inf'::DOUBLE WHEN total_value < 0 THEN '-inf'::DOUBLE END ELSE total_value / bldg_area_finished_sqft END AS per_area,
CASE WHEN bldg_area_finished_sqft <> 0 THEN total_value / bldg_area_finished_sqft END AS per_area_safe FROM universe""")
def calc_div_zero(spark, d):
    df = table(spark, d, "universe").select("record_id", "total_value", "bldg_area_finished_sqft")
    return calc.calculate(df, {"per_area": ["/", "total_value", "bldg_area_finished_sqft"], "per_area_safe": ["/0", "total_value", "bldg_area_finished_sqft"]}).drop("total_value", "bldg_area_finished_sqft")


@query("""SELECT row_id, floor(p) AS fl, ceil(p) AS ce, round_even(p, 0) AS ro, abs(p) AS ab, TRY_CAST(trunc(p) AS BIGINT) AS ai, round_even(p / 250.0, 0) * 250.0 AS near
FROM (SELECT row_id, CASE WHEN NOT isnan(sale_price) THEN sale_price END AS p FROM sales)""")
def calc_round_family(spark, d):
    df = table(spark, d, "sales").select("row_id", F.col("sale_price").alias("p"))
    return calc.calculate(df, {"fl": ["floor", "p"], "ce": ["ceil", "p"], "ro": ["round", "p"], "ab": ["abs", "p"], "ai": ["asint", "p"], "near": ["round_nearest", "p", 250.0]}).drop("p")


@query("SELECT c_custkey, CAST(floor(c_acctbal / 37.5) AS BIGINT) AS whole, CASE WHEN c_nationkey <> 0 THEN CAST(floor(c_acctbal / c_nationkey) AS BIGINT) END AS by_key FROM customer")
def calc_floor_div(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return calc.calculate(df, {"whole": ["//", "c_acctbal", 37.5], "by_key": ["//", "c_acctbal", "c_nationkey"]}).drop("c_acctbal", "c_nationkey")


@query("""SELECT record_id, CASE WHEN land_value IS NOT NULL AND bldg_value IS NOT NULL AND NOT isnan(land_value) AND NOT isnan(bldg_value) THEN least(land_value, bldg_value) END AS lo,
CASE WHEN land_value IS NOT NULL AND bldg_value IS NOT NULL AND NOT isnan(land_value) AND NOT isnan(bldg_value) THEN greatest(land_value, bldg_value) END AS hi FROM universe""")
def calc_minmax_null(spark, d):
    df = table(spark, d, "universe").select("record_id", "land_value", "bldg_value")
    return calc.calculate(df, {"lo": ["min", "land_value", "bldg_value"], "hi": ["max", "land_value", "bldg_value"]}).drop("land_value", "bldg_value")


@query(f"""SELECT record_id, CASE WHEN coalesce({_N.format('total_value')}, 0) <= 0 THEN land_value + bldg_value ELSE total_value END AS market_value FROM universe""")
def calc_where(spark, d):
    df = table(spark, d, "universe").select("record_id", "total_value", "land_value", "bldg_value")
    return calc.calculate(df, {"market_value": ["where", ["<=", "total_value", 0], ["+", "land_value", "bldg_value"], "total_value"]}).select("record_id", "market_value")


@query("""SELECT record_id, CASE bldg_type WHEN 'A' THEN 'class a' WHEN 'B' THEN 'class b' ELSE bldg_type END AS kind, CASE CAST(is_vacant AS VARCHAR) WHEN 'true' THEN 'V' WHEN 'false' THEN 'I' END AS vi FROM universe""")
def calc_map(spark, d):
    df = table(spark, d, "universe").select("record_id", "bldg_type", "is_vacant")
    return calc.calculate(df, {"kind": ["map", "bldg_type", {"A": "class a", "B": "class b"}], "vi": ["map", "is_vacant", {"true": "V", "false": "I"}]}).select("record_id", "kind", "vi")


_BLANK = "({0} IS NULL OR lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) IN ('', 'none', 'null', 'n/a', 'na', 'nan', '<na>'))"


@query(f"SELECT record_id, CASE WHEN {_BLANK.format('neighborhood')} THEN 'OTHER' ELSE neighborhood END AS hood, CASE WHEN {_BLANK.format('address')} THEN city ELSE address END AS place, coalesce(city, 'nowhere') AS city_filled FROM universe")
def calc_fillempty(spark, d):
    df = table(spark, d, "universe").select("record_id", "neighborhood", "address", "city")
    return calc.calculate(df, {"hood": ["fillempty", "neighborhood", "str:OTHER"], "place": ["fillempty", "address", "city"], "city_filled": ["fillna", "city", "str:nowhere"]}).select("record_id", "hood", "place", "city_filled")


@query("""SELECT record_id, regexp_replace(address, '^\\s+|\\s+$', '', 'g') AS stripped, regexp_replace(key, '^0+', '') AS no_zero, regexp_replace(regexp_replace(address, '\\s+', '', 'g'), '^0+', '') AS tight,
replace(replace(address, 'Street', 'St'), 'Road', 'Rd') AS shorter, regexp_replace(address, '([0-9]+)', '<\\1>', 'g') AS marked FROM universe""")
def calc_strings(spark, d):
    df = table(spark, d, "universe").select("record_id", "address", "key")
    spec = {
        "stripped": ["strip", "address"], "no_zero": ["striplzero", "key"], "tight": ["stripkey", "address"],
        "shorter": ["replace", "address", {"Street": "St", "Road": "Rd"}], "marked": ["replace_regex", "address", {"([0-9]+)": r"<\1>"}],
    }
    return calc.calculate(df, spec).drop("address", "key")


@query("""SELECT doc_id, coalesce(regexp_matches(text, 'campaign|survey'), false) AS has_any, coalesce(regexp_matches(upper(subject), 'MATH'), false) OR coalesce(regexp_matches(upper(subject), 'STAT'), false) AS maths,
coalesce(trim(source) IN ('journal_export', 'thesis_repo'), false) AS long_form, coalesce(version IN (2, 3), false) AS revised FROM documents""")
def calc_contains(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "subject", "source", "version")
    spec = {"has_any": ["contains", "text", "str:campaign|survey"], "maths": ["contains_case_insensitive", "subject", ["str:math", "str:stat"]], "long_form": ["isin", "source", ["str:journal_export", "str: thesis_repo "]], "revised": ["isin", "version", [2, 3]]}
    return calc.calculate(df, spec).drop("text", "subject", "source", "version")


@query("""SELECT row_id, split_part(key_sale, '---', 1) AS before, CASE WHEN position('---' IN key_sale) = 0 THEN key_sale ELSE substr(key_sale, position('---' IN key_sale) + 3) END AS after,
concat_ws(' / ', CAST(deed_book AS VARCHAR), deed_page) AS deed, substr(key, 4, 7) AS middle, substr(key, greatest(0, length(key) - 3) + 1) AS tail FROM sales""")
def calc_split_join(spark, d):
    df = table(spark, d, "sales").select("row_id", "key_sale", "deed_book", "deed_page", "key")
    spec = {"before": ["split_before", "key_sale", "str:---"], "after": ["split_after", "key_sale", "str:---"], "deed": ["join", ["values", "deed_book", "deed_page"], "str: / "], "middle": ["substr", "key", {"left": 3, "right": 10}], "tail": ["substr", "key", {"left": -3}]}
    return calc.calculate(df, spec).select("row_id", *spec)


@query("SELECT row_id, strftime(try_strptime(sale_year_month || '-01', '%Y-%m-%d'), '%Y-%m-%d') AS day, try_strptime(sale_year_month || '-01', '%Y-%m-%d') AS at FROM sales")
def calc_datetimestr(spark, d):
    df = table(spark, d, "sales").select("row_id", "sale_year_month")
    spec = {"__temp_d": ["+", "sale_year_month", "str:-01"], "day": ["datetimestr", "__temp_d", "str:%Y-%m-%d"], "at": ["datetime", "__temp_d", "str:%Y-%m-%d"]}
    return calc.calculate(df, spec).drop("sale_year_month")


@query("""SELECT row_id, coalesce(trim(model_group) = 'condo', false) AS is_condo, NOT coalesce(model_group = 'condo', false) AS no_condo, NOT (coalesce(valid_sale, false) AND coalesce(vacant_sale, false)) AS odd,
coalesce(valid_sale, false) OR coalesce(vacant_sale, false) AS any_flag, coalesce(sale_year = 2020, false) AS in_2020 FROM sales""")
def calc_logic(spark, d):
    df = table(spark, d, "sales").select("row_id", "model_group", "valid_sale", "vacant_sale", "sale_year")
    flag = lambda c: ["fillna", c, False]
    spec = {"is_condo": ["==", "model_group", "str: condo "], "no_condo": ["!=", "model_group", "str:condo"], "odd": ["not", ["and", flag("valid_sale"), flag("vacant_sale")]], "any_flag": ["or", flag("valid_sale"), flag("vacant_sale")], "in_2020": ["==", "sale_year", 2020]}
    return calc.calculate(df, spec).select("row_id", *spec)


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'STRUCTURE' WHEN 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS c_mktsegment, CASE c_nationkey WHEN 3 THEN 0.0::DOUBLE WHEN 5 THEN -1.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""")
def tweak_update(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    changes = [{"field": "c_mktsegment", "key": "c_mktsegment", "values": {"BUILDING": "STRUCTURE", "MACHINERY": "TOOLS"}}, {"field": "c_acctbal", "key": "c_nationkey", "values": {"3": 0.0, "5": -1.5}}]
    return calc.tweak(df, changes).drop("c_nationkey")


@query("""WITH t AS (SELECT row_id, lower(regexp_replace(deed_book, '^\\s+|\\s+$', '', 'g')) AS s, sale_price AS p, valid_sale AS b FROM sales)
SELECT row_id, CASE WHEN s IS NULL OR s IN ('none', 'nan', 'null', 'na', 'n/a', '-', 'unknown') THEN false WHEN s IN ('true', 't', '1', 'y', 'yes') THEN true WHEN s IN ('false', 'f', '0', 'n', 'no', '') THEN false ELSE true END AS from_text,
CASE WHEN p IS NULL OR isnan(p) THEN true ELSE p <> 0 END AS from_number, coalesce(b, true) AS from_bool FROM t""")
def bool_tokens(spark, d):
    df = table(spark, d, "sales").select("row_id", "deed_book", "sale_price", "valid_sale")
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select("row_id", text.to_bool(F.col("deed_book"), kinds["deed_book"]).alias("from_text"), text.to_bool(F.col("sale_price"), kinds["sale_price"], True).alias("from_number"), text.to_bool(F.col("valid_sale"), kinds["valid_sale"], True).alias("from_bool"))


@query("SELECT record_id, regexp_replace(regexp_replace(lower(address), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM universe")
def slugify(spark, d):
    return table(spark, d, "universe").select("record_id", text.slug(F.col("address")).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN abs(x) >= 1e9 THEN printf('%.1fB', x / 1e9) WHEN abs(x) >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN abs(x) >= 1e3 THEN printf('%.1fK', x / 1e3) ELSE printf('%.1f', x) END AS short
FROM (SELECT o_orderkey, floor(o_totalprice * 4) + 0.3 AS x FROM orders)""")
def fancy_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.fancy(F.floor(F.col("o_totalprice") * 4) + F.lit(0.3)).alias("short"))


@query("SELECT coalesce(avg(CASE WHEN deed_book IS NOT NULL THEN (try_cast(deed_book AS DOUBLE) IS NOT NULL)::INT END) >= 0.95, false) AS numeric FROM sales")
def mostly_numeric(spark, d):
    return text.mostly_numeric(table(spark, d, "sales"), "deed_book")


@query(f"SELECT row_id FROM sales WHERE coalesce({_N.format('sale_price')}, 0) < 100 AND NOT coalesce(sale_year, 0) >= 2018")
def filter_numeric_null0(spark, d):
    return filters.select(table(spark, d, "sales"), ["and", ["<", "sale_price", 100], ["not", [">=", "sale_year", 2018]]]).select("row_id")


@query("SELECT row_id FROM sales WHERE coalesce(model_group IN ('condo', 'townhome'), false) AND NOT coalesce(feed IN ('vendor_bulk'), false) AND sale_year_month >= '2015-06' AND sale_year_month <= '2020-05'")
def filter_isin_notin(spark, d):
    f = ["and", ["isin", "model_group", ["str:condo", "str:townhome"]], ["notin", "feed", ["str:vendor_bulk"]], [">=", "sale_year_month", "str:2015-06"], ["<=", "sale_year_month", "str:2020-05"]]
    return filters.select(table(spark, d, "sales"), f).select("row_id")


@query("SELECT record_id, address IS NULL OR regexp_replace(address, '^\\s+|\\s+$', '', 'g') = '' AS no_address, coalesce(bldg_area_finished_sqft = 0, false) AS zero_area, bldg_area_finished_sqft IS NULL OR bldg_area_finished_sqft = 0 AS none_area FROM universe")
def filter_empty_zero(spark, d):
    df = table(spark, d, "universe")
    return df.select("record_id", *[filters.condition(df, f).alias(n) for n, f in {"no_address": ["isempty", "address"], "zero_area": ["iszero", "bldg_area_finished_sqft"], "none_area": ["iszeroempty", "bldg_area_finished_sqft"]}.items()])


@query("SELECT doc_id FROM documents WHERE coalesce(regexp_matches(text, 'lepton') OR regexp_matches(text, 'quantile'), false) AND coalesce(regexp_matches(lower(subject), 'math|stat'), false)")
def filter_contains(spark, d):
    f = ["and", ["contains", "text", ["lepton", "quantile"]], ["contains_case_insensitive", "subject", "str:MATH|Stat"]]
    return filters.select(table(spark, d, "documents"), f).select("doc_id")


@query("""WITH t AS (SELECT row_id, coalesce(valid_sale, false) AS a, coalesce(vacant_sale, false) AS b, coalesce(sale_year, 0) > 2015 AS c FROM sales)
SELECT row_id, a AND b AND c AS f_and, a OR b OR c AS f_or, (a <> b) <> c AS f_xor, NOT (NOT (a AND b) AND c) AS f_nand, NOT (NOT (a OR b) OR c) AS f_nor, (a = b) = c AS f_xnor FROM t""")
def filter_bool_fold(spark, d):
    df = table(spark, d, "sales")
    each = [["==", "valid_sale", True], ["==", "vacant_sale", True], [">", "sale_year", 2015]]
    return df.select("row_id", *[filters.condition(df, [op, *each]).alias(f"f_{op}") for op in filters.FOLDS])


@query("SELECT row_id FROM sales WHERE CAST(sale_date AS DATE) BETWEEN DATE '2016-03-01' AND DATE '2019-02-28'")
def filter_date_range(spark, d):
    return table(spark, d, "sales").where(dates.in_range(F.col("sale_date"), "2016-03-01", "2019-02-28")).select("row_id")


@query("""SELECT row_id, year(sale_date)::INT AS sale_year, month(sale_date)::INT AS sale_month, day(sale_date)::INT AS sale_day, quarter(sale_date)::INT AS sale_quarter, strftime(sale_date, '%Y-%m') AS sale_year_month,
year(sale_date)::VARCHAR || 'Q' || quarter(sale_date)::VARCHAR AS sale_year_quarter FROM sales""")
def date_parts(spark, d):
    return dates.parts(table(spark, d, "sales").select("row_id", "sale_date"), "sale_date", "sale").drop("sale_date")


@query("""SELECT row_id, date_diff('day', CAST(sale_date AS DATE), DATE '2025-01-01')::INT AS sale_age_days, CASE WHEN sale_year IS NULL OR sale_year <= 0 THEN 0 ELSE 2025 - sale_year END::INT AS age_years FROM sales""")
def ages(spark, d):
    return table(spark, d, "sales").select("row_id", dates.age_days(F.col("sale_date"), "2025-01-01").alias("sale_age_days"), dates.building_age(F.col("sale_year"), F.lit(2025)).alias("age_years"))


@query()
def geo_area(spark, d):
    return calc.calculate(table(spark, d, "block_groups").select("std_geoid", "geometry"), {"acres": ["geo_area", "str:acres"], "sqkm": ["geo_area", "str:sqkm"]}).drop("geometry")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, count(*) OVER () AS n_all FROM events")
def json_field(spark, d):
    df = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_all"))))
