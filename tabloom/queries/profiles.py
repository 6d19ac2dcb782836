"""Profiles, levels, kinds; mixed columns; scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import normal
from tabloom.functions import scalars as s
from tabloom.operators import mixed, privacy, profile, validate
from tabloom.queries.registry import PART_MIXED_SQL, OFFSET_SQL, orders_offset, part_mixed, query, table

NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"


def profile_sql(source: str, order: str, columns: dict[str, str]) -> str:
    """The profile of columns (name -> SQL text of a cell) in plain SQL."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS pos, CAST({e} AS VARCHAR) AS v, {order} AS ord FROM src" for i, (c, e) in enumerate(columns.items()))
    return f"""
WITH src AS ({source}), cells AS ({cells}),
num AS (SELECT *, CASE WHEN regexp_matches(v, '{NUMBER}') THEN TRY_CAST(trim(v) AS DOUBLE) END AS x FROM cells),
stats AS (SELECT name, pos, count(*) AS n, count(v) AS k, count(DISTINCT v) AS u, count(x) AS m, min(x) AS lo, max(x) AS hi FROM num GROUP BY name, pos),
steps AS (SELECT name, x, v, lag(x) OVER (PARTITION BY name ORDER BY ord) AS p FROM num WHERE v IS NOT NULL),
mono AS (SELECT name, bool_and(x IS NOT NULL) AND bool_and(p IS NULL OR x >= p) AS up FROM steps GROUP BY name),
head AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM cells WHERE v IS NOT NULL),
sniff AS (SELECT name, avg(regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')::INT) AS d, avg(regexp_matches(v, '^\\d{{2}}:\\d{{2}}$')::INT) AS t FROM head WHERE rn <= 200 GROUP BY name),
seen AS (SELECT name, v, min(ord) AS f FROM cells WHERE v IS NOT NULL GROUP BY name, v),
lists AS (SELECT name, string_agg(v, '|' ORDER BY f) AS l FROM seen GROUP BY name),
toks AS (SELECT name, string_agg(v, '|' ORDER BY f) AS l FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f) AS rn FROM seen WHERE NOT regexp_matches(v, '{NUMBER}')) WHERE rn <= 100 GROUP BY name),
f AS (SELECT s.*, coalesce(up, false) AS up, d, t, lists.l AS l, toks.l AS tk, CASE WHEN k > 0 THEN m / k ELSE 0 END AS ratio, m > 0 AND m < k AS tokens
  FROM stats s LEFT JOIN mono USING (name) LEFT JOIN sniff USING (name) LEFT JOIN lists USING (name) LEFT JOIN toks USING (name)),
g AS (SELECT *, k > 0 AND (u / n >= 0.98 OR up OR regexp_matches(name, '(?i)(^id$|_id$|patient id|identifier)')) AS idl, ratio >= 0.8 OR (ratio >= 0.5 AND u >= 10) AS nl,
  CASE WHEN tokens AND (ratio >= 0.5 OR (ratio >= 0.2 AND u >= 10 AND regexp_matches(name, '{profile.MEASURE_NAME}'))) THEN 'numeric' END AS mk FROM f),
h AS (SELECT *, CASE WHEN u <= 1 THEN 'constant' WHEN regexp_matches(name, '(?i)(yyyy-mm-dd|date)') OR d >= 0.95 THEN 'datetime' WHEN t >= 0.95 THEN 'time' WHEN idl THEN 'id_like'
  WHEN tokens THEN CASE WHEN u <= 2 THEN 'binary' ELSE 'categorical' END WHEN nl THEN CASE WHEN u <= 2 THEN 'binary' ELSE 'numeric' END
  WHEN u <= 2 THEN 'binary' ELSE 'categorical' END AS kind FROM g)
SELECT name, kind, k < n AS nullable, u AS unique_count, round((n - k) / n, 9) AS missing_rate, nl AS numeric_like, u BETWEEN 1 AND 12 AS low_cardinality, idl AS id_like,
  CASE WHEN kind = 'numeric' THEN lo + 0.0 END AS min_value, CASE WHEN kind = 'numeric' THEN hi + 0.0 END AS max_value,
  CASE WHEN kind IN ('categorical', 'binary', 'id_like') AND u <= 100 THEN l ELSE '' END AS allowed_values, mk AS mixed_value_kind, CASE WHEN mk IS NOT NULL THEN tk ELSE '' END AS mixed_token_values FROM h"""


def _flat(df):
    lists = {c: F.concat_ws("|", c) for c in ("allowed_values", "mixed_token_values")}
    return df.drop("pos", "row_count").withColumns(lists).withColumn("missing_rate", F.round("missing_rate", 9))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
PART = ["size_text", "p_brand", "p_retailprice"]


@query(profile_sql("SELECT * FROM customer", "c_custkey", {c: c for c in CUSTOMER}))
def profile_customer(spark, sf_dir):
    return _flat(profile.profile(table(spark, sf_dir, "customer"), "c_custkey", CUSTOMER))


@query(profile_sql("SELECT * FROM orders", "o_orderkey", {c: c for c in ORDERS}))
def profile_orders(spark, sf_dir):
    return _flat(profile.profile(table(spark, sf_dir, "orders"), "o_orderkey", ORDERS))


LINEITEM = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


@query("SELECT name, unique_count, 0.0::DOUBLE AS missing_rate, unique_count BETWEEN 1 AND 12 AS low_cardinality FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS unique_count FROM lineitem" for c in LINEITEM) + ")")
def profile_lineitem(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("line", F.expr("l_orderkey * 16 + l_linenumber"))
    return profile.profile(line, "line", LINEITEM).select("name", "unique_count", "missing_rate", "low_cardinality")


@query("""WITH c AS (SELECT 'c_custkey' AS name, CAST(c_custkey AS VARCHAR) AS v, c_custkey::DOUBLE AS x, c_custkey AS ord FROM customer UNION ALL SELECT 'c_name', c_name, NULL, c_custkey FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), c_nationkey, c_custkey FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment, NULL, c_custkey FROM customer),
  s AS (SELECT *, lag(x) OVER (PARTITION BY name ORDER BY ord) AS p FROM c)
  SELECT name, count(DISTINCT v)::DOUBLE / count(*) >= 0.98 OR coalesce(bool_and(p IS NULL OR x >= p) AND count(x) = count(*), false) AS id_like FROM s GROUP BY name""")
def id_like_columns(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "customer"), "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).select("name", "id_like")


@query("""SELECT event_id, lpad(CAST(least(23, greatest(0, floor(s / 3600)))::INT AS VARCHAR), 2, '0') || ':' || lpad(CAST(least(59, greatest(0, floor((s - floor(s / 3600) * 3600) / 60)))::INT AS VARCHAR), 2, '0') AS hhmm
  FROM (SELECT event_id, round_even(value * 997.5 - 5000, 0) AS s FROM events)""")
def seconds_to_hhmm(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.seconds_hhmm(F.col("value") * 997.5 - 5000).alias("hhmm"))


@query(f"SELECT p_partkey, coalesce(size_text, '__MISSING__') AS token, CASE WHEN size_text IS NULL THEN '__MISSING__' ELSE '__PRESENT__' END AS there FROM ({PART_MIXED_SQL})")
def missing_tokens(spark, sf_dir):
    return part_mixed(spark, sf_dir).select("p_partkey", s.normalised(F.col("size_text")).alias("token"), s.missingness(F.col("size_text")).alias("there"))


@query(profile_sql(PART_MIXED_SQL, "p_partkey", {c: c for c in PART}))
def profile_mixed(spark, sf_dir):
    return _flat(profile.profile(part_mixed(spark, sf_dir), "p_partkey", PART))


@query("SELECT v AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY min(o_orderkey)) AS place FROM (SELECT o_orderpriority AS v, o_orderkey FROM orders) GROUP BY v")
def first_seen_levels(spark, sf_dir):
    t = profile.frequencies(profile.long_form(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderpriority"]))
    found = profile.levels(t).select(F.posexplode("levels").alias("at", "value"))
    total = t.agg(F.sum("n").alias("total"))
    return t.join(found, "value").crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("at") + 1).cast("long").alias("place"))


@query("""WITH c AS (SELECT 'o_orderkey' AS name, o_orderkey::DOUBLE AS x, o_orderkey AS ord FROM orders UNION ALL SELECT 'o_custkey', o_custkey, o_orderkey FROM orders UNION ALL SELECT 'o_totalprice', o_totalprice, o_orderkey FROM orders),
  s AS (SELECT name, x, lag(x) OVER (PARTITION BY name ORDER BY ord) AS p FROM c) SELECT name, bool_and(p IS NULL OR x >= p) AS monotonic FROM s GROUP BY name""")
def monotonic_flag(spark, sf_dir):
    return profile.monotonic(profile.long_form(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"]))


@query("""SELECT * FROM (SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS unique_count FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
  UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part) WHERE unique_count BETWEEN 1 AND 12""")
def low_cardinality(spark, sf_dir):
    return profile.low_cardinality(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size", "p_type", "p_name"])


@query(f"SELECT size_text IS NULL AS size_text, p_brand IS NULL AS p_brand, count(*) AS n FROM ({PART_MIXED_SQL}) GROUP BY 1, 2")
def missing_mask(spark, sf_dir):
    return profile.missing_mask(part_mixed(spark, sf_dir), ["size_text", "p_brand"]).groupBy("size_text", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT min(c_custkey) AS c_custkey, c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
def distinct_first_rows(spark, sf_dir):
    return profile.distinct_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")


SPLIT = f"""SELECT p_partkey, CASE WHEN regexp_matches(size_text, '{NUMBER}') THEN TRY_CAST(trim(size_text) AS DOUBLE) END AS value,
  CASE WHEN size_text IS NULL THEN '__MISSING__' WHEN regexp_matches(size_text, '{NUMBER}') THEN '__VALUE__' ELSE trim(size_text) END AS state, size_text FROM ({PART_MIXED_SQL})"""


@query(f"SELECT p_partkey, value, state FROM ({SPLIT})")
def mixed_split(spark, sf_dir):
    e = mixed.MixedEncoding("size_text")
    return mixed.split(part_mixed(spark, sf_dir), e).select("p_partkey", F.col(e.value_column).alias("value"), F.col(e.state_column).alias("state"))


SPELL = f"SELECT value AS number, trim(size_text) AS spelling, row_number() OVER (PARTITION BY value ORDER BY count(*) DESC, trim(size_text)) AS rn FROM ({SPLIT}) WHERE value IS NOT NULL GROUP BY value, trim(size_text)"


@query(f"SELECT number, spelling FROM ({SPELL}) WHERE rn = 1")
def mixed_support(spark, sf_dir):
    return mixed.spellings(part_mixed(spark, sf_dir), "size_text")


@query(f"""WITH s AS ({SPLIT}), sp AS (SELECT number, spelling FROM ({SPELL}) WHERE rn = 1)
  SELECT p_partkey, CASE state WHEN '__MISSING__' THEN NULL WHEN '__VALUE__' THEN spelling ELSE state END AS restored FROM s LEFT JOIN sp ON s.value = sp.number""")
def mixed_restore(spark, sf_dir):
    df = part_mixed(spark, sf_dir)
    e = mixed.fit(df, "size_text")
    return mixed.split(df, e).select("p_partkey", mixed.restore(F.col(e.value_column), F.col(e.state_column), e).alias("restored"))


@query("""WITH sup AS (SELECT DISTINCT p_size::DOUBLE AS v FROM part WHERE p_size % 7 = 0),
  r AS (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size + 0.5 - v), v) AS rn FROM part, sup) SELECT p_partkey, v AS snapped FROM r WHERE rn = 1""")
def snap_support(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    values = mixed.support(part.where("p_size % 7 = 0"), "p_size")
    return part.select("p_partkey", s.snap(F.col("p_size") + F.lit(0.5), values).alias("snapped"))


CELLS = ["1d", " 5 ", "1e3", "1,000", "5%", "", "No", "-.5", "+3.", "1e400", "inf", "NaN", "0x10", "12 3"]


@query("SELECT o_orderkey, CASE WHEN regexp_matches(c, '" + NUMBER + "') THEN CASE WHEN abs(TRY_CAST(trim(c) AS DOUBLE)) < 'Infinity'::DOUBLE THEN TRY_CAST(trim(c) AS DOUBLE) END END AS number FROM (SELECT o_orderkey, ([" + ", ".join(f"'{c}'" for c in CELLS) + f"])[o_orderkey % {len(CELLS)} + 1] AS c FROM orders)")
def number_parse(spark, sf_dir):
    cell = F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("o_orderkey") % len(CELLS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.to_double(cell).alias("number"))


@query("SELECT o_orderkey, CASE WHEN c NOT IN (" + ", ".join(f"'{t}'" for t in s.NA_TOKENS) + ") THEN c END AS cell FROM (SELECT o_orderkey, (['NA', 'None', 'n/a', 'No', 'Unknown', '', '#N/A', 'null'])[o_orderkey % 8 + 1] AS c FROM orders)")
def na_tokens(spark, sf_dir):
    cell = F.element_at(F.array(*[F.lit(c) for c in ("NA", "None", "n/a", "No", "Unknown", "", "#N/A", "null")]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.na_to_null(cell).alias("cell"))


@query("SELECT event_id, strftime(ts, '%H:%M') AS hhmm, (hour(ts) * 3600 + minute(ts) * 60)::DOUBLE AS seconds, strftime(ts, '%H:%M') AS again, epoch(ts::DATE)::DOUBLE AS day_seconds, strftime(ts::DATE, '%Y-%m-%d') AS day FROM events")
def epoch_seconds(spark, sf_dir):
    hhmm, day = F.date_format("ts", "HH:mm"), F.date_format("ts", "yyyy-MM-dd")
    seconds = s.epoch_seconds(day)
    return table(spark, sf_dir, "events").select("event_id", hhmm.alias("hhmm"), s.hhmm_seconds(hhmm).alias("seconds"), s.seconds_hhmm(s.hhmm_seconds(hhmm)).alias("again"), seconds.alias("day_seconds"), s.epoch_to_date(seconds).alias("day"))


@query(f"SELECT o_orderkey, strftime(base::DATE + TRY_CAST(nights AS INTEGER), '%Y-%m-%d') AS expected, date_diff('day', base::DATE, target::DATE)::DOUBLE AS days FROM ({OFFSET_SQL})")
def offset_dates(spark, sf_dir):
    return orders_offset(spark, sf_dir).select("o_orderkey", s.offset_date(F.col("base"), F.col("nights")).alias("expected"), s.day_difference(F.col("target"), F.col("base")).alias("days"))


@query("SELECT p_partkey, round_even(p_size / 2.0::DOUBLE, 0) + 0.0 AS half, CASE WHEN p_size < 10 THEN 10.0 WHEN p_size > 40 THEN 40.0 ELSE p_size::DOUBLE END AS clipped, (p_size / (p_size + 1.0::DOUBLE)) AS squashed, p_retailprice / nullif(pow((p_size % 5) / 100.0::DOUBLE, 2), 0) AS ratio FROM part")
def rounding(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", s.half_even(size / 2.0).alias("half"), s.clip(size, 10, 40).alias("clipped"), s.squash(size).alias("squashed"), s.bmi(F.col("p_retailprice"), F.col("p_size") % 5).alias("ratio"))


@query(f"SELECT c_custkey, round({normal.quantile_sql('u')}, 9) AS z, round({normal.distribution_sql('x')}, 9) AS p FROM (SELECT c_custkey, {normal.inside_sql('uu')} AS u, x FROM (SELECT c_custkey, {normal.uniform_sql(7, 'c_custkey', 'z')} AS uu, (c_custkey % 160 - 80) / 10.0::DOUBLE AS x FROM customer))")
def normal_functions(spark, sf_dir):
    u = normal.inside(normal.uniform(7, F.col("c_custkey"), "z"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", u.alias("u"), ((F.col("c_custkey") % 160 - 80) / F.lit(10.0)).alias("x"))
    return rows.select("c_custkey", F.round(normal.quantile(F.col("u")), 9).alias("z"), F.round(normal.distribution(F.col("x")), 9).alias("p"))


@query("SELECT c_custkey, c_mktsegment || '|' || coalesce(CAST(CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS VARCHAR), '__MISSING__') AS row_key, CASE WHEN c_nationkey = 3 THEN '__MISSING__' ELSE '__PRESENT__' END AS there FROM customer")
def row_keys(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("nation", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")))
    return df.select("c_custkey", s.row_key(["c_mktsegment", "nation"]).alias("row_key"), s.missingness(F.col("nation")).alias("there"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def hash_sample(spark, sf_dir):
    return privacy.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 200")
def head_rows(spark, sf_dir):
    return validate.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 200)
