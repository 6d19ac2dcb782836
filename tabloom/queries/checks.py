"""Privacy, similarity, selection, conformance and plausibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.scalars import scaled_quota
from tabloom.operators import conform, privacy, profile, select, validate
from tabloom.operators.profile import ColumnProfile, Schema
from tabloom.queries.registry import BLANK_SQL, halves, orders_blank, part_mixed, query, table

PROJECTED = "c_custkey, c_mktsegment, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation"
COLUMNS = ["c_mktsegment", "nation"]


def _customers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"))
    return df.where("c_custkey % 10 = 0"), df.where("c_custkey % 10 <> 0")


SPLIT = f"WITH c AS (SELECT {PROJECTED} FROM customer), real AS (SELECT * FROM c WHERE c_custkey % 10 = 0), syn AS (SELECT * FROM c WHERE c_custkey % 10 <> 0)"
MATCH = "EXISTS (SELECT 1 FROM real r WHERE r.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment AND r.nation IS NOT DISTINCT FROM s.nation)"


@query(f"{SPLIT} SELECT c_custkey, c_mktsegment, nation FROM syn s WHERE NOT {MATCH}")
def exact_match_filter(spark, sf_dir):
    real, syn = _customers(spark, sf_dir)
    return privacy.without_matches(syn, real, COLUMNS)


@query(f"{SPLIT} SELECT c_custkey, c_mktsegment, nation FROM syn s WHERE NOT {MATCH}")
def exact_match_keys(spark, sf_dir):
    real, syn = _customers(spark, sf_dir)
    return privacy.without_keys(syn, real, COLUMNS)


@query(f"{SPLIT} SELECT round(avg(({MATCH})::INT), 9) AS exact_match_rate FROM syn s")
def exact_match_rate(spark, sf_dir):
    real, syn = _customers(spark, sf_dir)
    return privacy.exact_match_rate(syn, real, COLUMNS).select(F.round("exact_match_rate", 9).alias("exact_match_rate"))


@query(f"{SPLIT} SELECT round(avg((rn > 1)::INT), 9) AS duplicate_rate FROM (SELECT row_number() OVER (PARTITION BY c_mktsegment, nation) AS rn FROM syn)")
def duplicate_rate(spark, sf_dir):
    return privacy.duplicate_rate(_customers(spark, sf_dir)[1], COLUMNS).select(F.round("duplicate_rate", 9).alias("duplicate_rate"))


@query(f"{SPLIT} SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, nation ORDER BY c_custkey) > 1 AS again FROM syn")
def duplicate_flags(spark, sf_dir):
    syn = _customers(spark, sf_dir)[1]
    return syn.select("c_custkey", profile.duplicate_flag(COLUMNS, "c_custkey").alias("again"))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows, rows.where("vec_id % 5 = 0")


NEAR = "SELECT a.vec_id, min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 5 = 0 AND {} GROUP BY a.vec_id"


@query(f"SELECT vec_id, round(distance, 6) AS distance FROM ({NEAR.format('a.vec_id % 5 <> 0')})")
def nn_distance(spark, sf_dir):
    rows, source = _vectors(spark, sf_dir)
    return privacy.nearest_of_all(rows.where("vec_id % 5 <> 0"), "vec_id", "embedding", source).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(distance, 6) AS distance FROM ({NEAR.format('a.vec_id % 5 = 0 AND a.vec_id <> b.vec_id')})")
def self_nn(spark, sf_dir):
    rows, source = _vectors(spark, sf_dir)
    return privacy.nearest_of_all(rows.where("vec_id % 5 = 0"), "vec_id", "embedding", source, other=True).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance, round(quantile_cont(distance, 0.05), 6) AS p05_distance FROM ({NEAR.format('a.vec_id % 5 <> 0')})")
def nn_summary(spark, sf_dir):
    rows, source = _vectors(spark, sf_dir)
    found = privacy.summary(privacy.nearest_of_all(rows.where("vec_id % 5 <> 0"), "vec_id", "embedding", source))
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


@query(f"SELECT round(greatest(0.1, quantile_cont(distance, 0.2)), 6) AS min_distance FROM ({NEAR.format('a.vec_id % 5 = 0 AND a.vec_id <> b.vec_id')})")
def privacy_threshold(spark, sf_dir):
    rows, source = _vectors(spark, sf_dir)
    found = privacy.threshold(privacy.nearest_of_all(rows.where("vec_id % 5 = 0"), "vec_id", "embedding", source, other=True), 0.1, 0.2)
    return found.select(F.round("min_distance", 6).alias("min_distance"))


@query(f"""{SPLIT}, m AS (SELECT avg(({MATCH})::INT) AS e FROM syn s), d AS (SELECT avg((rn > 1)::INT) AS d FROM (SELECT row_number() OVER (PARTITION BY c_mktsegment, nation) AS rn FROM syn)),
  n AS (SELECT median(distance) AS n FROM ({NEAR.format('a.vec_id % 5 <> 0')})) SELECT round(least(1, greatest(0, (1 - e) * (1 - d) * n / (1 + n))), 6) AS privacy_score FROM m, d, n""")
def privacy_score(spark, sf_dir):
    real, syn = _customers(spark, sf_dir)
    rows, source = _vectors(spark, sf_dir)
    near = privacy.summary(privacy.nearest_of_all(rows.where("vec_id % 5 <> 0"), "vec_id", "embedding", source))
    joined = near.crossJoin(privacy.exact_match_rate(syn, real, COLUMNS)).crossJoin(privacy.duplicate_rate(syn, COLUMNS))
    return joined.select(F.round(privacy.privacy_score(F.col("exact_match_rate"), F.col("duplicate_rate"), F.col("median_distance")), 6).alias("privacy_score"))


@query("""WITH d AS (SELECT l_quantity AS value, l_returnflag = 'A' AS is_real FROM lineitem), c AS (SELECT value, count(*) FILTER (is_real) AS r, count(*) FILTER (NOT is_real) AS s FROM d GROUP BY value),
  f AS (SELECT sum(r) OVER (ORDER BY value) / sum(r) OVER () AS a, sum(s) OVER (ORDER BY value) / sum(s) OVER () AS b FROM c) SELECT 'l_quantity' AS name, round(1 - max(abs(a - b)), 3) AS similarity FROM f""")
def ks_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("l_quantity").alias("name"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "A").alias("is_real"))
    return validate.ks_similarity(rows)


HALVES = "WITH o AS (SELECT o_orderkey, o_orderkey % 2 AS odd, o_orderpriority, CASE WHEN o_orderkey % 11 < 4 AND o_orderkey % 2 = 1 THEN 'O' ELSE o_orderstatus END AS status FROM orders)"
SHARES = HALVES + """, l AS (SELECT o_orderkey, odd, 'o_orderpriority' AS feature, o_orderpriority AS value FROM o UNION ALL SELECT o_orderkey, odd, 'status', status FROM o),
  c AS (SELECT feature, value, count(*) FILTER (odd = 0)::DOUBLE AS r, count(*) FILTER (odd = 1)::DOUBLE AS p FROM l GROUP BY ALL),
  s AS (SELECT feature, value, r / sum(r) OVER (PARTITION BY feature) AS r, p / sum(p) OVER (PARTITION BY feature) AS p FROM c),
  v AS (SELECT *, CASE WHEN p > 0 THEN greatest(p - r, 0) / p ELSE 0 END - 1.5::DOUBLE * CASE WHEN r > 0 THEN greatest(r - p, 0) / r ELSE 0 END AS score FROM s)"""


def _schema():
    common = {"nullable": False, "missing_rate": 0.0, "numeric_like": False, "low_cardinality": True, "id_like": False, "min_value": None, "max_value": None, "allowed_values": [], "mixed_value_kind": None, "mixed_token_values": []}
    return Schema([ColumnProfile("o_orderpriority", "categorical", unique_count=5, **common), ColumnProfile("status", "categorical", unique_count=3, **common)])


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when((F.col("o_orderkey") % 11 < 4) & (F.col("o_orderkey") % 2 == 1), "O").otherwise(F.col("o_orderstatus")).alias("status"))
    found = select.features(_schema())
    return o, found, select.long_features(o.where("o_orderkey % 2 = 0"), "o_orderkey", found), select.long_features(o.where("o_orderkey % 2 = 1"), "o_orderkey", found)


@query(SHARES + " SELECT feature, value, round(r, 9) AS real_share, round(p, 9) AS pool_share, round(score, 9) AS score FROM v")
def freq_surplus_deficit(spark, sf_dir):
    _, _, real, pool = _halves(spark, sf_dir)
    found = select.value_scores(real, pool)
    return found.select("feature", "value", *[F.round(c, 9).alias(c) for c in ("real_share", "pool_share", "score")])


@query(SHARES + " SELECT l.o_orderkey AS ord, round(sum(score), 9) AS score FROM l JOIN v USING (feature, value) WHERE odd = 1 GROUP BY 1")
def balance_scores(spark, sf_dir):
    _, _, real, pool = _halves(spark, sf_dir)
    return select.row_scores(pool, select.value_scores(real, pool), None).select("ord", F.round("score", 9).alias("score"))


@query()
def balanced_select(spark, sf_dir):
    """Rows kept by the greedy drop: no SQL stands beside it, a test holds it to a plain loop."""
    o, _, _, _ = _halves(spark, sf_dir)
    pool, real = o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0")
    return select.balanced(pool, real, _schema(), "o_orderkey", int(pool.count() * 0.9))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 ORDER BY o_orderkey LIMIT 500")
def head_select(spark, sf_dir):
    real, pool = halves(spark, sf_dir, "o_orderkey, o_orderpriority")
    return select.select_rows(pool, real, _schema(), "o_orderkey", 500)


@query("""WITH c AS (SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1), r AS (SELECT *, n::DOUBLE / sum(n) OVER ()::DOUBLE * 1003 AS raw FROM c),
  b AS (SELECT *, floor(raw) AS base, raw - floor(raw) AS rest FROM r), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, first) AS place, 1003 - sum(base) OVER () AS spare FROM b)
  SELECT value, base::BIGINT + CASE WHEN place <= spare THEN 1 ELSE 0 END AS share FROM k""")
def largest_remainder(spark, sf_dir):
    counts = conform.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    return conform.apportion(counts, F.lit(1003)).select("value", "share")


@query("SELECT c_nationkey, CASE WHEN n > 0 THEN greatest(1, least(40, round_even(n::DOUBLE / t * 40, 0)::BIGINT)) ELSE 0 END AS quota FROM (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS n, (SELECT count(*) FROM customer) AS t FROM customer GROUP BY 1)")
def scaled_quotas(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    counts = customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n")).crossJoin(F.broadcast(customer.agg(F.count("*").alias("t"))))
    return counts.select("c_nationkey", scaled_quota(F.col("n"), F.col("t"), F.lit(40)).alias("quota"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (tok) AS BIGINT) AS tokens, CAST(greatest(1, least(count(*), round_even(count(*) FILTER (p_partkey % 13 <> 0 AND p_partkey % 11 = 0)::DOUBLE / count(*) * count(*), 0)::BIGINT)) AS BIGINT) AS quota FROM (SELECT p_partkey, p_partkey % 13 <> 0 AND p_partkey % 11 = 0 AS tok FROM part)")
def token_quota(spark, sf_dir):
    real = part_mixed(spark, sf_dir).select("p_partkey", "size_text")
    stripped = real.withColumn("size_text", F.when(F.col("size_text") != "Unknown", F.col("size_text")))
    made = conform.coerce_text(stripped, real, "size_text", "p_partkey", True)
    wanted = real.agg(F.count("*").alias("n"), F.count_if(F.col("size_text") == "Unknown").alias("t"))
    got = made.agg(F.count("*").alias("rows"), F.count_if(F.col("size_text") == "Unknown").alias("tokens"))
    return got.crossJoin(wanted).select("rows", "tokens", scaled_quota(F.col("t"), F.col("n"), F.col("rows")).alias("quota"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN (SELECT mode FROM (SELECT parent AS mode, count(*) AS n FROM ({BLANK_SQL}) WHERE parent IS NOT NULL GROUP BY 1 ORDER BY n DESC, mode LIMIT 1)) END AS parent FROM orders")
def anchor_mode(spark, sf_dir):
    real = orders_blank(spark, sf_dir).select("o_orderkey", "parent")
    return conform.coerce_text(real.withColumn("parent", F.lit(None).cast("string")), real, "parent", "o_orderkey", False)


@query("SELECT bool_and(l_quantity BETWEEN 1 AND 50) AS quantities, avg((abs(l_extendedprice / pow((100 + 10 * l_linenumber) / 100.0::DOUBLE, 2) - given) < 2)::INT) > 0.9 AS near, avg((abs(l_extendedprice / pow((100 + 10 * l_linenumber) / 100.0::DOUBLE, 2) - l_extendedprice) < 2)::INT) > 0.9 AS far, bool_and(coalesce(l_returnflag IN ('A', 'N', 'R'), false)) AS flags FROM (SELECT *, l_extendedprice / pow((100 + 10 * l_linenumber) / 100.0::DOUBLE, 2) * CASE WHEN l_orderkey % 20 = 0 THEN 1.5 ELSE 1.0 END AS given FROM lineitem)")
def sanity_flags(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    price, height = F.col("l_extendedprice"), 100 + 10 * F.col("l_linenumber")
    given = price / F.pow(height / 100.0, F.lit(2.0)) * F.when(F.col("l_orderkey") % 20 == 0, 1.5).otherwise(1.0)  # one order in twenty is off
    near, far = (validate.plausible_ratio(price, height, actual) for actual in (given, price))
    return line.agg(validate.plausible_range(F.col("l_quantity"), 1, 50).alias("quantities"), near.alias("near"), far.alias("far"), validate.plausible_values(F.col("l_returnflag"), ["A", "N", "R"]).alias("flags"))


@query("SELECT * FROM (VALUES ('Column 1: expected ''n_name'', got ''r_name'''), ('Column 2: expected ''n_regionkey'', got ''x'''), ('Column 0: expected ''n_nationkey'', got ''r_regionkey'''), ('Too few rows: expected at least 25, got 5')) t(error)")
def format_check(spark, sf_dir):
    errors = validate.check_format(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").withColumn("x", F.lit(1)))
    return spark.createDataFrame([(e,) for e in errors], "error string")


@query("SELECT n_regionkey, n_name, CAST(NULL AS VARCHAR) AS extra FROM nation")
def reindex(spark, sf_dir):
    return conform.reindex(table(spark, sf_dir, "nation"), ["n_regionkey", "n_name", "extra"])
