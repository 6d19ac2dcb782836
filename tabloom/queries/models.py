"""Marginals, latent scores, sampling, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import normal
from tabloom.functions.scalars import level_code, pick_interval, to_double
from tabloom.operators import baseline, copula, encode, profile
from tabloom.queries.registry import PART_MIXED_SQL, part_mixed, query, table

SEED = 42


@query("SELECT c_nationkey::DOUBLE AS value, count(*) AS n, (sum(rank) / count(*) - 0) AS before, (any_value(avgrank) / (any_value(total) + 1.0::DOUBLE)) AS p FROM (SELECT c_nationkey, rank() OVER (ORDER BY c_nationkey) - 1.0::DOUBLE AS rank, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0::DOUBLE AS avgrank, count(*) OVER () AS total FROM customer) GROUP BY c_nationkey")
def midrank(spark, sf_dir):
    found = copula.midranks(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("double").alias("v")), "v")
    return found.select("value", "n", F.col("before").cast("double").alias("before"), "p")


LATENT = """SELECT c_custkey, v, CASE WHEN v IS NULL THEN {miss} ELSE {there} END AS p FROM (SELECT c_custkey, v, m, (rank() OVER (PARTITION BY v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / (count(v) OVER () + 1.0::DOUBLE) AS r
  FROM (SELECT c_custkey, v, avg((v IS NULL)::INT) OVER () AS m FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS v FROM customer)))""".format(miss=normal.inside_sql("m / 2"), there=normal.inside_sql("m + (1 - m) * r"))


@query(f"SELECT c_custkey, round({normal.quantile_sql('p')}, 9) AS z FROM ({LATENT})")
def latent_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("v"))
    rate = df.agg(F.avg(F.col("v").isNull().cast("double"))).first()[0]
    joined = df.join(copula.midranks(df, "v").select(F.col("value").alias("rv"), "p"), F.col("v") == F.col("rv"), "left")
    return joined.select("c_custkey", copula.latent_numeric(joined, "v", rate).alias("u")).select("c_custkey", F.round(normal.quantile(F.col("u")), 9).alias("z"))


SHARES = "SELECT v, n, f, n / sum(n) OVER () AS share, (sum(n) OVER (ORDER BY f) - n / 2.0::DOUBLE) / sum(n) OVER () AS mid FROM (SELECT o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1)"


@query(f"SELECT v AS value, n, round(share, 9) AS share, round(mid, 9) AS mid, round({normal.quantile_sql('mid')}, 9) AS z FROM ({SHARES})")
def latent_categorical(spark, sf_dir):
    found = copula.category_shares(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    return found.select("value", "n", F.round("share", 9).alias("share"), F.round("mid", 9).alias("mid"), F.round(normal.quantile(normal.inside(F.col("mid"))), 9).alias("z"))


@query(f"""WITH v AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS a, count(*)::DOUBLE AS n FROM customer), u AS (SELECT c_custkey, {normal.uniform_sql(3, 'c_custkey', 'q')} AS u FROM customer),
  h AS (SELECT c_custkey, a, n, least(n, greatest(1.0::DOUBLE, u * n)) AS h FROM u, v) SELECT c_custkey, round(a[floor(h)::BIGINT] + (h - floor(h)) * (a[least(floor(h) + 1, n)::BIGINT] - a[floor(h)::BIGINT]), 6) AS value FROM h""")
def quantile_type4(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    asked = customer.select("c_custkey", normal.uniform(3, F.col("c_custkey"), "q").alias("u"))
    found = copula.quantiles4(asked, "u", customer, "c_acctbal", "c_custkey")
    return found.select("c_custkey", F.round("value", 6).alias("value"))


@query(f"""WITH s AS (SELECT v, sum(n) OVER (ORDER BY f) / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY f) - n) / sum(n) OVER () AS lo FROM ({SHARES})), u AS (SELECT c_custkey, {normal.uniform_sql(5, 'c_custkey', 'c')} AS u FROM customer)
  SELECT c_custkey, v AS value FROM u JOIN s ON u.u >= s.lo AND u.u < s.hi""")
def inverse_categorical(spark, sf_dir):
    rows = sorted(copula.category_shares(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").collect(), key=lambda r: r.first)
    counts = [r.n for r in rows]
    upper = [sum(counts[: i + 1]) / sum(counts) for i in range(len(counts))]
    u = normal.uniform(5, F.col("c_custkey"), "c")
    return table(spark, sf_dir, "customer").select("c_custkey", pick_interval(u, upper, [r.value for r in rows]).alias("value"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[:i]) + ")")
def latent_corr(spark, sf_dir):
    matrix = copula.correlation(table(spark, sf_dir, "lineitem").select(MEASURES), MEASURES)
    rows = [(a, b, round(float(matrix[i, j]), 6)) for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES[:i])]
    return spark.createDataFrame(rows, "a string, b string, r double")


PAIR = f"""WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem), d AS (SELECT i, {normal.inside_sql(normal.uniform_sql(SEED, 'i', 'x'))} AS u1, {normal.inside_sql(normal.uniform_sql(SEED, 'i', 'y'))} AS u2 FROM range(1000) t(i)),
  z AS (SELECT i, {normal.quantile_sql('u1')} AS n1, {normal.quantile_sql('u2')} AS n2 FROM d), x AS (SELECT i, n1, r * n1 + sqrt(1 - r * r) * n2 AS n2 FROM z, c)
  SELECT i AS row_id, round({normal.distribution_sql('n1')}, 8) AS u1, round({normal.distribution_sql('n2')}, 8) AS u2 FROM x"""


@query(PAIR)
def copula_2col_sample(spark, sf_dir):
    r = round(float(copula.correlation(table(spark, sf_dir, "lineitem").select(MEASURES[:2]), MEASURES[:2])[0, 1]), 6)
    drawn = normal.drawn(spark.range(1000).withColumnRenamed("id", "row_id"), {"x": "x", "y": "y"}, SEED, "row_id")
    mixed = drawn.select("row_id", "x", (F.lit(r) * F.col("x") + F.sqrt(F.lit(1 - r * r)) * F.col("y")).alias("y"))
    return mixed.select("row_id", F.round(normal.distribution(F.col("x")), 8).alias("u1"), F.round(normal.distribution(F.col("y")), 8).alias("u2"))


@query()
def copula_sample(spark, sf_dir):
    """All of a fitted copula's rows: no SQL stands beside it, tests hold its marginals and correlations."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    schema = profile.infer_schema(df, "c_custkey", ["c_nationkey", "c_acctbal", "c_mktsegment"])
    return copula.GaussianCopula(SEED).fit(df, schema, "c_custkey").sample(spark, schema.row_count)


@query(f"""WITH n AS (SELECT row_number() OVER (ORDER BY c_custkey) AS rn, c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL), t AS (SELECT count(*) AS t FROM n), d AS (SELECT i, floor({normal.uniform_sql(SEED, 'i', 'c_mktsegment')} * t)::BIGINT + 1 AS rn FROM range(2000) r(i), t)
  SELECT i AS row_id, v AS c_mktsegment FROM d JOIN n USING (rn)""")
def baseline_bootstrap(spark, sf_dir):
    rows = spark.range(2000).withColumnRenamed("id", "row_id")
    return baseline.bootstrap(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", rows, "row_id", SEED)


@query(f"SELECT i AS row_id, round(CASE WHEN {normal.uniform_sql(SEED + 1, 'i', 'c_acctbal')} >= 0.0 THEN lo + {normal.uniform_sql(SEED, 'i', 'c_acctbal')} * (hi - lo) END, 6) AS c_acctbal FROM range(2000) r(i), (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def baseline_uniform(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    schema = profile.infer_schema(df, "c_custkey", ["c_acctbal"])
    schema.columns[0].kind = "numeric"
    schema.columns[0].min_value, schema.columns[0].max_value = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    made = baseline.IndependentBaseline(SEED).fit(df, schema, "c_custkey", {"numeric_strategy": "uniform"}).sample(spark, 2000, order="row_id")
    return made.select("row_id", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"SELECT i AS row_id, CASE WHEN row_number() OVER (ORDER BY {normal.uniform_sql(SEED, 'i', 'r_name')}, i) > round_even(0.3 * 505, 0) THEN 'ASIA' END AS r_name FROM range(505) r(i)")
def constant_sample(spark, sf_dir):
    marginal = copula.Marginal("r_name", "constant", 0.3, values=["ASIA"])
    return copula.constant_cells(spark.range(505).withColumnRenamed("id", "row_id"), marginal, "r_name", 505, "row_id", SEED)


@query(f"SELECT i AS row_id, round(CASE WHEN {normal.uniform_sql(SEED + 1, 'i', 'c_acctbal')} >= m THEN lo + {normal.uniform_sql(SEED, 'i', 'c_acctbal')} * (hi - lo) END, 6) AS c_acctbal FROM range(2000) r(i), (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, (SELECT avg((c_custkey % 4 = 0)::INT) FROM customer) AS m FROM customer WHERE c_custkey % 4 <> 0)")
def baseline_missing(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    schema = profile.infer_schema(df, "c_custkey", ["c_acctbal"])
    schema.columns[0].kind = "numeric"
    schema.columns[0].min_value, schema.columns[0].max_value = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    made = baseline.IndependentBaseline(SEED).fit(df, schema, "c_custkey", {"numeric_strategy": "uniform"}).sample(spark, 2000, order="row_id")
    return made.select("row_id", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("SELECT o_orderkey, CASE WHEN CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END IS NOT NULL THEN coalesce(list_position(['5-LOW', '1-URGENT', '2-HIGH'], o_orderpriority) - 1, -1)::DOUBLE END AS code FROM orders")
def level_codes(spark, sf_dir):
    c = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", level_code(c, ["5-LOW", "1-URGENT", "2-HIGH"]).alias("code"))


SIZES_SQL = f"SELECT p_partkey, CASE WHEN regexp_matches(size_text, '^[0-9.]+$') THEN CAST(size_text AS DOUBLE) END AS v, CASE WHEN size_text IS NULL THEN '__MISSING__' WHEN regexp_matches(size_text, '^[0-9.]+$') THEN '__VALUE__' ELSE size_text END AS s, p_retailprice AS price FROM ({PART_MIXED_SQL})"


def _part_schema(spark, sf_dir):
    df = part_mixed(spark, sf_dir).select("p_partkey", "size_text", "p_retailprice")
    schema = profile.infer_schema(df, "p_partkey", ["size_text", "p_retailprice"])
    price = schema.get("p_retailprice")
    price.kind, price.mixed_value_kind = "numeric", None
    return df, schema


@query(f"SELECT p_partkey, coalesce(v, (SELECT median(v) FROM ({SIZES_SQL}))) AS size_value, list_position((SELECT list(s ORDER BY f) FROM (SELECT s, min(p_partkey) AS f FROM ({SIZES_SQL}) GROUP BY s)), s) - 1.0::DOUBLE AS size_state, price FROM ({SIZES_SQL})")
def encode_features(spark, sf_dir):
    df, schema = _part_schema(spark, sf_dir)
    p = encode.fit(df, schema, "p_partkey")
    return encode.transform(df, p, "p_partkey").select("p_partkey", F.col("size_text__value").alias("size_value"), F.col("size_text__state").alias("size_state"), F.col("p_retailprice").alias("price"))


@query(f"SELECT p_partkey, size_text AS size_text FROM ({PART_MIXED_SQL}) WHERE NOT coalesce(regexp_matches(size_text, '^[0-9.]+$'), false)")
def decode_tokens(spark, sf_dir):
    df, schema = _part_schema(spark, sf_dir)
    p = encode.fit(df, schema, "p_partkey")
    again = encode.decode(encode.transform(df, p, "p_partkey"), p, "p_partkey")
    return again.where(F.col("size_text").isNull() | to_double(F.col("size_text")).isNull()).select("p_partkey", "size_text")


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT::DOUBLE AS is_{v.lower()}" for v in "OFP") + ", 0.0::DOUBLE AS is_missing FROM orders")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    schema = profile.infer_schema(df, "o_orderkey", ["o_orderstatus"])
    flags = encode.one_hot(encode.fit(df, schema, "o_orderkey"))
    return df.select("o_orderkey", *[e.alias("is_" + name.split("=")[1].strip("_").lower()) for name, e in flags.items()])


@query("SELECT c_custkey, round((coalesce(v, m) - m) / s, 6) AS balance, b AS flag, 0.0::DOUBLE AS same FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS v, (c_custkey % 2)::DOUBLE AS b FROM customer), (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 9 <> 0)")
def standardize(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("balance"), (F.col("c_custkey") % 2).cast("double").alias("flag"), F.lit(7.0).alias("same"))
    return encode.scaled(df, ["balance", "flag", "same"]).withColumn("balance", F.round("balance", 6))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS f0, " + ", ".join(f"(c_mktsegment = '{v}')::INT::DOUBLE AS is_{v.lower()}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def encode_distance(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    schema = profile.infer_schema(df, "c_custkey", ["c_acctbal", "c_mktsegment"])
    schema.columns[0].kind = "numeric"
    flat, names = encode.for_distance(df, schema, "c_custkey")
    flags = [F.col(f"f{i}").alias("is_" + n.split("=")[1].lower()) for i, n in enumerate(names) if "=" in n and not n.endswith("__MISSING__")]
    return flat.select("c_custkey", F.round("f0", 6).alias("f0"), *flags)
