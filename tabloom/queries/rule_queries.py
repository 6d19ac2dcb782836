"""Constraints: rates of violations, repair, alignment of blanks and missing cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.scalars import offset_date
from tabloom.operators import rules, validate
from tabloom.operators.rules import ConditionalBlank, Constraints, Derived
from tabloom.plans.ordering import numbered, spread, spread_sql
from tabloom.queries.registry import BLANK_SQL, CHARGE_SQL, OFFSET_SQL, lineitem_charge, orders_blank, orders_offset, query, table

RANGES = {"l_quantity": (5.0, 45.0), "l_extendedprice": (1000.0, 60000.0), "l_discount": (0.0, 0.08)}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
CHARGED = Derived("charge", ["l_extendedprice", "l_discount"], lambda: F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), "numeric", 2.0)
STATUS = Derived("l_linestatus", ["expected_status"], lambda: F.col("expected_status"), "categorical")
DATED = Derived("target", ["base", "nights"], lambda: offset_date(F.col("base"), F.col("nights")), "datetime", 1.0, 0.25)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'range' AS rule, '{c}' AS name, avg((NOT ({c} BETWEEN {a} AND {b}))::INT)::DOUBLE AS rate FROM lineitem" for c, (a, b) in RANGES.items()) + ")")
def range_violations(spark, sf_dir):
    return rules.violations(table(spark, sf_dir, "lineitem"), Constraints(ranges=RANGES))


@query("SELECT 'category' AS rule, 'o_orderpriority' AS name, avg((o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))::INT)::DOUBLE AS rate FROM orders")
def category_violations(spark, sf_dir):
    return rules.violations(table(spark, sf_dir, "orders"), Constraints(allowed={"o_orderpriority": PRIORITIES}))


WRONG_CHARGE = "coalesce(abs(charge - l_extendedprice * (1 - l_discount)) > 2, false)"


@query(f"SELECT 'derived' AS rule, 'charge' AS name, avg(({WRONG_CHARGE})::INT)::DOUBLE AS rate FROM ({CHARGE_SQL}) UNION ALL SELECT 'derived', 'l_linestatus', avg((l_linestatus <> expected_status)::INT)::DOUBLE FROM ({CHARGE_SQL})")
def derived_violations(spark, sf_dir):
    return rules.violations(lineitem_charge(spark, sf_dir), Constraints(derived=[CHARGED, STATUS]))


EXPECTED = "base::DATE + TRY_CAST(nights AS INTEGER)"


@query(f"SELECT o_orderkey, coalesce(abs(date_diff('day', {EXPECTED}, target::DATE)) > 1, false) AS off FROM ({OFFSET_SQL})")
def derived_date(spark, sf_dir):
    return orders_offset(spark, sf_dir).select("o_orderkey", rules.off_derived(DATED).alias("off"))


@query("SELECT event_id, abs(epoch(ts - ts::DATE::TIMESTAMP) - (event_id % 86400 // 60) * 60) > 43200 AS off FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)")
def derived_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("at"))
    minutes = F.floor(F.col("event_id") % 86400 / 60)
    other = F.concat_ws(":", F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return e.select("event_id", rules.off_derived(Derived("at", ["event_id"], lambda: other, "time", 43200.0)).alias("off"))


INACTIVE_SQL = "coalesce(parent = 'Never' OR starts_with(parent, 'No'), false)"
BLANK = ConditionalBlank("parent", ["child", "other"], ["No"], ["Never"])


@query(f"""SELECT 'conditional_blank' AS rule, 'parent' AS name, (coalesce(avg(CASE WHEN {INACTIVE_SQL} THEN (child IS NOT NULL)::INT END), 0) + coalesce(avg(CASE WHEN {INACTIVE_SQL} THEN (other IS NOT NULL)::INT END), 0)) / 2.0::DOUBLE AS rate
  FROM ({BLANK_SQL})""")
def conditional_blank_rates(spark, sf_dir):
    return rules.violations(orders_blank(spark, sf_dir), Constraints(blanks=[BLANK]))


@query(f"""WITH a AS (SELECT o_orderkey, parent, CASE WHEN NOT {INACTIVE_SQL} THEN other END AS other, CASE WHEN NOT {INACTIVE_SQL} THEN child END AS child FROM ({BLANK_SQL}))
  SELECT o_orderkey, parent, other, CASE WHEN NOT coalesce(starts_with(other, 'No'), false) THEN child END AS child FROM a""")
def conditional_blanks(spark, sf_dir):
    chain = [ConditionalBlank("parent", ["other", "child"], ["No"], ["Never"]), ConditionalBlank("other", ["child"], ["No"])]
    return rules.enforce_blanks(orders_blank(spark, sf_dir), Constraints(blanks=chain)).select("o_orderkey", "parent", "other", "child")


KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
KEY_COLUMNS = KEYS.split(", ")


def _clip_sql(c: str) -> str:
    a, b = RANGES[c]
    return f"CASE WHEN {c} < {a} THEN {a} WHEN {c} > {b} THEN {b} ELSE {c} END::DOUBLE"


@query(f"SELECT {KEYS}, " + ", ".join(f"{_clip_sql(c)} AS {c}" for c in RANGES) + f" FROM ({CHARGE_SQL})")
def clip_ranges(spark, sf_dir):
    return rules.clip_ranges(lineitem_charge(spark, sf_dir), Constraints(ranges=RANGES)).select(*KEY_COLUMNS, *RANGES)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS o_orderpriority FROM orders")
def normalise_categories(spark, sf_dir):
    return rules.normalise_categories(table(spark, sf_dir, "orders"), Constraints(allowed={"o_orderpriority": PRIORITIES})).select("o_orderkey", "o_orderpriority")


FULL = Constraints(ranges=RANGES | {"charge": (900.0, 58000.0)}, allowed={"l_returnflag": ["A", "R"]}, derived=[CHARGED, STATUS])
BAD = "(" + " OR ".join(f"coalesce(NOT ({c} BETWEEN {a} AND {b}), false)" for c, (a, b) in FULL.ranges.items()) + f" OR l_returnflag NOT IN ('A', 'R') OR {WRONG_CHARGE} OR l_linestatus <> expected_status)"


@query(f"SELECT {KEYS}, {BAD} AS invalid FROM ({CHARGE_SQL})")
def invalid_rows(spark, sf_dir):
    df = lineitem_charge(spark, sf_dir)
    return df.select(*KEY_COLUMNS, rules.invalid(FULL, df.columns, rules.numbers(df)).alias("invalid"))


@query(f"""WITH a AS (SELECT {KEYS}, {_clip_sql('l_quantity')} AS l_quantity, {_clip_sql('l_extendedprice')} AS l_extendedprice, {_clip_sql('l_discount')} AS l_discount, CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag END AS l_returnflag, expected_status FROM ({CHARGE_SQL})),
  b AS (SELECT *, l_extendedprice * (1 - l_discount) AS charge, expected_status AS l_linestatus FROM a)
  SELECT {KEYS}, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, charge FROM b WHERE charge BETWEEN 900 AND 58000""")
def repair_chain(spark, sf_dir):
    return rules.repair(lineitem_charge(spark, sf_dir), FULL).select(*KEY_COLUMNS, "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "charge")


@query(f"""SELECT round(greatest(0, 1 - (r1 + r2 + r3 + r4 + c1 + d1 + d2) / 7), 9) AS logic_score FROM (SELECT """ + ", ".join(f"avg(coalesce(NOT ({c} BETWEEN {a} AND {b}), false)::INT)::DOUBLE AS r{i + 1}" for i, (c, (a, b)) in enumerate(FULL.ranges.items())) + f""",
  avg((l_returnflag NOT IN ('A', 'R'))::INT)::DOUBLE AS c1, avg(({WRONG_CHARGE})::INT)::DOUBLE AS d1, avg((l_linestatus <> expected_status)::INT)::DOUBLE AS d2 FROM ({CHARGE_SQL}))""")
def logic_score(spark, sf_dir):
    return rules.logic_score(lineitem_charge(spark, sf_dir), FULL).select(F.round("logic_score", 9).alias("logic_score"))


@query(f"SELECT o_orderkey, base, coalesce(target, strftime({EXPECTED}, '%Y-%m-%d')) AS target FROM ({OFFSET_SQL})")
def recompute_fill(spark, sf_dir):
    c = Constraints(derived=[Derived(DATED.target, DATED.inputs, DATED.fn, "datetime", 1.0)], mode="fill_missing_datetime")
    return rules.recompute(orders_offset(spark, sf_dir), c).select("o_orderkey", "base", "target")


@query(f"""WITH s AS ({OFFSET_SQL}), n AS (SELECT count(*) AS n, count(*) FILTER (target IS NULL) AS m, count(*) FILTER (target IS NOT NULL AND nights IS NULL) AS f FROM s),
  d AS (SELECT n, round_even(0.25 * n, 0)::BIGINT - m AS deficit, f FROM n),
  r AS (SELECT s.*, target IS NOT NULL AND nights IS NULL AS a, row_number() OVER (PARTITION BY target IS NOT NULL AND nights IS NULL ORDER BY o_orderkey) - 1 AS pos FROM s),
  p AS (SELECT r.*, a AND {spread_sql('least(deficit, f)', 'f', 'pos')} AS pick, deficit, f FROM r, d),
  q AS (SELECT *, target IS NOT NULL AND NOT pick AS b FROM p),
  t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o_orderkey) - 1 AS pos2, count(*) OVER (PARTITION BY b) AS total2 FROM q)
  SELECT o_orderkey, CASE WHEN NOT (pick OR (b AND {spread_sql('(deficit - least(deficit, f))', 'total2', 'pos2')})) THEN target END AS target FROM t""")
def derived_missingness(spark, sf_dir):
    return rules.align_missingness(orders_offset(spark, sf_dir), Constraints(derived=[DATED], mode="fill_missing"), "o_orderkey").select("o_orderkey", "target")


@query(f"""WITH h AS (SELECT o_orderkey, o_orderkey % 2 AS odd, parent, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 THEN NULL ELSE child END AS child FROM ({BLANK_SQL})),
  i AS (SELECT *, {INACTIVE_SQL} AS ina FROM h),
  c AS (SELECT count(*) FILTER (odd = 1 AND ina) AS n, count(*) FILTER (odd = 1 AND ina AND child IS NOT NULL) AS k, count(*) FILTER (odd = 0 AND ina) AS rn, count(*) FILTER (odd = 0 AND ina AND child IS NOT NULL) AS rk FROM i),
  g AS (SELECT *, k::DOUBLE / n AS sr, rk::DOUBLE / rn AS rr FROM c),
  b AS (SELECT k, CASE WHEN sr - rr > 0.05 THEN k - round_even(greatest(rr, sr - 0.6::DOUBLE * (sr - rr)) * n, 0)::BIGINT ELSE 0 END AS cnt FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY ina AND child IS NOT NULL ORDER BY o_orderkey) - 1 AS pos FROM i WHERE odd = 1)
  SELECT o_orderkey, CASE WHEN NOT (ina AND child IS NOT NULL AND {spread_sql('cnt', 'k', 'pos')}) THEN child END AS child FROM r, b""")
def soft_blank_align(spark, sf_dir):
    df = orders_blank(spark, sf_dir)
    df = df.withColumn("child", F.when(~((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 4 == 0)), F.col("child")))
    syn, real = df.where("o_orderkey % 2 = 1"), df.where("o_orderkey % 2 = 0")
    return rules.soft_align(syn, real, Constraints(blanks=[ConditionalBlank("parent", ["child"], ["No"], ["Never"])]), "o_orderkey", 0.6)[0].select("o_orderkey", "child")


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey FROM r WHERE {spread_sql('37', 'n', 'pos')}")
def spread_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    total = rows.agg(F.count("*").alias("n"))
    return numbered(rows, "o_orderkey", "rn").crossJoin(F.broadcast(total)).where(spread(F.lit(37), F.col("n"), F.col("rn") - 1)).select("o_orderkey")


@query(f"SELECT sum((x IS DISTINCT FROM child)::INT + (y IS DISTINCT FROM other)::INT)::BIGINT AS cells, sum((x IS DISTINCT FROM child OR y IS DISTINCT FROM other)::INT)::BIGINT AS rows FROM (SELECT *, CASE WHEN NOT {INACTIVE_SQL} THEN child END AS x, CASE WHEN NOT {INACTIVE_SQL} THEN other END AS y FROM ({BLANK_SQL}))")
def cell_changes(spark, sf_dir):
    before = orders_blank(spark, sf_dir)
    after = rules.enforce_blanks(before, Constraints(blanks=[BLANK]))
    return validate.changes(before, after, "o_orderkey", ["child", "other"])


@query("SELECT o_orderpriority AS parent, o_orderstatus AS child, count(*) AS blanked_rows FROM orders GROUP BY ALL ORDER BY blanked_rows DESC, parent, child LIMIT 5")
def top_adjustments(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("parent"), F.col("o_orderstatus").alias("child")).agg(F.count("*").alias("blanked_rows"))
    return validate.top_adjustments(counts, 5)

