"""Quirks that the test tables can't show, on frames small enough to work out by hand."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import normal
from tabloom.functions import scalars as s
from tabloom.operators import conform, copula, encode, mixed, privacy, profile, rules, select, validate
from tabloom.operators.profile import infer_schema
from tabloom.operators.rules import ConditionalBlank, Constraints, Derived
from tabloom.plans import clinical, ordering
from tabloom.plans.ordering import numbered, running, spread
from tabloom.queries import checks  # noqa: F401  registers its queries
from tabloom.queries.registry import QUERIES


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, c {kind}")


def evaluated(df, *exprs):
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in sorted(df.select("i", *exprs).collect())]


def test_number_parsing(spark):
    cells = ["1d", " 5 ", "1e3", "1,000", "5%", "", "No", None, "-.5", "+3.", "1e400", "inf", "nan", "١"]
    assert evaluated(column(spark, cells), s.to_double(F.col("c"))) == [None, 5.0, 1000.0, None, None, None, None, None, -0.5, 3.0, None, None, None, None]


def test_na_tokens(spark):
    assert evaluated(column(spark, ["NA", "None", "n/a", "No", "Unknown", ""]), s.na_to_null(F.col("c"))) == [None, None, None, "No", "Unknown", None]


def test_half_even(spark):
    found = evaluated(column(spark, [0.5, 1.5, 2.5, -0.5, None], "double"), s.half_even(F.col("c")))
    assert found == [0.0, 2.0, 2.0, 0.0, None] and math.copysign(1, found[3]) == 1


def test_times_and_dates(spark):
    df = column(spark, ["09:30", "5", "23:59", None, "x:y"])
    assert evaluated(df, s.hhmm_seconds(F.col("c"))) == [34200.0, None, 86340.0, None, None]
    assert evaluated(column(spark, [34200.0, 90000.0, -60.0, None], "double"), s.seconds_hhmm(F.col("c"))) == ["09:30", "23:00", "00:59", None]
    dates = column(spark, ["2020-02-28", "2020-13-01", "28.2.2020", None])
    assert evaluated(dates, s.offset_date(F.col("c"), F.lit("1.5"))) == ["2020-03-01", None, None, None]
    assert evaluated(dates, s.epoch_to_date(s.epoch_seconds(F.col("c")))) == ["2020-02-28", None, None, None]


def test_normal_against_the_library(spark):
    p = [1e-6, 1e-3, 0.02, 0.3, 0.5, 0.77, 0.9999, 1 - 1e-6]
    x = [-8.5, -7.1, -7.0, -1.0, 0.0, 0.5, 3.0, 8.0]
    dist = statistics.NormalDist()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(p, x))], "i long, p double, x double")
    for got, a, b in zip(evaluated(df, normal.quantile(F.col("p")), normal.distribution(F.col("x"))), p, x):
        assert abs(got[0] - dist.inv_cdf(a)) < 1e-12 and abs(got[1] - 0.5 * math.erfc(-b / math.sqrt(2))) < 1e-14
    staged = normal.quantiles(df, {"z": "p"})
    assert [r.z for r in sorted(staged.collect())] == [g[0] for g in evaluated(df, normal.quantile(F.col("p")), F.col("p"))]


def test_snap_and_spread(spark):
    assert evaluated(column(spark, [2.0, 0.0, 9.0, None], "double"), s.snap(F.col("c"), [1.0, 3.0])) == [1.0, 1.0, 3.0, None]
    for n in (1, 2, 10, 97, 233):
        for k in (0, 1, 2, 4, n - 1, n, n + 5):
            df = spark.range(n)
            found = [r.id for r in df.where(spread(F.lit(k), F.lit(n), F.col("id"))).orderBy("id").collect()]
            expected = [] if k <= 0 else list(range(n)) if k >= n else np.linspace(0, n - 1, num=k, dtype=int).tolist()
            assert found == expected


def test_ordering_in_two_levels(spark):
    df = spark.createDataFrame([(v, g) for v in (5, 1, 9, 3, 1000000, -7) for g in ("a", "b")], "v long, g string")
    assert {(r.v, r.g): r.rn for r in numbered(df, "v", "rn", by=["g"]).collect()} == {(v, g): i + 1 for g in "ab" for i, v in enumerate([-7, 1, 3, 5, 9, 1000000])}
    assert [r.total for r in running(df.where("g = 'a'"), "v", F.col("v"), "total").orderBy("v").collect()] == [-7, -6, -3, 2, 11, 1000011]
    assert numbered(df.limit(0), "v", "rn").count() == 0


def test_ordering_with_outliers_and_nulls(spark):
    """One far value must not put the others in one bucket; nulls come first."""
    values = [*range(5000), 10**15]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    sizes = [r["count"] for r in ordering._bucketed(df, F.col("v"), [], 64).groupBy("__bucket").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 300
    assert {r.v: r.rn for r in numbered(df, "v").collect()} == {v: i + 1 for i, v in enumerate(values)}
    some = spark.createDataFrame([(None, "a"), (2.5, "a"), (float("nan"), "a"), (-1.0, "a"), (None, "b")], "v double, g string")
    found = {(r.g, str(r.v)): r.rn for r in numbered(some, "v", by=["g"]).collect()}
    assert found == {("a", "None"): 1, ("a", "-1.0"): 2, ("a", "2.5"): 3, ("a", "nan"): 4, ("b", "None"): 1}


def test_kinds(spark):
    rows = [(i, str(i + 1), f"2020-01-{i % 28 + 1:02d}", f"{i % 24:02d}:00", "same", ["x", "y"][i % 2], ["5", "6", "Unknown"][i % 3] if i % 9 else None, str((i * 37 % 40) / 4), f"n{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "_row_id long, number string, day string, clock string, fixed string, two string, `age::1` string, measure string, few string")
    schema = infer_schema(df, "_row_id")
    assert {c.name: c.kind for c in schema.columns} == {"number": "id_like", "day": "datetime", "clock": "time", "fixed": "constant", "two": "binary", "age::1": "categorical", "measure": "numeric", "few": "categorical"}
    age = schema.get("age::1")
    assert age.mixed_value_kind == "numeric" and age.mixed_token_values == ["Unknown"] and age.allowed_values == ["6", "Unknown", "5"] and age.nullable
    assert schema.from_dict(schema.to_dict()) == schema
    assert infer_schema(df.limit(0), "_row_id").row_count == 0


def test_monotonic(spark):
    cells = profile.long_form(spark.createDataFrame([(0, 1, 2, "x"), (1, 1, 1, "2"), (2, 2, 3, "3")], "i long, up long, down long, text string"), "i", ["up", "down", "text"])
    assert {r.name: r.monotonic for r in profile.monotonic(cells).collect()} == {"up": True, "down": False, "text": False}


def test_spellings(spark):
    df = column(spark, ["5", "5.0", "5", "6", "6.0", None, "No"])
    assert {r.number: r.spelling for r in mixed.spellings(df, "c").collect()} == {5.0: "5", 6.0: "6"}
    e = mixed.fit(df, "c")
    assert e.support == [5.0, 6.0] and mixed.fit(df, "c", most=1).support == []


def test_blanks_run_in_order(spark):
    df = spark.createDataFrame([(0, "No", "No", "x"), (1, "Not done", "y", "x"), (2, None, "No", "x"), (3, "None known", "a", "b")], "i long, parent string, middle string, leaf string")
    c = Constraints(blanks=[ConditionalBlank("parent", ["middle"], ["No"]), ConditionalBlank("middle", ["leaf"], ["No"])])
    assert [tuple(r)[1:] for r in sorted(rules.enforce_blanks(df, c).collect(), key=lambda r: r.i)] == [("No", None, "x"), ("Not done", None, "x"), (None, "No", None), ("None known", None, "b")]


def test_zero_height_drops_the_row(spark):
    df = spark.createDataFrame([(0, 80.0, 180.0, 24.0), (1, 80.0, 0.0, 24.0), (2, 80.0, 100.0, 80.0)], f"_row_id long, `{clinical.WEIGHT}` double, `{clinical.HEIGHT}` double, `{clinical.BMI}` double")
    c = Constraints(ranges={clinical.BMI: (10.0, 60.0)}, derived=[clinical.bmi_rule()])
    assert [r._row_id for r in rules.repair(df, c).collect()] == [0]


def test_repair_leaves_nothing_wrong(spark):
    df = spark.createDataFrame([(i, str(i * 7 % 50), ["a", "b", "z"][i % 3], None if i % 5 == 0 else float(i)) for i in range(100)], "i long, n string, c string, d double")
    c = Constraints(ranges={"n": (10, 30)}, allowed={"c": ["a", "b"]}, derived=[Derived("d", ["n"], lambda: F.col("n") * 2.0, "numeric", 0.5)])
    once = rules.repair(df, c)
    assert {r.rate for r in rules.violations(once, c).collect()} == {0.0} and rules.logic_score(once, c).first()[0] == 1.0
    assert sorted(rules.repair(once, c).collect()) == sorted(once.collect())
    assert rules.violations(df.limit(0), c).agg(F.sum("rate")).first()[0] == 0.0
    assert rules.violations(df, Constraints()).count() == 0


def test_soft_align_options(spark):
    syn = spark.createDataFrame([(i, "No", "x") for i in range(20)] + [(i, "Yes", "x") for i in range(20, 40)], "i long, parent string, child string")
    real = spark.createDataFrame([(i, "No", None if i else "x") for i in range(10)], "i long, parent string, child string")
    c = Constraints(blanks=[ConditionalBlank("parent", ["child"], ["No"])])
    df, summary = rules.soft_align(syn, real, c, "i", 0.5)
    assert summary[0]["blanked_rows"] == 9 and df.where("parent = 'No' AND child IS NULL").count() == 9 and df.where("parent = 'Yes' AND child IS NULL").count() == 0
    assert rules.soft_align(syn, real, c, "i", 0.5, most=3)[1][0]["blanked_rows"] == 3
    assert rules.soft_align(syn, real, c, "i", 0.5, exclude=["PAR"])[1] == [] and rules.soft_align(syn, real, c, "i", 0.0)[1] == []


def test_apportion_and_quota(spark):
    counts = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", 1, 2)], "value string, n long, first long")
    assert {r.value: r.share for r in conform.apportion(counts, F.lit(4)).collect()} == {"a": 2, "b": 1, "c": 1}
    assert [conform.quota(*x) for x in ((0, 5, 5), (1, 1000, 10), (5, 10, 5), (10, 10, 3))] == [0, 1, 2, 3]


def test_lost_texts_come_back(spark):
    real = column(spark, ["1", "2", "Unknown", "3", "Unknown", "4", None, "5"])
    syn = column(spark, [None, "1", "2", "3", None, "4", "5", "6"])
    made = evaluated(conform.coerce_text(syn, real, "c", "i", True), F.col("c"))
    assert made == ["Unknown", "1", "2", "3", "Unknown", "4", "5", "6"]
    blank = column(spark, [None] * 8)
    assert evaluated(conform.coerce_text(blank, real, "c", "i", False), F.col("c")) == ["Unknown"] + [None] * 7
    assert len([v for v in evaluated(conform.coerce_text(blank, real, "c", "i", True), F.col("c")) if v]) == 7


def test_correlation_is_made_usable(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(float(a), float(b), float(a + b), 1.0) for a, b, _ in data], "a double, b double, c double, d double")
    raw = copula.correlation(df, ["a", "b", "c", "d"])
    assert np.allclose(raw[:3, :3], np.corrcoef(np.c_[data[:, 0], data[:, 1], data[:, 0] + data[:, 1]], rowvar=False)) and np.isnan(raw[3]).all()
    m = copula.regularised(raw)
    assert np.allclose(np.diag(m), 1) and np.linalg.eigvalsh(m).min() > 0 and np.allclose(m[3, :3], 0) and np.allclose(m, m.T)


def test_type_four_quantile(spark):
    df = column(spark, [0.0, 0.1, 0.3, 0.5, 1.0], "double")
    assert np.allclose(evaluated(df, copula.quantile4(F.col("c"), [10, 20, 30, 40])), [10, 10, 12, 20, 40])
    assert np.allclose(evaluated(df, copula._interpolated([10, 20, 30, 40])(F.col("c"))), [10, 10, 12, 20, 40])


def test_short_and_long_marginals_agree(spark, monkeypatch):
    ms = [copula.Marginal("n", "numeric", 0.2, values=sorted(float(v) for v in range(40)), is_integer=True, support=[0.0, 7.0, 30.0]), copula.Marginal("c", "categorical", shares=[0.25] * 4, values=["a", s.MISSING, "b", "c"])]
    df = spark.range(400).select("id", *[normal.uniform(1, F.col("id"), u).alias(u) for u in ("u", "v")])
    short = sorted(copula.cells(df, ms, ["u", "v"], ["x", "y"]).collect())
    monkeypatch.setattr(copula, "INLINE", 0)
    assert sorted(copula.cells(df, ms, ["u", "v"], ["x", "y"]).collect()) == short
    assert {r.x for r in short} == {None, 0.0, 7.0, 30.0} and {r.y for r in short} == {"a", None, "b", "c"}


def test_copula_keeps_marginals_and_dependence(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=1500)
    y = 0.8 * x + 0.6 * rng.normal(size=1500)
    rows = [(i, float(a), float(b) if i % 10 else None, ["low", "high"][int(a + rng.normal() > 0)], "one", float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_row_id long, x double, y double, c string, k string, w double")
    schema = infer_schema(df, "_row_id")
    for name in ("x", "y", "w"):
        schema.get(name).kind = "numeric"
    model = copula.GaussianCopula(3).fit(df, schema, "_row_id")
    made = model.sample(spark, 3000).toPandas()
    assert abs(made.x.mean() - x.mean()) < 0.08 and abs(made.x.std() - x.std()) < 0.08
    assert abs(made.y.isna().mean() - 0.1) < 0.03 and set(made.k) == {"one"}
    assert abs(made[["x", "w"]].corr().iloc[0, 1] - 0.8) < 0.05
    assert abs((made.c == "high").mean() - np.mean([r[3] == "high" for r in rows])) < 0.05
    again = copula.GaussianCopula.from_dict(model.to_dict())
    assert sorted(again.sample(spark, 20).collect()) == sorted(model.sample(spark, 20).collect())
    with pytest.raises(RuntimeError):
        copula.GaussianCopula().sample(spark, 1)


def test_greedy_drop_as_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "abcd"[rng.integers(0, 4)], "rare" if i == 17 else "xyz"[rng.integers(0, 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    schema = infer_schema(df, "i")
    pool, real = df.where("i % 2 = 1"), df.where("i % 2 = 0")
    found = select.features(schema)
    scores = {(r.feature, r.value): r.score for r in select.value_scores(select.long_features(real, "i", found), select.long_features(pool, "i", found)).collect()}
    ranks = {r.ord: r.score for r in select.row_scores(select.long_features(pool, "i", found), select.value_scores(select.long_features(real, "i", found), select.long_features(pool, "i", found))).collect()}
    assert len(scores) >= 7
    kept, counts = {r.i: (r.a, r.b) for r in pool.collect()}, {}
    for a, b in kept.values():
        counts["a", a], counts["b", b] = counts.get(("a", a), 0) + 1, counts.get(("b", b), 0) + 1
    excess = 40
    for i in sorted(kept, key=lambda i: (-ranks[i], i)):
        a, b = kept[i]
        if excess and counts["a", a] > 1 and counts["b", b] > 1:
            excess -= 1
            counts["a", a] -= 1
            counts["b", b] -= 1
            del kept[i]
    got = {r.i for r in select.balanced(pool, real, schema, "i", 110).collect()}
    assert got == set(kept) and 17 in got
    with pytest.raises(ValueError):
        select.select_rows(pool, real, schema, "i", 5, "other")


def test_privacy_filter(spark):
    real = spark.createDataFrame([(i, float(i), ["a", "b"][i % 2]) for i in range(40)], "_row_id long, x double, c string")
    syn = spark.createDataFrame([(0, 3.0, "b"), (1, 3.01, "b"), (2, 90.0, "a"), (3, 90.0, "a"), (4, None, "a")], "_row_id long, x double, c string")
    schema = infer_schema(real, "_row_id")
    schema.get("x").kind = "numeric"
    kept = {r._row_id for r in privacy.filter_violations(real, syn, schema, "_row_id").collect()}
    assert kept == {1, 2, 4}
    assert {r._row_id for r in privacy.filter_violations(real, syn, schema, "_row_id", least=0.05).collect()} >= {2}
    assert 1 not in {r._row_id for r in privacy.filter_violations(real, syn, schema, "_row_id", least=0.05).collect()}
    clean = privacy.filter_violations(real, syn, schema, "_row_id")
    assert privacy.exact_match_rate(clean, real, schema.order).first()[0] == 0 and privacy.duplicate_rate(clean, schema.order).first()[0] == 0
    assert privacy.duplicate_rate(clean.limit(0), schema.order).first()[0] == 0.0


def test_encoding_edges(spark):
    df = spark.createDataFrame([(0, "a", None, 1.0), (1, "b", 2.0, 1.0), (2, None, 4.0, 1.0)], "i long, c string, x double, k double")
    schema = infer_schema(df, "i")
    schema.get("x").kind = "numeric"
    p = encode.fit(df, schema, "i")
    assert p.fills["x"] == 3.0 and p.levels["c"] == ["a", "b"]
    other = df.withColumn("c", F.lit("new"))
    assert {r.c for r in encode.transform(other, p, "i").collect()} == {-1.0}
    flat, names = encode.for_distance(df, schema, "i")
    assert len(names) == len(flat.columns) - 1 and flat.count() == 3


def test_ks_and_scores(spark):
    real = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert validate.ks_similarity(validate.numeric_pairs(real, real)).first().similarity == 1.0
    assert validate.ks_similarity(validate.numeric_pairs(real, real.withColumn("x", F.col("x") + 50))).first().similarity == 0.5
    texts = real.select(F.lit("t").alias("x"))
    assert validate.ks_similarity(validate.numeric_pairs(texts, real)).first().similarity is None
    assert abs(validate.total_score({k: 1.0 for k in validate.WEIGHTS}) - 1) < 1e-12


def test_sanity(spark):
    df = spark.createDataFrame([(20.0, 80.0, 180.0, 24.7, "Male"), (111.0, 80.0, 180.0, 24.7, None)], f"`{validate.AGE}` double, `{validate.WEIGHT}` double, `{validate.HEIGHT}` double, `{validate.BMI}` double, `{validate.GENDER}` string")
    assert validate.sanity(df) == {"Age Within Range (18-110)": False, "BMI-Weight-Height Logic": True, "Valid Gender Categories": False}
    assert validate.sanity(df.select(F.lit(1).alias("x"))) == {}


def test_clinical_rules(spark):
    assert len(clinical.BLANKS) == 22 and len(clinical.DURATIONS) == 10
    target, nights = next(iter(clinical.DURATIONS.items()))
    df = spark.createDataFrame([(0, "2020-01-01", "3", "2020-01-04", "No", "x"), (1, "2020-01-01", "3", None, "Yes", "y")], f"_row_id long, `{clinical.OPERATION}` string, `{nights}` string, `{target}` string, `Anastomosis::66` string, `Type of anastomosis::67` string")
    c = clinical.constraints(df, infer_schema(df, "_row_id"), blanks=True, mode="fill_missing")
    assert [r.target for r in c.derived] == [target] and c.derived[0].target_missing_rate == 0.5 and [b.children for b in c.blanks] == [["Type of anastomosis::67"]]
    assert rules.recompute(df, c).where(s.col(target).isNull()).count() == 0


def test_nearest_of_all_source_rows(spark, tmp_path):
    """More than MAX_ROWS source vectors; the last are the nearest of all queries."""
    n = 5 * (privacy.MAX_ROWS + 500)
    at = np.arange(n, dtype=float)
    rows = pd.DataFrame({"vec_id": np.arange(n), "embedding": [[float(v), 0.0] for v in np.where(np.arange(n) % 5 == 0, at, at + 10 * n)]})
    rows.to_parquet(tmp_path / "embeddings.parquet")
    source = at[::5]
    found = {r.vec_id: r.distance for r in QUERIES["nn_distance"](spark, str(tmp_path)).collect()}
    assert found == {i: i + 10 * n - source[-1] for i in range(n) if i % 5}
    alone = {r.vec_id: r.distance for r in QUERIES["self_nn"](spark, str(tmp_path)).collect()}
    assert alone == {i: 5.0 for i in range(0, n, 5)}
    frame = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "k long, v array<double>")
    assert [r.distance for r in privacy.nearest_of_all(frame, "k", "v", frame.limit(0)).collect()] == [None, None]
    assert [r.distance for r in privacy.nearest_of_all(frame.limit(1), "k", "v", frame.limit(1), other=True).collect()] == [None]
