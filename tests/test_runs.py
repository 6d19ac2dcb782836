"""Files, configuration, whole runs and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators.rules import Constraints
from tabloom.plans import runs
from tabloom.sources import tables
from tabloom.streaming import rows as streams


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    rng = random.Random(1)
    path = tmp_path_factory.mktemp("data") / "source.csv"
    lines = ['Age::40,"Complication, any::1",Anastomosis::66,Type of anastomosis::67,score (mixed)::9,day (YYYY-MM-DD)::2']
    for i in range(120):
        done = rng.choice(["Yes", "No"])
        lines.append(f"{rng.randint(20, 90)},{rng.choice(['a', 'b', 'NA'])},{done},{rng.choice(['end', 'side']) if done == 'Yes' else ''},{rng.choice(['1', '2', '3.5', 'Unknown'])},2020-01-{i % 28 + 1:02d}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_round_trip(spark, source, tmp_path):
    df = tables.read_csv(spark, source)
    assert df.count() == 120 and dict(df.dtypes)["Age::40"] == "double" and dict(df.dtypes)["score (mixed)::9"] == "string"
    assert df.where("`Complication, any::1` = 'NA'").count() == 0
    tables.write_csv(df, str(tmp_path / "out"))
    again = tables.read_csv(spark, str(tmp_path / "out"))
    assert sorted(again.collect(), key=lambda r: r._row_id) == sorted(df.collect(), key=lambda r: r._row_id)
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "absent.csv"))
    (digest,) = tables.file_digests(spark, str(tmp_path / "out" / "*.csv")).collect()
    assert len(digest.sha256) == 64


def test_configuration(tmp_path):
    plain = "seed: 7\nmodels:\n  - copula\n  - baseline\ncopula:\n  repair: true\n  privacy_min_distance: 0.5  # near\noutput_dir: here\n"
    (tmp_path / "a.yaml").write_text(plain)
    (tmp_path / "b.json").write_text(json.dumps({"copula": {"repair": False}}))
    config = tables.read_config(str(tmp_path / "a.yaml"))
    assert tables._plain_yaml(plain) == config == {"seed": 7, "models": ["copula", "baseline"], "copula": {"repair": True, "privacy_min_distance": 0.5}, "output_dir": "here"}
    both = tables.merged(config, tables.read_config(str(tmp_path / "b.json")))
    assert both["copula"] == {"repair": False, "privacy_min_distance": 0.5} and tables.model_config(both, "copula")["repair"] is False
    assert runs.model_names(config) == ["copula", "baseline"] and runs.model_names({}) == ["copula"]
    (tmp_path / "c.txt").write_text("")
    with pytest.raises(ValueError):
        tables.read_config(str(tmp_path / "c.txt"))
    with pytest.raises(KeyError):
        tables.create_model("other")


def test_whole_run(spark, source, tmp_path):
    errors = runs.run(spark, source, {"models": ["copula", "baseline"], "seed": 3, "include_conditional_blanks": True}, str(tmp_path / "run"))
    assert set(errors) == {"copula", "baseline"}
    made = tables.read_csv(spark, str(tmp_path / "run" / "copula"))
    assert 100 <= made.count() <= 120 and made.drop("_row_id").distinct().count() == made.count()
    assert made.where("`Anastomosis::66` = 'No' AND `Type of anastomosis::67` IS NOT NULL").count() == 0
    assert (tmp_path / "run" / "summary.json").exists() and (tmp_path / "run" / "copula.notes.md").exists()
    errors = runs.generate_from(spark, source, str(tmp_path / "run" / "copula.json"), {"selection_strategy": "balanced"}, str(tmp_path / "more"), rows=40, seed=9)
    assert tables.read_csv(spark, str(tmp_path / "more")).count() == 40 and any("Too few rows" in e for e in errors)
    errors = runs.generate_from(spark, source, str(tmp_path / "run" / "baseline.json"), {}, str(tmp_path / "again"), rows=30, seed=5)
    assert 0 < tables.read_csv(spark, str(tmp_path / "again")).count() <= 30 and tables.load_model(str(tmp_path / "run" / "baseline.json")).schema.order
    post = runs.postprocess(spark, source, str(tmp_path / "run" / "baseline"), str(tmp_path / "post"), 1.0)
    assert post["cells"] == sum(a["blanked_rows"] for a in post["adjustments"])
    report = runs.precheck(spark, source, str(tmp_path / "run" / "copula"))
    assert 0 <= report["score"]["total"] <= 1 and report["sanity"] == {"Age Within Range (18-110)": True}
    assert "score" not in runs.precheck(spark, source, str(tmp_path / "run" / "copula"), quick=True)
    assert runs.train(spark, source, {"model": "copula"}, str(tmp_path / "train"))["copula"].endswith("copula.json")


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    c = Constraints(ranges={"value": (10.0, 60.0)})
    streams.write(streams.repair_stream(stream, c), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    low, high = spark.read.parquet(str(tmp_path / "out")).agg(F.min("value"), F.max("value")).first()
    assert low >= 10 and high <= 60 and spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    known = events.where("event_id % 2 = 0").select("event_id", "user_id")
    streams.write(streams.unmatched_stream(stream.select("event_id", "user_id"), known, ["event_id", "user_id"]), str(tmp_path / "rest"), str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rest")).count() == events.where("event_id % 2 = 1").count()
    rates = streams.invalid_rates(stream, c, "ts", "1 day")
    query = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("rates").agg(F.sum("rows")).first()[0] == events.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
