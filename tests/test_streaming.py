"""A trained model on a stream: encoding, restart with the kept version, refusals."""

import pytest
from pyspark.sql import functions as F

from gridwright.operators import models
from gridwright.streaming import FittedCleaning, StreamScorer

KIND = "id long, n double, c string, y string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 11 == 0 else float(i % 17), None if i % 13 == 0 else "abc"[i % 3], "yes" if i % 3 == 1 else "no") for i in range(120)]
    return spark.createDataFrame(data, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def model(rows):
    return models.train_with_baseline(rows, "y", "Decision Tree", {"max_depth": 3}, key=["id"])


def sorted_rows(df):
    return sorted(str(tuple(r)) for r in df.collect())  # as text, in which NaN equals NaN


def test_restart_goes_on_with_the_kept_model(spark, rows, model, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    come = rows.drop("y")
    scorer = StreamScorer(spark, state)
    assert scorer.version() is None
    first = scorer.pin(model)
    stream = lambda: spark.readStream.schema(come.schema).parquet(source)
    come.where("id < 50").write.parquet(source)
    scorer.start(stream(), out).awaitTermination()
    assert spark.read.parquet(out).count() == 50
    other = models.train_with_baseline(rows.withColumn("y", F.lit("no")).unionByName(rows.selectExpr("id + 999 AS id", "n", "c", "'yes' AS y")), "y", "Logistic", key=["id"])
    come.where("id >= 50").write.mode("append").parquet(source)
    again = StreamScorer(spark, state)
    assert again.pin(other) == first == again.version()
    again.start(stream(), out).awaitTermination()
    again.start(stream(), out).awaitTermination()  # nothing new: nothing is scored twice
    got = spark.read.parquet(out)
    assert sorted_rows(got.drop("model_version")) == sorted_rows(model.predict(come))
    assert [r[0] for r in got.select("model_version").distinct().collect()] == [first]
    assert StreamScorer(spark, str(tmp_path / "new")).pin(other) != first


def test_unseen_and_missing_cells_are_encoded_as_in_training(spark, model, tmp_path):
    odd = spark.createDataFrame([(1, None, None), (2, float("nan"), "never seen"), (3, 1e300, "")], "id long, n double, c string")
    scorer = StreamScorer(spark, str(tmp_path / "s"))
    scorer.pin(model)
    got = scorer.apply(odd)
    assert sorted_rows(got.drop("model_version")) == sorted_rows(model.predict(odd)) and got.count() == 3
    assert scorer.apply(odd.limit(0)).count() == 0


def test_defaults_and_cleaning_travel_with_the_stream(spark, rows, model, tmp_path):
    cleaning = FittedCleaning.fit(rows, fill=["n"], clip=["n"], factor=0.1)
    scorer = StreamScorer(spark, str(tmp_path / "s"), cleaning)
    scorer.pin(model, defaults={"c": "b"})
    slim = rows.select("id", "n")
    want = model.predict(cleaning.apply(slim), {"c": "b"})
    assert sorted_rows(scorer.apply(slim).drop("model_version")) == sorted_rows(want)


def test_refusals(spark, rows, model, tmp_path):
    with pytest.raises(ValueError, match="No model is kept"):
        StreamScorer(spark, str(tmp_path / "a")).apply(rows)
    near = models.train_with_baseline(rows, "y", "KNN", key=["id"])
    with pytest.raises(ValueError, match="neighbour"):
        StreamScorer(spark, str(tmp_path / "b")).pin(near)
    scorer = StreamScorer(spark, str(tmp_path / "c"))
    scorer.pin(model)
    with pytest.raises(ValueError, match="already have"):
        scorer.apply(rows.withColumn("Prediction", F.lit(1)))
