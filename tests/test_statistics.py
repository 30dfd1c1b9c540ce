import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.functions import ranks
from gridwright.functions.frequencies import most_frequent
from gridwright.functions.quantiles import exact_quantiles, grouped_quantiles
from gridwright.operators import charts, metrics, profile

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def skewed(count, seed):
    """A third of the values equal, the rest spread, with ties and missing cells."""
    pick = random.Random(seed)
    out = []
    for _ in range(count):
        kind = pick.random()
        out.append(7.0 if kind < 0.34 else None if kind < 0.4 else round(pick.gauss(0, 50), 2) if kind < 0.9 else pick.random() * 1e6)
    return out


@pytest.mark.parametrize("buffer,sketch_rows", [(5, 10**6), (5, 300), (200, 50), (10**6, 10**6)])
def test_exact_quantiles_agree_with_numpy_on_every_path(spark, buffer, sketch_rows):
    data = pd.DataFrame({"a": skewed(4001, 1), "b": skewed(4001, 2), "c": [None] * 4001, "d": [3.0] * 4001})
    df = spark.createDataFrame(
        [tuple(None if v is None or v != v else float(v) for v in r) for r in data.itertuples(index=False)],
        "a double, b double, c double, d double",
    )
    found = exact_quantiles(df, ["a", "b", "c", "d"], PROBS, buffer, sketch_rows=sketch_rows)
    for name in "abd":
        assert found[name] == pytest.approx(list(np.quantile(data[name].dropna(), PROBS)))
    assert found["c"] == [None] * len(PROBS)


def test_quantile_between_two_heavy_values(spark):
    df = spark.createDataFrame([(1.0,)] * 3000 + [(2.0,)] * 3000 + [(float("nan"),)] * 10, "v double")
    assert exact_quantiles(df, ["v"], [0.25, 0.5, 0.75], 0)["v"] == [1.0, 1.5, 2.0]


@pytest.mark.parametrize("buffer", [0, 10**6])
def test_grouped_quantiles_agree_with_numpy_on_both_paths(spark, buffer):
    values = skewed(3000, 3)
    rows = [("hot" if i % 3 else f"g{i % 7}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in grouped_quantiles(df, "g", "v", [0.25, 0.5, 0.75], buffer).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    for name, part in frame.groupby("g")["v"]:
        row = found[name]
        assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(list(np.quantile(part, [0.25, 0.5, 0.75])))
        assert row["n"] == len(part)


def test_most_frequent(people):
    found = most_frequent(people, ["sex", "age", "none", "id"])
    assert (found["sex"].value, found["sex"].count, found["sex"].distinct) == ("x", 2, 3)
    assert found["none"] is None and found["id"].value == 0 and found["age"].distinct == 4


def test_dataset_stats(spark, people):
    assert profile.dataset_stats(people).first().asDict() == {"rows": 6, "cols": 8, "missing": 2 + 1 + 1 + 1 + 6 + 1, "duplicates": 0}
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "a"), (nan, "b"), (None, "b"), (1.0, "a"), (1.0, "a")], "v double, t string")
    assert profile.dataset_stats(df).first().asDict() == {"rows": 5, "cols": 2, "missing": 2, "duplicates": 3}
    assert profile.dataset_stats(df.limit(0)).first().asDict() == {"rows": 0, "cols": 2, "missing": 0, "duplicates": 0}
    assert profile.stats_delta(df.limit(2), df).first()["cols"] == 0
    assert profile.workspace_counters(people).first().asDict() == {"rows": 6, "cols": 8, "missing": 12}


def test_missing_by_column_and_value_counts(people):
    assert [tuple(r) for r in profile.missing_by_column(people, 3).collect()] == [("none", 6), ("age", 2), ("email", 1)]
    assert [tuple(r) for r in profile.value_counts(people, "sex").collect()] == [("x", 2), ("y", 2), ("Z", 1), ("nan", 1)]


def test_describe(people):
    found = {r["column"]: r for r in profile.describe(people).collect()}
    assert found["age"]["count"] == 4 and found["age"]["p50"] == 30.0 and found["age"]["unique"] is None
    assert found["age"]["std"] == pytest.approx(np.std([10, 20, 40, 1000], ddof=1))
    assert (found["sex"]["unique"], found["sex"]["top"], found["sex"]["freq"]) == (3, "x", 2)
    assert found["none"]["count"] == 0 and found["none"]["mean"] is None


@pytest.mark.parametrize("distinct,task", [(9, "classification"), (10, "regression"), (11, "regression"), (500, "regression")])
def test_task_threshold(spark, distinct, task):
    df = spark.range(2000).select((F.col("id") % distinct).cast("double").alias("t"))
    assert profile.detect_task(df, "t") == task
    assert profile.detect_task(df.select(F.col("t").cast("string")), "t") == "classification"
    with pytest.raises(ValueError, match="not found"):
        profile.detect_task(df, "u")


def test_unchanged(people):
    assert profile.is_unchanged(people.orderBy("id"), people)
    assert not profile.is_unchanged(people.withColumn("age", F.col("age") + 1), people)
    assert not profile.is_unchanged(people.withColumn("id", F.col("id").cast("int")), people)
    doubled = people.unionByName(people)
    assert not profile.is_unchanged(doubled, people)


def test_defaults_range_and_folds(spark, people):
    assert profile.default_features(people, ["age", "sex", "none", "member"]) == {
        "age": 267.5, "sex": "x", "none": 0.0, "member": "true",
    }
    assert tuple(profile.column_range(people, "none").first()) == (0.0, 0.0)
    assert tuple(profile.column_range(people, "age").first()) == (10.0, 1000.0)
    assert profile.class_counts(people, "sex").where("sex is null").first()["rows"] == 1
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 3, "c string")
    assert tuple(profile.usable_folds(df, "c").first()) == (10, 3, 3)
    assert tuple(profile.usable_folds(spark.range(3), "id", "regression").first()) == (3, None, 3)


# -- charts


def test_correlation_paths_agree_with_pandas(spark):
    pick = np.random.default_rng(0)
    data = pd.DataFrame(pick.normal(1e6, 3, (500, 4)), columns=list("abcd"))
    data["b"] = data["a"] * 2 + pick.normal(0, 1, 500)
    data["c"] = np.where(pick.random(500) < 0.3, np.nan, data["c"])
    data["d"] = np.where(pick.random(500) < 0.2, np.nan, data["d"] + data["a"])
    data["flat"] = 0.1
    want = data.corr()
    df = spark.createDataFrame(data)
    for limit in (12, 0):
        found = {(r["col_a"], r["col_b"]): r["r"] for r in charts.correlation_matrix(df, jvm_columns=limit).collect()}
        assert len(found) == 25
        for a in data:
            for b in data:
                if "flat" in (a, b):
                    assert found[a, b] is None
                else:
                    assert found[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    matrix = charts.correlation_matrix(df)
    assert tuple(charts.top_pair(matrix).first())[:2] == ("a", "b")
    assert charts.heat_map(matrix, 2).count() == 4


def test_histogram(spark, people):
    df = spark.createDataFrame([(float(i),) for i in range(71)] + [(None,), (float("nan"),)], "v double")
    bins = charts.histogram(df, "v").orderBy("bin").collect()
    assert [r["rows"] for r in bins] == [2] * 34 + [3] and bins[-1]["high"] == pytest.approx(70.0)
    assert [(r["bin"], r["rows"]) for r in charts.histogram(people, "flat").collect()] == [(1, 6)]
    assert charts.histogram(people, "none").count() == 0
    assert {r["value"]: r["rows"] for r in charts.histogram(people, "sex").collect()} == {"x": 2, "y": 2, "Z": 1, "nan": 1}


def test_box_and_bar(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", None), (None, 1.0)], "x string, y double")
    a = charts.box_summary(df, "x", "y").where("x = 'a'").first()
    assert (a["rows"], a["q1"], a["median"], a["q3"], a["whisker_low"], a["whisker_high"], a["outliers"]) == (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert {r["x"]: r["height"] for r in charts.bar_sum(df, "x", "y").collect()} == {"a": 110.0, "b": 5.0, None: 1.0}


def test_suggested_charts(people):
    names = list(charts.suggest_charts(people, ["id"], "sex"))
    assert names[0] == "Target distribution" and names[1].startswith("Top correlated pair") and len(names) == 3
    assert list(charts.suggest_charts(people.select("sex", "age"), ["age"])) == []


# -- metrics


def test_classification_metrics(spark):
    y = list("aaaabbbccd")
    p = list("aabcbbaccz")
    df = spark.createDataFrame(list(zip(y, p)), "y string, p string")
    found = metrics.classification_metrics(df, "y", "p").first()
    f1 = 0.0
    for c in set(y):
        tp = sum(a == b == c for a, b in zip(y, p))
        f1 += y.count(c) * 2 * tp / (y.count(c) + p.count(c))
    assert found["Accuracy"] == pytest.approx(sum(a == b for a, b in zip(y, p)) / 10)
    assert found["F1"] == pytest.approx(f1 / 10)


@pytest.mark.parametrize("y,p,want", [([1, 2, 3], [1, 2, 4], 0.5), ([2, 2], [2, 2], 1.0), ([2, 2], [2, 3], 0.0)])
def test_regression_metrics(spark, y, p, want):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    found = metrics.regression_metrics(df, "y", "p").first()
    assert found["R2"] == pytest.approx(want)
    assert found["MSE"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(y, p)) / len(y))
    assert math.isfinite(found["R2"])


def test_many_columns_add_up_in_a_tree(spark, monkeypatch):
    """Few rows a task are handed on, whatever the number of pairs; strips and levels agree with one aggregate."""
    pick = np.random.default_rng(3)
    data = pick.normal(5, 2, (300, 15)) @ pick.normal(0, 1, (15, 15))
    rows = [[None if (i + j) % 13 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(15))).repartition(9)
    monkeypatch.setattr(charts, "FAN_IN", 2)
    want = {(r.col_a, r.col_b): r.r for r in charts.correlation_matrix(df, jvm_columns=20).collect()}
    for pairs in (1, 40, 10**6):
        monkeypatch.setattr(charts, "STRIP_PAIRS", pairs)
        found = {(r.col_a, r.col_b): r.r for r in charts.correlation_matrix(df, jvm_columns=1).collect()}
        assert found == pytest.approx(want, abs=1e-9) and len(found) == 225
    monkeypatch.setattr(charts, "STRIP_PAIRS", 10**6)
    values = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(df.columns)])
    plan = charts._many_columns(values, [0.0] * 15)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(strip") == 4  # 9 tasks, 5, 3, 2, 1
    assert len(charts._strips(4)) == 1



def test_marks_of_table_versions(spark, people):
    rows = spark.range(200).selectExpr("id", "id * 37 % 101 AS v", "IF(id % 7 = 0, NULL, CAST(id AS string)) AS t").repartition(5, "v").persist()
    mark = profile.table_mark(rows)
    assert mark.rows == 200 and profile.table_mark(rows.where("id >= 0")).same(mark)
    # Dealt anew without a sort: the same rows. Sorted: another order, unless it was that order already.
    assert profile.table_mark(rows.repartition(3)).same(mark)
    by_v = profile.table_mark(rows.orderBy("v", "id"))
    assert by_v.sorted and not by_v.same(mark)
    assert profile.table_mark(rows.orderBy("v", "id").coalesce(1).orderBy("v", "id")).same(by_v)
    assert not profile.table_mark(rows.orderBy("id")).same(by_v)
    for other in (rows.where("id <> 5"), rows.withColumn("v", F.expr("IF(id = 9, 0, v)")), rows.withColumn("v", F.col("v").cast("int")), rows.union(rows.limit(1))):
        assert not profile.table_mark(other).same(mark)
    assert profile.table_mark(rows.limit(0)).rows == 0
    rows.unpersist()


def test_running_totals_in_range_parts(spark):
    pick = random.Random(4)
    data = [(i, pick.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k int, v int").repartition(7)
    found = {r.k: r.before for r in ranks.total_before(df, ["k"], "v", "before").collect()}
    assert found == {k: sum(v for _, v in data[:k]) for k, _ in data}
