"""Trees without a limit of depth that are grown in the tasks, against the library's own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gridwright.constants import CLASSIFICATION, REGRESSION
from gridwright.operators import encode, models, neighbors, spread_trees, trees


def table(spark, rows, classes, settled=False):
    """Numbers, two of them mostly 0, with a label that they do not settle, or one that they do."""
    label = "CAST(pmod(xxhash64(id), 3) AS DOUBLE)" if classes else "a * 3 - b + pmod(xxhash64(id), 10) / 5"
    df = spark.range(rows).selectExpr("id AS k", "*", "CAST(id % 23 AS DOUBLE) - 11 AS a", "CAST(id % 7 = 3 AS DOUBLE) AS b", "CAST(id % 5 = 1 AS DOUBLE) AS c")
    label = "CAST(pmod(xxhash64(a, b, c), 3) AS DOUBLE)" if settled else label
    df = df.selectExpr("k", "a", "b", "c", f"{label} AS `{models.LABEL}`")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol=encode.FEATURES).transform(df).select("k", encode.FEATURES, models.LABEL).repartition(3)


def predicted(model, rows):
    found = spread_trees.predictions(model, rows, encode.FEATURES, "k", models.LABEL).collect()
    assert len({r["k"] for r in found}) == len(found)
    return {r["k"]: r["prediction"] for r in found}


@pytest.mark.parametrize("classes, least", [(0, 1), (0, 4), (3, 1), (3, 5)])
@pytest.mark.parametrize("most", [100_000, 60])
def test_one_tree_says_what_the_library_says(spark, monkeypatch, classes, least, most):
    """Also where the first splits are found by sums over all rows."""
    monkeypatch.setattr(spread_trees, "NODE_ROWS", most)
    df = table(spark, 700, classes)
    train, asked = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    ours = predicted(spread_trees.SpreadTrees(train, 700, 1, classes, least, 30, False), asked)
    with pytest.warns(UserWarning):
        tree = models.fit_estimator(train, CLASSIFICATION if classes else REGRESSION, "Decision Tree", {"min_samples_leaf": least})
    theirs = {r["k"]: r["prediction"] for r in tree.transform(asked).collect()}
    assert ours.keys() == theirs.keys()
    assert all(abs(ours[k] - theirs[k]) < 1e-9 for k in theirs)


@pytest.mark.parametrize("classes, some", [(0, False), (0, True), (3, False)])
def test_where_nodes_are_split_does_not_matter(spark, monkeypatch, classes, some):
    df = table(spark, 900, classes, settled=bool(classes))  # pure leaves: others are joined below a task's node only
    train, asked = df.where("k % 3 <> 0"), df.where("k % 3 = 0")
    model = spread_trees.SpreadTrees(train, 900, 7, classes, 1, 30, some)
    whole = predicted(model, asked)
    monkeypatch.setattr(spread_trees, "NODE_ROWS", 40)
    parts = predicted(model, asked.repartition(5))
    assert whole.keys() == parts.keys() and len(whole) == 300
    assert all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)


def test_rows_are_routed_by_their_bins_without_going_over_their_entries_at_each_split(monkeypatch):
    rng = np.random.default_rng(3)
    width, rows = 6, 500
    zero = np.array([0, 2, 0, 1, 0, 3])
    place = rng.integers(0, 5, (rows, width))
    row, feature = np.nonzero(place != zero)
    code = feature * spread_trees.BINS + place[row, feature]
    plan = spread_trees.Plan(width, zero, 2, 1, 30, width, False, np.empty(0, int), np.empty(0, int))
    top = spread_trees.Top([1, 5, -1, 0, -1, -1, -1], [2, 3, 0, 0, 0, 0, 0], [1, 3, -1, 5, -1, -1, -1], [0, 1, 1, 2, 2, 3, 3], [0] * 7, {})
    plain = spread_trees._routed(top, rows, row, code, plan)
    calls = []
    monkeypatch.setattr(spread_trees, "_right", lambda *a: calls.append(a))
    bins = spread_trees._bins(rows, row, code, plan)
    assert (bins == place).all() and not calls
    assert (spread_trees._routed(top, rows, row, code, plan, bins) == plain).all()
    some = np.arange(0, rows, 3)
    assert (spread_trees._routed(top, rows, row, code, plan, bins, some)[some] == plain[some]).all()
    assert not calls and set(plain) == {2, 4, 5, 6}
    monkeypatch.setattr(spread_trees, "HELD_NUMBERS", rows * width - 1)
    assert spread_trees._bins(rows, row, code, plan) is None


def test_a_forest_comes_near_the_library_s(spark):
    df = table(spark, 2000, 0)
    train, asked = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    ours = predicted(spread_trees.SpreadTrees(train, 2000, 30, 0, 1, 30, False), asked)
    with pytest.warns(UserWarning):
        forest = models.fit_estimator(train, REGRESSION, "Random Forest", {"n_estimators": 30})
    rows = forest.transform(asked).collect()
    label, theirs = (np.array([r[c] for r in rows]) for c in (models.LABEL, "prediction"))
    error = np.mean((np.array([ours[r["k"]] for r in rows]) - label) ** 2)
    assert error == pytest.approx(np.mean((theirs - label) ** 2), rel=0.05)


def test_alike_rows_are_one_leaf_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(spread_trees, "NODE_ROWS", 50)
    df = spark.createDataFrame([(i, Vectors.sparse(3, {}), float(i % 2)) for i in range(400)], ["k", encode.FEATURES, models.LABEL])
    train, asked = df.where("k >= 100"), df.where("k < 100")
    assert set(predicted(spread_trees.SpreadTrees(train, 300, 1, 0, 1, 30, False), asked).values()) == {0.5}
    assert set(predicted(spread_trees.SpreadTrees(train, 300, 1, 2, 1, 30, False), asked).values()) == {0.0}


def test_a_missing_label_fails_as_before(spark):
    df = table(spark, 50, 0).withColumn(models.LABEL, F.when(F.col("k") > 0, F.col(models.LABEL)))
    with pytest.raises(ValueError, match="no label"):
        predicted(spread_trees.SpreadTrees(df, 50, 1, 0, 1, 30, False), df)


def test_a_comparison_holds_no_tree_without_a_limit(spark, monkeypatch):
    """It used to fit the library's trees, whose open nodes are summed with all features by every task."""
    monkeypatch.setattr(models, "TASK_ROWS", 50)
    fitted, fit = [], models.fit_estimator

    def noted(train, task, algo, *rest):
        fitted.append(algo)
        return fit(train, task, algo, *rest)

    monkeypatch.setattr(models, "fit_estimator", noted)
    df = spark.range(300).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS x", "IF(id % 7 > 3, 'a', 'b') AS y")
    with pytest.warns(UserWarning):
        board = models.compare_models(df, "y", order_by=["k"], candidates={"Random Forest": {"n_estimators": 5}, "Decision Tree": {}, "KNN": {"n_neighbors": 3}})
    assert {r["Model"]: r["Score"] for r in board.collect()} == {"Random Forest": 1.0, "Decision Tree": 1.0, "KNN": 1.0}
    assert set(fitted) == {"KNN"}


@pytest.mark.parametrize("classes, least", [(0, 1), (0, 4), (3, 1), (3, 5)])
def test_rows_that_are_alike_are_one(spark, monkeypatch, classes, least):
    """A tree used to take each row for itself, so its time grew with the rows, whatever their bins."""
    df = table(spark, 4000, classes)
    train, asked = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    model = spread_trees.SpreadTrees(train, 4000, 5, classes, least, 30, False)
    monkeypatch.setattr(spread_trees, "TIMES", 1e9)
    plain = predicted(model, asked)
    monkeypatch.undo()
    monkeypatch.setattr(spread_trees, "_tops", None)  # goes over all rows
    monkeypatch.setattr(spread_trees, "HELD_CELLS", 500)  # a task's sums come in parts
    ours = predicted(model, asked)
    assert ours.keys() == plain.keys() and len(ours) == 1000
    assert all(abs(ours[k] - plain[k]) < 1e-9 for k in ours)


def test_a_task_holds_a_bounded_number_of_rows_that_differ(monkeypatch):
    monkeypatch.setattr(spread_trees, "ALIKE", 50)
    batches = [
        pa.RecordBatch.from_pydict({"id": list(range(i, i + 20)), "y": [float(n % 2) for n in range(20)], "e": pa.array([[n, i] for n in range(20)], pa.list_(pa.int32()))})
        for i in range(0, 400, 20)
    ]
    parts = list(spread_trees._alike(iter(batches + batches), lambda ids, y: [(0, np.ones(len(ids)))], 1, 2))
    assert len(parts) > 5 and all(len(c) <= 50 + 20 for _, c, _, _ in parts)
    found = {}
    for e, c, ids, table in parts:
        for key, of, i, n in zip(e.to_pylist(), c.tolist(), ids.tolist(), table[0].tolist()):
            assert i == key[1] + key[0] and of == key[0] % 2
            found[tuple(key)] = found.get(tuple(key), 0) + n
    assert len(found) == 400 and set(found.values()) == {2.0}


def test_a_table_of_nodes_is_the_library_s_tree(spark, monkeypatch):
    monkeypatch.setattr(spread_trees, "BORDER_ROWS", 4000)
    df = table(spark, 3000, 3)
    with_all = models.fit_estimator(df, CLASSIFICATION, "Decision Tree", {"max_depth": 5, "min_samples_leaf": 3})
    width, found = spread_trees._borders(df, encode.FEATURES)
    plan = spread_trees._planned(width, found, 3, 3, 5, False, False)
    rows = df.collect()
    vectors = np.array([r[encode.FEATURES].toArray() for r in rows])
    place = np.array([[np.searchsorted(found[f], v) for f, v in enumerate(x)] for x in vectors])
    row, feature = np.nonzero(place != plan.zero)
    label = np.array([r[models.LABEL] for r in rows])
    made = spread_trees._nodes(np.ones(len(rows)), label, row, feature * spread_trees.BINS + place[row, feature], 0, found, plan)
    form = RandomForestClassifier(numTrees=1, maxDepth=5, featuresCol=encode.FEATURES, labelCol=models.LABEL, seed=1).fit(df)
    model = trees.with_nodes(form, spark.createDataFrame(pa.Table.from_batches([made]).to_pylist(), NODES))
    theirs = {r["k"]: r["probability"].toArray() for r in with_all.transform(df).collect()}
    ours = {r["k"]: r["probability"].toArray() for r in model.transform(df).collect()}
    assert all(np.allclose(ours[k], theirs[k]) for k in theirs)
    assert model.totalNumNodes == with_all.numNodes
    assert np.allclose(model.featureImportances.toArray(), with_all.featureImportances.toArray())


NODES = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int,"
    " split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)


def test_a_limited_forest_of_many_rows_is_grown_from_alike_ones(spark, monkeypatch):
    """The library's fit went over all rows for each level."""
    # The label follows the numbers in part, so the share of rows that a forest gets right says whether it is grown well.
    label = "IF(pmod(xxhash64(id), 3) = 0, pmod(xxhash64(id, 1), 3), pmod(CAST(a / 4 AS INT) + CAST(b AS INT), 3))"
    df = spark.range(6000).selectExpr("id AS k", "id", "CAST(id % 23 AS DOUBLE) AS a", "CAST(id % 7 = 3 AS DOUBLE) AS b", "CAST(id % 5 = 1 AS DOUBLE) AS c")
    df = df.selectExpr("k", "a", "b", "c", f"CAST({label} AS STRING) AS y")
    params = {"n_estimators": 20, "max_depth": 6, "min_samples_leaf": 2}
    plain = models.train_with_baseline(df, "y", "Random Forest", params, key=["k"])
    monkeypatch.setattr(models, "MANY_ROWS", 1000)
    fits = []
    fit = models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, rows: fits.append(rows.count()) or fit(self, rows))
    ours = models.train_with_baseline(df, "y", "Random Forest", params, key=["k"])
    assert fits == [3]
    assert ours.metrics["Accuracy"] == pytest.approx(plain.metrics["Accuracy"], abs=0.02) and ours.metrics["Accuracy"] > 0.7
    assert ours.core.getNumTrees == 20 and max(t.depth for t in ours.core.trees) <= 6
    # Scoring by bins says what the model says row by row.
    asked = models._labelled(encode.prepared(ours.prep, df), "y", ours.classes)
    by_bins = spread_trees.said_by_bins(ours.core, asked, encode.FEATURES, models.LABEL).groupBy(models.LABEL, "prediction").count()
    by_rows = ours.core.transform(asked).groupBy(models.LABEL, "prediction").count()
    assert {tuple(r) for r in by_bins.collect()} == {tuple(r) for r in by_rows.collect()}
    assert dict(ours.importance()).keys() == dict(plain.importance()).keys()
    strong = lambda m: m.importance()[0][0]
    assert strong(ours) == strong(plain)
    monkeypatch.setattr(spread_trees, "ALIKE", 10)  # too many differ: the library's fit on all rows
    models.train_with_baseline(df, "y", "Random Forest", params, key=["k"])
    assert len(fits) == 3 and fits[2] > 4000


def test_equal_vectors_are_looked_up_once(spark, monkeypatch):
    rows = spark.range(900).selectExpr(
        "id * 7 % 900 AS _id", "array(CAST(id % 3 AS DOUBLE), IF(id % 2 = 0, 0D, -0D)) AS _vec", "CAST(pmod(xxhash64(id), 4) AS DOUBLE) AS _label"
    ).repartition(3)
    asked = rows.where("_id % 5 = 0").select(F.col("_id").alias("_query"), "_vec")
    train = rows.where("_id % 5 <> 0")
    sizes, nearest = [], neighbors.nearest_rows
    monkeypatch.setattr(neighbors, "nearest_rows", lambda q, t, k: sizes.append((q.count(), t.count())) or nearest(q, t, k))
    for weights, classes in (("uniform", True), ("distance", False)):
        ours = neighbors.votes_of_nearest(asked, train, 5, weights, classes).collect()
        theirs = neighbors.vote(nearest(asked, train, 5), weights, classes).collect()
        assert len(ours) == 180 and {tuple(r) for r in ours} == {tuple(r) for r in theirs}
    assert all(q <= 6 and t <= 30 for q, t in sizes) and len(sizes) == 2
