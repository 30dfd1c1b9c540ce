import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridwright.constants import CLASSIFICATION, REGRESSION
from gridwright.operators import encode, models, neighbors, split, trees
from gridwright.sources import model_store


# -- split and folds


def by_class(parts, label, side):
    return {r[0]: r[1] for r in parts.where(F.col("split") == side).groupBy(label).count().collect()}


@pytest.fixture(scope="module")
def classes(spark):
    """One class holds most rows; others are small."""
    rows = [(i, "big" if i % 10 < 7 else "mid" if i % 10 < 9 else f"s{i % 3}") for i in range(1003)]
    return spark.createDataFrame(rows, "id long, c string").repartition(5)


@pytest.mark.parametrize("fraction", [0.2, 0.33])
def test_split_sizes_and_determinism(classes, fraction):
    parts = split.train_test_split(classes, "c", fraction, CLASSIFICATION, ["id"])
    test, train = by_class(parts, "c", "Test"), by_class(parts, "c", "Train")
    sizes = {c: test.get(c, 0) + train.get(c, 0) for c in {**test, **train}}
    rows = sum(sizes.values())
    wanted = rows - math.ceil(fraction * rows)
    assert rows == 1003 and sum(train.values()) == wanted
    exact = {c: n * wanted / rows for c, n in sizes.items()}
    spare = wanted - sum(math.floor(v) for v in exact.values())
    ranked = sorted(exact, key=lambda c: (-(exact[c] - math.floor(exact[c])), c))
    assert train == {c: math.floor(v) + (c in ranked[:spare]) for c, v in exact.items()}


def test_split_is_the_same_with_and_without_buckets(classes):
    def test_ids(group_rows):
        parts = split.train_test_split(classes, "c", 0.2, CLASSIFICATION, ["id"], group_rows=group_rows)
        return {r["id"] for r in parts.where("split = 'Test'").collect()}

    assert test_ids(10**6) == test_ids(20) == test_ids(3)


def test_split_composite_key_and_regression(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"), F.rand(1).alias("y"))
    parts = split.train_test_split(df, "y", 0.25, REGRESSION, ["a", "b"], group_rows=9)
    assert tuple(split.split_sizes(parts).first()) == (75, 25, 25.0)


@pytest.mark.parametrize(
    "rows,label,fraction,task",
    [
        ([("a", 1)] * 3, "c", 0.2, CLASSIFICATION), ([("a", 1)] * 5 + [("b", 1)], "c", 0.2, CLASSIFICATION),
        ([("a", 1)] * 9, "c", 0.0, CLASSIFICATION), ([("a", 1)] * 9, "c", 1.0, REGRESSION),
        ([("a", 1)] * 9, "c", 0.2, "ranking"), ([("a", 1)] * 9, "gone", 0.2, REGRESSION),
        ([("a", 1), ("b", 1), ("c", 1)] * 2, "c", 0.2, CLASSIFICATION), ([("a", 1)] * 8 + [(None, 2)] * 2, "c", 0.2, CLASSIFICATION),
    ],
)
def test_split_guards(spark, rows, label, fraction, task):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, c string, n int")
    with pytest.raises(ValueError):
        split.train_test_split(df, label, fraction, task, ["id"])


def test_preview_falls_back_and_explains(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(8)], "id long, c string")
    parts, stratified, reason = split.split_preview(df, "c", 0.25, CLASSIFICATION, ["id"])
    assert not stratified and reason is None and by_class(parts, "split", "Test") == {"Test": 2}
    holes = df.withColumn("c", F.when(F.col("id") > 2, F.col("c")))
    assert split.split_preview(holes, "c", 0.25, CLASSIFICATION, ["id"])[2].startswith("The label has missing values")


def test_class_counts_are_zero_filled(spark):
    df = spark.createDataFrame([("a", "Train"), ("a", "Test"), ("b", "Train")], "c string, split string")
    assert {(r[0], r[1]): r[2] for r in split.split_class_counts(df, "c").collect()} == {
        ("a", "Train"): 1, ("a", "Test"): 1, ("b", "Train"): 1, ("b", "Test"): 0,
    }


@pytest.mark.parametrize("group_rows", [10**6, 7])
@pytest.mark.parametrize("folds", [2, 5])
def test_class_folds_deal_rows_round(spark, folds, group_rows):
    labels = [("cab"[(i * i) % 3] if i % 4 else "a") for i in range(101)]
    df = spark.createDataFrame(list(enumerate(labels)), "_row long, c string").repartition(3)
    found = {r["_row"]: r["fold"] for r in split.assign_folds(df, "_row", folds, "c", group_rows=group_rows).collect()}
    codes = {c: i for i, c in enumerate(dict.fromkeys(labels))}
    dealt = np.sort([codes[c] for c in labels])
    share = np.array([np.bincount(dealt[f::folds], minlength=len(codes)) for f in range(folds)])
    want = {}
    for c, code in codes.items():
        order = np.arange(folds).repeat(share[:, code])
        want.update(zip([i for i, x in enumerate(labels) if x == c], order))
    assert found == want


@pytest.mark.parametrize("rows,folds", [(11, 4), (10, 5), (7, 2)])
def test_plain_folds_are_runs(spark, rows, folds):
    df = spark.range(rows).withColumnRenamed("id", "_row")
    found = [r["fold"] for r in split.assign_folds(df, "_row", folds).orderBy("_row").collect()]
    assert found == [f for f, part in enumerate(np.array_split(range(rows), folds)) for _ in part]


# -- features


def test_preparation(spark):
    df = spark.createDataFrame(
        [(1.0, "b", True, None), (3.0, "", None, None), (None, None, False, None), (5.0, "b", False, None)],
        "`x.y` double, t string, f boolean, gone double",
    )
    prep = encode.TablePrep(df.columns).fit(df)
    ready = encode.prepared(prep, df)
    assert encode.feature_names(prep, ready) == ["num__x_y", "cat__t_", "cat__t_b", "cat__f_false", "cat__f_true"]
    got = np.array([r[0] for r in ready.select(vector_to_array(encode.FEATURES)).collect()])
    x = np.array([1.0, 3.0, 3.0, 5.0])
    assert got[:, 0] == pytest.approx((x - x.mean()) / x.std())
    assert got[:, 1:].tolist() == [[0, 1, 0, 1], [1, 0, 1, 0], [0, 1, 1, 0], [0, 1, 1, 0]]
    other = spark.createDataFrame([(3.0, "new", True, 1.0)], df.schema)
    assert encode.prepared(prep, other).select(vector_to_array(encode.FEATURES)).first()[0] == [0, 0, 0, 0, 1]


def test_preparation_guards(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "t string, n double")
    with pytest.raises(ValueError, match="categories"):
        encode.TablePrep(["t"], max_categories=1).fit(df)
    with pytest.raises(ValueError, match="No usable"):
        encode.TablePrep(["n"]).fit(df)


def test_filled_moments_match_a_direct_computation(spark):
    values = [1.0, 2.0, None, 50.0, None, 7.5, 8.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    filled = np.array([7.5 if v is None else v for v in values])
    got = [r[0] for r in encode.standardised(df, ["v"]).collect()]
    assert got == pytest.approx(list((filled - filled.mean()) / filled.std()))


# -- neighbours


def brute(queries, train, k):
    gaps = np.sqrt(((queries[:, None, :] - train[None, :, :]) ** 2).sum(axis=2))
    return [[(i, d[i]) for i in np.lexsort((np.arange(len(train)), d))[:k]] for d in gaps]


@pytest.mark.parametrize("piece,pivots,rings,query_piece", [(10**4, None, 8, 10**4), (10**4, 64, 8, 10**4), (10, 6, 3, 7), (20, 4, 2, 100), (25, 1, 4, 1000)])
def test_neighbours_agree_with_brute_force(spark, piece, pivots, rings, query_piece):
    pick = np.random.default_rng(5)
    train = np.vstack([pick.normal(0, 1, (250, 3)), np.tile([0.5, 0.5, 0.5], (150, 1)), pick.normal(20, 0.1, (100, 3))])
    asked = np.vstack([pick.normal(0, 5, (30, 3)), [[0.5, 0.5, 0.5], [20, 20, 20], [-100, 3, 4]]])
    t = spark.createDataFrame([(i, [float(x) for x in v], float(i % 3)) for i, v in enumerate(train)], "_id long, _vec array<double>, _label double").repartition(4)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "_query long, _vec array<double>").repartition(2)
    found = neighbors.nearest_rows(q, t, 7, piece, query_piece, pivots, rings).orderBy("_query", "rank").collect()
    want = brute(asked, train, 7)
    assert len(found) == 7 * len(asked)
    for r in found:
        i, d = want[r["_query"]][r["rank"] - 1]
        assert r["_id"] == i and r["distance"] == pytest.approx(d, abs=1e-12)


def pairs_visited(spark, train, asked, k, pivots=None, rings=neighbors.RINGS):
    """The share of all pairs that the two phases compare."""
    t = spark.createDataFrame([(i, [float(x) for x in v], 0.0) for i, v in enumerate(train)], "_id long, _vec array<double>, _label double")
    placed, blocks = neighbors._build_blocks(t, len(train), 10**4, pivots, rings)
    assert placed.count() == len(train) == blocks.size.sum()
    radius = [float(n[-1][1]) for n in brute(asked, train, k)]
    rows = [(i, [float(x) for x in v], r) for i, (v, r) in enumerate(zip(asked, radius))]
    q = spark.createDataFrame(rows, "_query long, _vec array<double>, _radius double")
    size = dict(zip(blocks.block.tolist(), blocks.size.tolist()))
    home = [(r["_query"], r["_block"]) for r in neighbors._visits(q, blocks, k, True).collect()]
    other = [(r["_query"], r["_block"]) for r in neighbors._visits(q, blocks, k, False).collect()]
    assert not set(home) & set(other)
    return sum(size[b] for _, b in home + other) / (len(train) * len(asked))


def test_blocks_are_skipped(spark):
    """Far clusters: a query visits few of the pieces."""
    pick = np.random.default_rng(1)
    train = np.vstack([pick.normal(100 * c, 1, (200, 2)) for c in range(6)])
    assert pairs_visited(spark, train, np.zeros((1, 2)), 5, 12, 4) < 0.5


def test_clustered_vectors_in_many_dimensions_visit_few_pairs(spark):
    pick = np.random.default_rng(2)
    centers = pick.normal(0, 10, (60, 64))
    train = np.vstack([c + pick.normal(0, 1, (100, 64)) for c in centers])
    asked = centers[pick.integers(0, 60, 40)] + pick.normal(0, 1, (40, 64))
    assert pairs_visited(spark, train, asked, 5) < 0.1


def test_a_query_goes_to_lots_not_to_pieces(spark):
    """Without clusters every block is in reach; a query used to be sent to each of hundreds of pieces."""
    pick = np.random.default_rng(4)
    train = pick.normal(0, 1, (400, 32))
    t = spark.createDataFrame([(i, [float(x) for x in v], 0.0) for i, v in enumerate(train)], "_id long, _vec array<double>, _label double")
    asked = t.select(F.col("_id").alias("_query"), "_vec", F.lit(1e9).alias("_radius"))
    placed, blocks = neighbors._build_blocks(t, len(train), 2, 8, 3)
    lots = placed.select("_lot").distinct().count()
    assert 1 < lots <= 8 and placed.groupBy("_block", "_lot").count().count() < 40
    both = neighbors._visits(asked, blocks, 5, True, True).select("_query", "_lot").unionAll(
        neighbors._visits(asked, blocks, 5, False, True).select("_query", "_lot"))
    assert both.count() == both.distinct().count() == len(train) * lots
    found = neighbors.nearest_rows(asked.drop("_radius"), t, 5, 2, 100, 8, 3).collect()
    want = brute(train, train, 5)
    assert {(r["_query"], r["rank"], r["_id"]) for r in found} == {(q, i + 1, int(want[q][i][0])) for q in range(400) for i in range(5)}


def test_a_large_block_has_lots_of_its_own():
    first, count = neighbors._lots(np.array([5, 25, 3, 4, 9]), [np.array([0, 1]), np.array([2, 3, 4])], 10)
    assert first.tolist() == [0, 1, 4, 4, 5] and count.tolist() == [1, 3, 1, 1, 1]


def test_a_query_s_own_lot_is_not_compared_as_a_whole(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(3000, 1)), np.eye(4)[rng.integers(0, 4, 3000)]], axis=1)
    vectors[-300:] = vectors[0]  # more copies than neighbours
    points = np.concatenate([vectors[rng.integers(0, 3000, 2000)] + 1e-3, [[50.0, 0, 0, 0, 0]]])
    pivots = vectors[:60]
    d = np.sqrt(((vectors[:, None] - pivots[None]) ** 2).sum(axis=2))
    at, away = neighbors._nearest(vectors, pivots)
    assert (at == d.argmin(axis=1)).all() and np.allclose(away, d.min(axis=1))
    block, of = np.unique(at * 4 + (away > 0.05) + (away > 0.2), return_inverse=True)
    near, far = (np.array([f(away[of == b]) for b in range(len(block))]) for f in (np.min, np.max))
    lot = np.zeros(len(block), int)
    blocks = neighbors.Blocks(
        pivots, block, block // 4, np.bincount(of), near, far, lot, lot + 1, *neighbors._balls(pivots, block // 4, far)
    )
    rows = pd.DataFrame({"_id": np.arange(3000), "_vec": list(vectors), "_label": 1.0, "_block": block[of]})
    asked = pd.DataFrame({"_query": np.arange(2001), "_vec": list(points), "_radius": np.nan})
    pairs, best = [], neighbors._best
    monkeypatch.setattr(neighbors, "_best", lambda data, *rest: pairs.append(len(data) * len(rest[2])) or best(data, *rest))
    found = neighbors._closest(rows, asked, 5, blocks, True).sort_values(["_query", "distance", "_id"])
    true = neighbors._distances(points, vectors)
    wanted = np.lexsort((np.broadcast_to(np.arange(3000), true.shape), true), axis=-1)[:, :5]
    assert (found["_id"].to_numpy().reshape(-1, 5) == wanted).all()
    assert sum(pairs) < 0.7 * len(rows) * len(asked)


def test_more_neighbours_than_rows(spark):
    t = spark.createDataFrame([(0, [1.0], 2.0), (1, [3.0], 4.0)], "_id long, _vec array<double>, _label double")
    q = spark.createDataFrame([(9, [1.0])], "_query long, _vec array<double>")
    near = neighbors.nearest_rows(q, t, 5)
    assert near.count() == 2
    assert neighbors.vote(near, "uniform", classes=False).first()["prediction"] == 3.0
    assert neighbors.vote(near, "distance", classes=False).first()["prediction"] == 2.0
    assert neighbors.vote(near).first()["prediction"] == 2.0
    with pytest.raises(ValueError):
        neighbors.vote(near, "cubic")


# -- models


@pytest.fixture(scope="module")
def numbers(spark):
    pick = np.random.default_rng(3)
    x = pick.normal(0, 2, (300, 2))
    y = 3 * x[:, 0] - x[:, 1] + 5 + pick.normal(0, 0.5, 300)
    rows = [(i, float(a), float(b), "uvw"[i % 3], float(c), "hi" if c > 5 else "lo") for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, g string, y double, c string").repartition(3)


def train_matrix(df, target, size, task, features):
    parts = split.train_test_split(df, target, size, task, ["id"])
    rows = parts.where("split = 'Train'").collect()
    x = np.array([[r[f] for f in features] for r in rows])
    return (x - x.mean(0)) / x.std(0), np.array([r[target] for r in rows])


@pytest.mark.parametrize("algo,alpha", [("Linear/Logistic Regression", 0.0), ("Ridge", 1.0), ("Ridge", 40.0)])
def test_linear_models_match_the_closed_form(numbers, algo, alpha):
    df = numbers.select("id", "a", "b", "y")
    model = models.train_with_baseline(df, "y", algo, {"alpha": alpha} if alpha else {}, None, 0.2, ["id"])
    x, y = train_matrix(df, "y", 0.2, REGRESSION, ["a", "b"])
    want = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ (y - y.mean()))
    assert model.core.coefficients.toArray() == pytest.approx(want, rel=1e-6)
    assert model.core.intercept == pytest.approx(y.mean())
    assert model.metrics["R2"] > 0.9 > model.baseline["R2"] and model.baseline["strategy"] == "mean"
    assert model.importance()[0][0] == "num__a"


@pytest.mark.parametrize("c", [0.1, 1.0])
def test_logistic_gradient_is_zero_for_the_summed_loss(numbers, c):
    df = numbers.select("id", "a", "b", "c")
    model = models.train_with_baseline(df, "c", "Linear/Logistic Regression", {"C": c}, None, 0.2, ["id"])
    x, y = train_matrix(df, "c", 0.2, CLASSIFICATION, ["a", "b"])
    t = (y == "lo").astype(float)
    w, b = model.core.coefficients.toArray(), model.core.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + c * x.T @ (p - t)).max() < 1e-2 * c
    assert abs((p - t).sum()) < 1e-2


@pytest.mark.parametrize("algo,params", [("Random Forest", {"n_estimators": 10, "max_depth": 30}), ("Decision Tree", {"max_depth": None, "min_samples_leaf": 3}), ("KNN", {"weights": "distance"}), ("Linear/Logistic Regression", {})])
def test_classifiers_beat_the_baseline_and_survive_saving(spark, numbers, tmp_path, algo, params):
    df = numbers.select("id", "a", "b", "g", "c")
    model = models.train_with_baseline(df, "c", algo, params, key=["id"])
    assert model.metrics["Accuracy"] > 0.85 > model.baseline["Accuracy"]
    assert model.task == CLASSIFICATION and model.features == ["a", "b", "g"]
    model_store.save_model(spark, model, str(tmp_path / "m"))
    again = model_store.load_model(spark, str(tmp_path / "m"))
    assert json.loads(json.dumps(again.metrics)) == model.metrics and again.meta == model.meta
    first = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
    assert first == {r["id"]: r["prediction"] for r in again.predict(df).collect()}
    assert set(first.values()) == {"hi", "lo"} and len(first) == 300
    assert model_store.target_warning(again, ["a"]) and not model_store.target_warning(again, ["c"])
    if "KNN" in algo:
        assert again.importance() == []
    else:
        assert {n for n, _ in again.importance()} == {"num__a", "num__b", "cat__g_u", "cat__g_v", "cat__g_w"}


def test_numeric_classes_come_back_in_their_type(spark):
    df = spark.createDataFrame([(i, float(i % 50), 0.25 if i % 50 < 25 else 10.0) for i in range(200)], "id long, x double, t double")
    model = models.train_with_baseline(df, "t", "Decision Tree", {"max_depth": 3}, key=["id"])
    out = model.predict(df)
    assert model.task == CLASSIFICATION and dict(out.dtypes)["prediction"] == "double"
    assert out.where("prediction <> t").count() == 0


def test_bare_pipeline_loads_without_facts(spark, numbers, tmp_path):
    model = models.train_with_baseline(numbers.select("id", "a", "b", "y"), "y", "Linear", key=["id"])
    model_store.save_model(spark, model, str(tmp_path / "m"))
    bare = model_store.load_model(spark, str(tmp_path / "m" / "pipeline"))
    assert bare.meta == {} and bare.metrics is None and bare.predict(numbers).count() == 300
    with pytest.raises(ValueError, match="No model"):
        model_store.save_model(spark, None, str(tmp_path / "n"))


def test_bare_pipeline_tells_names_and_class_texts(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, float(i % 7), "abc"[i % 3] if i % 5 else None, "" if i % 2 else "x", float(i % 7) * 2 + i % 3) for i in range(60)],
        "id long, n double, c string, e string, y double",
    )
    model = models.train_with_baseline(rows, "y", "Linear", key=["id"])
    model_store.save_model(spark, model, str(tmp_path / "m"))
    bare = model_store.load_model(spark, str(tmp_path / "m" / "pipeline"))
    assert bare.importance() == model.importance() and "cat__e_" in dict(bare.importance())
    label = StringIndexer(inputCol="e", outputCol="label").fit(rows)
    ready = VectorAssembler(inputCols=["n"], outputCol="_features")
    core = DecisionTreeClassifier(featuresCol="_features", labelCol="label").fit(ready.transform(label.transform(rows)))
    back = IndexToString(inputCol="prediction", outputCol="text", labels=label.labels)
    PipelineModel([ready, core, back]).write().save(str(tmp_path / "classes"))
    got = model_store.load_model(spark, str(tmp_path / "classes")).predict(rows)
    assert {r[0] for r in got.select("prediction").distinct().collect()} <= {"", "x"} and got.schema["prediction"].dataType.simpleString() == "string"


def test_training_without_key_and_scoring_with_defaults(numbers):
    df = numbers.select("a", "b", "g", "y")
    model = models.train_with_baseline(df, "y", "Linear/Logistic Regression")
    got = models.score_batch(model, df.select("a"), ["a"], df)
    assert got.columns == ["a", "prediction"] and got.count() == 300
    with pytest.raises(ValueError, match="Columns not found"):
        model.predict(df.select("a"))


def test_training_guards(spark, numbers):
    with pytest.raises(ValueError, match="not found"):
        models.train_with_baseline(numbers, "gone", "KNN")
    with pytest.raises(ValueError, match="missing values"):
        models.train_with_baseline(numbers.withColumn("y", F.when(F.col("a") > 0, F.col("y"))), "y", "KNN")
    with pytest.raises(ValueError, match="No features"):
        models.train_with_baseline(numbers.select("y"), "y", "KNN")
    with pytest.raises(ValueError, match="does not identify"):
        models.train_with_baseline(numbers.withColumn("k", F.lit(1)).select("k", "a", "y"), "y", "Linear", key=["k"])


def test_algorithm_names():
    assert models.algorithm_name(CLASSIFICATION, "Linear/Logistic Regression") == "logistic"
    assert models.algorithm_name(REGRESSION, "Linear/Logistic Regression") == "linear"
    assert models.algorithm_name(CLASSIFICATION, "anything") == "tree"
    assert models.algorithm_name(REGRESSION, "anything") == "ridge"
    assert models.algorithm_name(REGRESSION, "KNN Regressor") == "neighbours"


def test_comparison(numbers):
    board = models.compare_models(numbers.select("id", "a", "b", "y"), "y", order_by=["id"], candidates={"Linear Regression": {}, "Ridge": {}, "KNN Regressor": {"n_neighbors": 1000}})
    found = board.collect()
    assert [r["Model"] for r in found][-1] == "KNN Regressor" and found[0]["Score"] > 0.9 and found[0]["Std"] >= 0
    # Unshuffled runs of rows, scored by hand.
    rows = sorted(numbers.collect(), key=lambda r: r["id"])
    x, y = np.array([[r["a"], r["b"], 1.0] for r in rows]), np.array([r["y"] for r in rows])
    scores = []
    for part in np.array_split(np.arange(300), 5):
        rest = np.setdiff1d(np.arange(300), part)
        w = np.linalg.lstsq(x[rest], y[rest], rcond=None)[0]
        scores.append(1 - ((y[part] - x[part] @ w) ** 2).sum() / ((y[part] - y[part].mean()) ** 2).sum())
    linear = next(r for r in found if r["Model"] == "Linear Regression")
    assert linear["Score"] == pytest.approx(np.mean(scores), abs=1e-6) and linear["Std"] == pytest.approx(np.std(scores), abs=1e-6)


def test_comparison_guards(spark, numbers):
    with pytest.raises(ValueError, match="each target class"):
        models.compare_models(spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b")], "x double, c string"), "c")
    noted = []
    with pytest.raises(ValueError, match="comparison failed"):
        models.compare_models(numbers.select("a", "y").withColumn("a", F.lit(None).cast("double")), "y", on_failure=lambda n, e: noted.append(n))
    assert len(noted) == 4


# -- trees beyond the library's limits


def tree_rows(spark, rows=400):
    pick = np.random.default_rng(8)
    data = [(i, float(pick.normal()), float(pick.integers(0, 9)), 0.0) for i in range(rows)]
    data = [(i, a, b, float(a * a > 0.5) + float(b > 4) + 0.1 * a) for i, a, b, _ in data]
    return VectorAssembler(inputCols=["a", "b"], outputCol=encode.FEATURES).transform(
        spark.createDataFrame(data, f"id long, a double, b double, {models.LABEL} double")
    )


def test_least_rows_to_split(spark):
    df = tree_rows(spark)
    for name in ("Decision Tree", "Random Forest"):
        found = models.fit_estimator(df, REGRESSION, name, {"max_depth": 8, "min_samples_split": 60, "n_estimators": 3})
        plain = models.fit_estimator(df, REGRESSION, name, {"max_depth": 8, "n_estimators": 3})
        for tree, whole in zip(*([[m] if name == "Decision Tree" else m.trees for m in (found, plain)])):
            nodes, = trees._nodes(tree, spark)
            inner = nodes[nodes.leftChild >= 0]
            reached = {0, *inner.leftChild, *inner.rightChild}
            assert nodes.rawCount[0] >= 60 and (inner.rawCount >= 60).all() and whole.numNodes > tree.numNodes > 1
            old, = trees._nodes(whole, spark)
            assert reached >= {0} and len(old[(old.leftChild >= 0) & (old.rawCount >= 60)]) == len(inner)
        assert type(found) is type(plain) and found.transform(df).count() == 400


@pytest.mark.parametrize("task", [REGRESSION, CLASSIFICATION])
def test_trees_grow_on_beyond_the_limit(spark, monkeypatch, task):
    df = tree_rows(spark)
    if task == CLASSIFICATION:
        df = df.withColumn(models.LABEL, (F.col("a") * 3 + F.col("b")).cast("int") % 3 + 0.0).where(F.col(models.LABEL) >= 0)
    whole = models.fit_estimator(df, task, "Decision Tree", {"max_depth": 7})
    monkeypatch.setattr(trees, "DEEPEST", 3)
    found = models.fit_estimator(df, task, "Decision Tree", {"max_depth": 7})
    assert 3 < found.depth <= 7
    # Later cuts are offered from the rows of their node, so the grown tree fits the training rows at least about as well.
    loss = lambda m: m.transform(df).select(F.avg(F.pow(F.col("prediction") - F.col(models.LABEL), 2))).first()[0]
    assert loss(found) <= 1.1 * loss(whole) + 1e-9
    forest = models.fit_estimator(df, task, "Random Forest", {"max_depth": 5, "n_estimators": 2, "min_samples_split": 4})
    assert max(t.depth for t in forest.trees) > 3


def test_a_tree_of_depth_over_30(spark):
    df = VectorAssembler(inputCols=["x"], outputCol=encode.FEATURES).transform(
        spark.range(40).selectExpr("CAST(id AS double) AS x", f"pow(3.0D, id) AS `{models.LABEL}`")
    )
    cut = {d: models.fit_estimator(df, REGRESSION, "Decision Tree", {"max_depth": d}) for d in (30, 38)}
    assert cut[30].depth == 30 < cut[38].depth <= 38
    exact = {d: m.transform(df).where(F.col("prediction") == F.col(models.LABEL)).count() for d, m in cut.items()}
    assert exact[38] > exact[30]


def test_a_fit_goes_over_its_rows_in_many_tasks(spark, monkeypatch):
    """Adaptive execution joins small partitions, so a fit used to read a table of few bytes in one task."""
    monkeypatch.setattr(models, "TASK_ROWS", 50)
    seen, fit = [], models.fit_estimator

    def noted(train, *rest, **more):
        seen.append(train.rdd.getNumPartitions())
        return fit(train, *rest, **more)

    monkeypatch.setattr(models, "fit_estimator", noted)
    df = spark.range(400).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS x", "IF(id % 7 > 3, 'a', 'b') AS y").coalesce(1)
    model = models.train_with_baseline(df, "y", "Random Forest", {"n_estimators": 3, "max_depth": 3}, key=["k"])
    models.compare_models(df, "y", order_by=["k"], candidates={"Decision Tree": {"max_depth": 3}})
    assert seen and min(seen) == 4 and model.core.getOrDefault("cacheNodeIds")
    assert model.metrics["Accuracy"] == 1.0


def test_rows_for_one_task_stay_as_they_are(spark):
    df = spark.range(100).coalesce(1)
    assert models._spread(df, 100) is df
