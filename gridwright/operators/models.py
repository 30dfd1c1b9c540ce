"""Model choice, training against a baseline, comparison by cross-validation."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.constants import CLASSIFICATION, FOLDS, SEED
from gridwright.functions.ranks import with_row_index
from gridwright.functions.semantics import column, dtype, known
from gridwright.functions.storage import staged
from gridwright.operators import spread_trees, trees
from gridwright.operators.checks import require_rows, require_target
from gridwright.operators.columns import features_and_label
from gridwright.operators.encode import FEATURES, TablePrep, feature_names, prepared, stage_names
from gridwright.operators.metrics import score
from gridwright.operators.neighbors import votes_of_nearest
from gridwright.operators.profile import default_features, detect_task
from gridwright.operators.split import TEST, TRAIN, assign_folds, plan_split, split_by_plan

LABEL, PREDICTION = "_label", "prediction"
# Ridge weight, relative to the row count, that only decides between equal fits.
VANISHING = 1e-10
# Classes are listed on the driver and in the model, so their number is checked.
MAX_CLASSES = 10_000
# Rows from which on a forest for classes is grown from rows that are alike.
MANY_ROWS = 100_000
# Training rows of a task. A fit goes over its rows again and again, so its time counts, not the bytes of its rows.
TASK_ROWS = 5_000


@dataclass(frozen=True)
class NeighbourModel:
    """The training rows themselves, with what a prediction needs to know."""

    train: DataFrame  # _id, _vec, _label
    k: int
    weights: str
    classes: bool


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows in even parts for the tasks of a fit.

    Adaptive execution joins partitions by their bytes: a table of some MB would be one partition, and each pass of a
    fit over it one task.
    """
    parts = min(math.ceil(rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts) if parts > 1 and df.rdd.getNumPartitions() < parts else df


def _tree_params(params: dict[str, Any]) -> dict[str, Any]:
    chosen = params.get("max_depth")
    if chosen is None:
        warnings.warn(f"Trees without a limit end at depth {trees.DEEPEST}.", stacklevel=2)
    return {
        "maxDepth": trees.DEEPEST if chosen is None else min(int(chosen), trees.DEEPEST),
        "minInstancesPerNode": int(params.get("min_samples_leaf", 1)),
        "seed": SEED,
        # Each row's node is kept, so a level does not walk every tree from its root again.
        "cacheNodeIds": True,
        "featuresCol": FEATURES,
        "labelCol": LABEL,
    }


def algorithm_name(task: str, algo: str) -> str:
    """The estimator behind an algorithm's display name, found by a part of the name."""
    if "Random Forest" in algo:
        return "forest"
    if "KNN" in algo:
        return "neighbours"
    if task == CLASSIFICATION:
        return "logistic" if "Logistic" in algo else "tree"
    if "Linear" in algo:
        return "linear"
    return "tree" if "Decision Tree" in algo else "ridge"


def candidate_models(task: str) -> dict[str, dict[str, Any]]:
    """What a comparison tries, with the parameters that differ from the defaults."""
    if task == CLASSIFICATION:
        return {
            "Logistic Regression": {},
            "Random Forest": {"n_estimators": 50},
            "KNN": {"n_neighbors": 5},
            "Decision Tree": {},
        }
    return {
        "Linear Regression": {},
        "Random Forest": {"n_estimators": 50},
        "KNN Regressor": {"n_neighbors": 5},
        "Ridge": {"alpha": 1.0},
    }


def _forest(task: str, shared: dict[str, Any], params: dict[str, Any]):
    count = int(params.get("n_estimators", 100))
    if task == CLASSIFICATION:
        return RandomForestClassifier(featureSubsetStrategy="sqrt", numTrees=count, **shared)
    return RandomForestRegressor(featureSubsetStrategy="all", numTrees=count, **shared)


def _forest_of_alike(train: DataFrame, forest: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """The forest grown from rows with the same bins as one, where there are many rows and few that differ.

    The library goes over all rows for each level, and for each lot of open nodes.
    """
    sound = F.count_if(F.col(LABEL).between(0, MAX_CLASSES - 1) & (F.col(LABEL) == F.floor(LABEL)))
    rows, known_rows, last = train.agg(F.count("*"), sound, F.max(LABEL)).first()
    if rows < MANY_ROWS or known_rows < rows:  # the library says what is wrong with labels
        return None
    # A fit to no more than the classes gives the form that a model has; its trees are then put in place.
    width = train.select(F.size(vector_to_array(FEATURES))).first()[0]
    few = train.sparkSession.createDataFrame([(Vectors.sparse(width, {}), float(c)) for c in range(int(last) + 1)], [FEATURES, LABEL])
    form = forest.fit(few.select(FEATURES, F.col(LABEL).alias(LABEL, metadata=train.schema[LABEL].metadata)))
    nodes, borders = spread_trees.forest_nodes(
        train, FEATURES, LABEL, rows, forest.getNumTrees(), form.numClasses, forest.getMinInstancesPerNode(), forest.getMaxDepth()
    )
    if nodes is None:
        return None
    model = trees.with_nodes(form, nodes)
    model.borders = borders  # of the bins; for scoring many rows at once
    return model


def _fit_trees(train: DataFrame, task: str, name: str, params: dict[str, Any]):
    """A tree or forest within the depth and the least number of rows to split that are asked for."""
    shared = _tree_params(params)
    tree = (DecisionTreeClassifier if task == CLASSIFICATION else DecisionTreeRegressor)(**shared)
    estimator = tree if name == "tree" else _forest(task, shared, params)
    model = _forest_of_alike(train, estimator) if name == "forest" and task == CLASSIFICATION else None
    if model is None:
        model = estimator.fit(train)
    if int(params.get("max_depth") or 0) > trees.DEEPEST:
        model = trees.deeper(model, train, tree, int(params["max_depth"]))
    if int(params.get("min_samples_split", 2)) > 2:
        model = trees.least_split(model, int(params["min_samples_split"]), train.sparkSession)
    return model


def _logistic(train: DataFrame, params: dict[str, Any]):
    """C weighs the sum of losses; Spark weighs their mean, hence the row count."""
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=1000, standardization=False, elasticNetParam=0.0,
        regParam=1.0 / (float(params.get("C", 1.0)) * train.count()),
        fitIntercept=bool(params.get("fit_intercept", True)),
    )


def _linear(train: DataFrame, params: dict[str, Any], penalty: float | None):
    """Least squares, with a ridge penalty if given.

    The category columns of one source column add up to the intercept, so plain
    least squares has many solutions. A vanishing penalty picks the smallest one.
    """
    # Spark scales the label by its deviation before applying the penalty.
    rows, spread = train.agg(F.count("*"), F.stddev_pop(LABEL)).first()
    reg = VANISHING * spread if penalty is None else penalty * spread / rows
    return LinearRegression(
        featuresCol=FEATURES, labelCol=LABEL, regParam=reg, elasticNetParam=0.0, standardization=False,
        fitIntercept=bool(params.get("fit_intercept", True)), maxIter=1000, tol=1e-10,
    )


def _with_id(rows: DataFrame, name: str) -> DataFrame:
    """Add a fixed bigint id: ids are drawn once and written out, so they cannot change."""
    return staged(rows.withColumn(name, F.monotonically_increasing_id()))


def fit_estimator(
    train: DataFrame, task: str, algo: str, params: dict[str, Any], row_id: str | None = None
) -> Transformer | NeighbourModel:
    """Fit one algorithm on prepared rows (feature vector and numeric label).

    ``row_id`` names a bigint column that identifies a row, if there is one.
    """
    name = algorithm_name(task, algo)
    if name == "neighbours":
        rows = train.select(
            *([F.col(row_id).alias("_id")] if row_id else []),
            vector_to_array(F.col(FEATURES)).alias("_vec"), F.col(LABEL).cast("double").alias(LABEL),
        )
        rows = rows if row_id else _with_id(rows, "_id")
        return NeighbourModel(
            rows, int(params.get("n_neighbors", 5)), params.get("weights", "uniform"), task == CLASSIFICATION
        )
    if name in ("forest", "tree"):
        return _fit_trees(train, task, name, params)
    if name == "logistic":
        return _logistic(train, params).fit(train)
    return _linear(train, params, float(params.get("alpha", 1.0)) if name == "ridge" else None).fit(train)


def neighbour_predictions(rows: DataFrame, model: NeighbourModel, name: str, row_id: str | None = None) -> DataFrame:
    """Add the vote of the nearest training rows as column ``name``."""
    asked = rows.withColumn("_query", F.col(row_id)) if row_id else _with_id(rows, "_query")
    points = asked.select("_query", vector_to_array(F.col(FEATURES)).alias("_vec"))
    votes = votes_of_nearest(points, model.train, model.k, model.weights, model.classes)
    return asked.join(votes.withColumnRenamed("prediction", name), "_query").drop("_query")


@dataclass
class TrainedModel:
    """A fitted preparation and model, usable on any table with the feature columns."""

    prep: PipelineModel
    core: Transformer | NeighbourModel
    task: str
    target: str
    features: list[str]
    classes: list[str] | None  # class texts in label order
    target_type: str
    algo: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    metrics: dict[str, float] | None = None
    baseline: dict[str, Any] | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def predict(self, df: DataFrame, defaults: dict[str, Any] | None = None) -> DataFrame:
        """The table with a ``prediction`` column.

        Feature columns the table lacks are taken from ``defaults``.
        """
        absent = [f for f in self.features if f not in df.columns]
        unknown = [f for f in absent if f not in (defaults or {})]
        if unknown:
            raise ValueError(f"Columns not found: {unknown}")
        full = df.select("*", *[F.lit(defaults[f]).alias(f) for f in absent]) if absent else df
        ready = prepared(self.prep, full)
        if isinstance(self.core, NeighbourModel):
            scored = neighbour_predictions(ready, self.core, "_predicted")
        else:
            scored = self.core.transform(ready).withColumn("_predicted", F.col(self.core.getPredictionCol()))
        value = F.col("_predicted")
        if self.classes is not None:
            value = _class_text(self.classes, value).cast(self.target_type)
        return scored.select(*[column(c) for c in df.columns], value.alias(PREDICTION))

    def importance(self) -> list[tuple[str, float]]:
        """Features with tree importance or coefficient size, largest first; empty for neighbours.

        With several classes only the first class's coefficients are reported.
        """
        if isinstance(self.core, NeighbourModel):
            return []
        if hasattr(self.core, "featureImportances"):
            weights = self.core.featureImportances.toArray()
        elif hasattr(self.core, "coefficientMatrix"):
            weights = abs(self.core.coefficientMatrix.toArray()[0])
        elif hasattr(self.core, "coefficients"):
            weights = abs(self.core.coefficients.toArray())
        else:
            return []
        names = self.meta.get("feature_names") or stage_names(self.prep)
        if len(names) != len(weights):  # an input column that is a vector without a stage that tells its entries
            names = [f"feature {i}" for i in range(len(weights))]
        return sorted(zip(names, map(float, weights)), key=lambda f: (-f[1], f[0]))


def _class_text(classes: Sequence[str], index):
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (index + 1).cast("int"))


def label_classes(df: DataFrame, target: str) -> list[str]:
    """Class texts in label order: by value for numbers, by text otherwise."""
    found = df.select(known(df, target).alias("v")).na.drop().distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes in '{target}'.")
    ordered = df.sparkSession.createDataFrame(
        sorted(found, key=lambda r: r["v"]), T.StructType([T.StructField("v", dtype(df, target))])
    )
    return [r[0] for r in ordered.select(F.col("v").cast("string")).collect()]


def _labelled(df: DataFrame, target: str, classes: list[str] | None) -> DataFrame:
    """Add the numeric label: the class position, or the value itself."""
    if classes is None:
        return df.select("*", known(df, target).cast("double").alias(LABEL))
    text = df.select("*", known(df, target).cast("string").alias("_label_text"))
    indexer = StringIndexerModel.from_labels(classes, inputCol="_label_text", outputCol=LABEL)
    return indexer.transform(text).drop("_label_text")


def baseline_value(train: DataFrame, label: str, task: str):
    """The most frequent class (smallest on a tie) or the mean label."""
    if task == CLASSIFICATION:
        counts = train.groupBy(column(label).alias("v")).agg(F.count("*").alias("n"))
        return counts.orderBy(F.desc("n"), "v").first()["v"]
    return train.agg(F.avg(column(label).cast("double"))).first()[0]


def baseline_predictions(parts: DataFrame, label: str, task: str, split: str = "split") -> DataFrame:
    """Test rows with the baseline's prediction learned from the training rows."""
    value = baseline_value(parts.where(column(split) == TRAIN), label, task)
    kind = dtype(parts, label) if task == CLASSIFICATION else T.DoubleType()
    return parts.where(column(split) == TEST).select("*", F.lit(value).cast(kind).alias(PREDICTION))


def train_with_baseline(
    df: DataFrame, target: str, algo: str, params: dict[str, Any] | None = None, task: str | None = None,
    test_size: float = 0.2, key: Sequence[str] = (),
) -> TrainedModel:
    """Split, fit preparation and model on the training part, score both on the test part.

    ``key`` names columns that identify a row; they are not features. Without it rows
    are numbered first. Metrics and the baseline's metrics are kept on the result.
    """
    require_rows(df)
    require_target(df, target)
    params = dict(params or {})
    features = [f for f in features_and_label(df, target) if f not in set(key)]
    if not features:
        raise ValueError("No features are left beside the label.")
    task = task or detect_task(df, target)
    if not key:
        df, key = with_row_index(df, name="_row_key"), ["_row_key"]
    plan = plan_split(df, target, test_size, task)
    classes = label_classes(df, target) if task == CLASSIFICATION else None
    slim = df.select(*[column(c) for c in dict.fromkeys([*key, *features, target])])
    parts = _labelled(split_by_plan(slim, target, plan, key, name="_split"), target, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = parts.where(F.col("_split") == TRAIN), parts.where(F.col("_split") == TEST)
        if test.count() != plan.test_rows:
            raise ValueError(f"The key {list(key)} does not identify rows.")
        base = score(baseline_predictions(parts, LABEL, task, "_split"), LABEL, PREDICTION, task)
        prep = TablePrep(features).fit(train)
        ready = _spread(prepared(prep, train), plan.train_rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            core = fit_estimator(ready.select(FEATURES, LABEL), task, algo, params)
            names = feature_names(prep, ready)
        finally:
            ready.unpersist()
        model = TrainedModel(
            prep, core, task, target, features, classes, dtype(df, target).simpleString(), algo, params,
            meta={"target": target, "feature_names": names},
        )
        scored = _scored(core, _spread(prepared(prep, test), plan.test_rows))
        model.metrics = {**score(scored, LABEL, "_predicted", task), "test_size": float(test_size)}
        strategy = "most_frequent" if task == CLASSIFICATION else "mean"
        model.baseline = {**base, "strategy": strategy}
        return model
    finally:
        parts.unpersist()


def _grown_apart(
    train: DataFrame, task: str, algo: str, params: dict[str, Any], rows: int, classes: Sequence[str] | None
) -> spread_trees.SpreadTrees | None:
    """Trees without a limit of depth on more rows than one task's: as many nodes as rows, which no model should hold."""
    name = algorithm_name(task, algo)
    if name not in ("forest", "tree") or params.get("max_depth") is not None or rows <= TASK_ROWS:
        return None
    if int(params.get("min_samples_split", 2)) > 2:
        return None
    shared = _tree_params(params)
    count = int(params.get("n_estimators", 100)) if name == "forest" else 1
    return spread_trees.SpreadTrees(
        train, rows, count, len(classes or ()), shared["minInstancesPerNode"], shared["maxDepth"],
        some=name == "forest" and task == CLASSIFICATION,
    )


def _scored(
    core: Transformer | NeighbourModel | spread_trees.SpreadTrees, ready: DataFrame, row_id: str | None = None
) -> DataFrame:
    rows = ready.select(FEATURES, LABEL, *([row_id] if row_id else []))
    if isinstance(core, spread_trees.SpreadTrees):
        said = spread_trees.predictions(core, rows, FEATURES, row_id, LABEL)
        return rows.join(said.withColumnRenamed(PREDICTION, "_predicted"), row_id)
    if isinstance(core, NeighbourModel):
        return neighbour_predictions(rows, core, "_predicted", row_id)
    if getattr(core, "borders", None) and not row_id:
        said = spread_trees.said_by_bins(core, rows, FEATURES, LABEL)
        if said is not None:
            return said.withColumnRenamed(core.getPredictionCol(), "_predicted")
    return core.transform(rows).withColumnRenamed(core.getPredictionCol(), "_predicted")


def compare_models(
    df: DataFrame, target: str, parallelism: int = 4, order_by: Sequence[str] = (),
    candidates: dict[str, dict[str, Any]] | None = None, on_failure: Callable[[str, Exception], None] | None = None,
) -> DataFrame:
    """Mean score and its deviation over the folds per candidate, best first.

    Accuracy for classes, R2 for numbers. The preparation is fitted again in each
    fold on that fold's training rows only. A candidate that fails is left out; when
    all fail, the first error is raised.
    """
    require_rows(df)
    features = features_and_label(df, target)
    task = detect_task(df, target)
    if task == CLASSIFICATION:
        rows, smallest = (
            df.groupBy(known(df, target)).agg(F.count("*").alias("n")).agg(F.sum("n"), F.min("n")).first()
        )
        if smallest < 2:
            raise ValueError("A comparison takes 2 rows or more in each target class.")
    else:
        rows = smallest = df.count()
        if rows < 2:
            raise ValueError("A comparison takes 2 rows or more.")
    folds = min(FOLDS, smallest, rows)
    candidates = candidate_models(task) if candidates is None else candidates
    classes = label_classes(df, target) if task == CLASSIFICATION else None
    numbered = with_row_index(df, order_by, name="_row_key")
    dealt = assign_folds(numbered, "_row_key", folds, target if classes is not None else None, "_fold")
    parts = _labelled(dealt, target, classes).persist(StorageLevel.MEMORY_AND_DISK)
    # The neighbour count cannot exceed the smallest training part.
    least_train = rows - math.ceil(rows / folds)
    metric = "Accuracy" if task == CLASSIFICATION else "R2"
    used = [f for f in features if f not in set(order_by)]

    def one_fold(fold: int) -> dict[str, float | Exception]:
        """Scores of all candidates on one fold; a failing one must not stop the others."""
        inside = parts.where(F.col("_fold") != fold)
        try:
            prep = TablePrep(used).fit(inside)
        except ValueError as problem:
            return {name: problem for name in candidates}
        train, test = (
            _spread(prepared(prep, part).select("_row_key", FEATURES, LABEL), rows).persist(StorageLevel.MEMORY_AND_DISK)
            for part in (inside, parts.where(F.col("_fold") == fold))
        )
        found: dict[str, float | Exception] = {}
        try:
            for name, settings in candidates.items():
                settings = dict(settings)
                if "n_neighbors" in settings:
                    settings["n_neighbors"] = max(1, min(settings["n_neighbors"], least_train))
                try:
                    core = _grown_apart(train, task, name, settings, rows, classes)
                    core = core or fit_estimator(train, task, name, settings, "_row_key")
                    found[name] = score(_scored(core, test, "_row_key"), LABEL, "_predicted", task)[metric]
                except Exception as problem:
                    found[name] = problem
        finally:
            train.unpersist()
            test.unpersist()
        return found

    try:
        # Folds run side by side: Spark shares the executors between their jobs.
        with ThreadPoolExecutor(parallelism) as pool:
            results = list(pool.map(one_fold, range(folds)))
    finally:
        parts.unpersist()
    scores = {name: [found[name] for found in results] for name in candidates}
    failures = {
        name: next(v for v in values if isinstance(v, Exception))
        for name, values in scores.items() if any(isinstance(v, Exception) for v in values)
    }
    for name, problem in failures.items():
        if on_failure:
            on_failure(name, problem)
    rows = [(n, [float(v) for v in s]) for n, s in scores.items() if n not in failures]
    if not rows:
        name, problem = next(iter(failures.items()), ("", "no candidate"))
        raise ValueError(f"The comparison failed for every candidate; {name}: {problem}")
    table = df.sparkSession.createDataFrame(rows, "Model string, scores array<double>")
    return (
        table.select("Model", F.explode("scores").alias("s")).groupBy("Model")
        .agg(F.avg("s").alias("Score"), F.stddev_pop("s").alias("Std")).orderBy(F.desc("Score"), "Model")
    )


def score_batch(model: TrainedModel, df: DataFrame, edited: Sequence[str], source: DataFrame) -> DataFrame:
    """Predict rows that give only some features; the others take safe defaults from ``source``."""
    rest = [f for f in model.features if f not in edited]
    slim = df.select(*[column(c) for c in df.columns if c not in rest])
    return model.predict(slim, default_features(source, rest))

