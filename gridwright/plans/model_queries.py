"""Models whose fit has a closed form or few steps in SQL, and the guards' messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.constants import CLASSIFICATION, REGRESSION
from gridwright.functions.semantics import require_columns
from gridwright.functions.storage import shared_folder
from gridwright.operators import checks, columns, models
from gridwright.operators.encode import FEATURES, TablePrep, prepared
from gridwright.plans import fixtures as fx
from gridwright.plans.queries import EVEN_SPLIT, query, rounded
from gridwright.plans.workspace import Workspace


@query(
    "compare_models_lines",
    """WITH r AS (SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, ntile(5) OVER (ORDER BY o_orderkey) AS fold FROM orders),
t AS (SELECT f AS fold, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy, count(*) AS n
  FROM r, range(1, 6) AS k(f) WHERE fold <> f GROUP BY f),
m AS (SELECT * FROM (VALUES ('Linear Regression', 0), ('Ridge', 1)) AS m(model, penalty)),
e AS (SELECT model, fold, y, my + (x - mx) / sx * (cxy / sx * n / (n + penalty)) AS p FROM r JOIN t USING (fold), m),
s AS (SELECT model, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY ALL)
SELECT model AS "Model", round(avg(r2), 6) AS "Score", round(stddev_pop(r2), 6) AS "Std" FROM s GROUP BY 1""",
)
def compare_models_lines(spark, folder):
    """The two candidates with closed forms over all folds."""
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    candidates = {n: p for n, p in models.candidate_models(REGRESSION).items() if n in ("Linear Regression", "Ridge")}
    return rounded(models.compare_models(df, "o_totalprice", order_by=["o_orderkey"], candidates=candidates), 6, "Score", "Std")


@query(
    "importance_line",
    f"""WITH {EVEN_SPLIT}, t AS (SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM p WHERE split = 'Train')
SELECT 'num__o_custkey' AS feature, round(abs(covar_pop(x, y) / stddev_pop(x)), 3) AS importance FROM t""",
)
def importance_line(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = models.train_with_baseline(df, "o_totalprice", "Linear/Logistic Regression", {}, REGRESSION, 0.25, ["o_orderkey"])
    return rounded(importances(spark, model), 3, "importance")


def importances(spark, model: models.TrainedModel) -> DataFrame:
    return spark.createDataFrame(model.importance(), "feature string, importance double")


@query(
    "importance_one_cut",
    f"""WITH {EVEN_SPLIT}, t AS (SELECT * FROM p WHERE split = 'Train'),
g AS (SELECT o_orderpriority AS c, count(*) AS n, sum(o_totalprice) AS s FROM t GROUP BY 1),
a AS (SELECT sum(n) AS rows, sum(s) AS total FROM g)
SELECT 'cat__o_orderpriority_' || c AS feature, CASE WHEN c = arg_max(c, s * s / n + (total - s) * (total - s) / (rows - n)) OVER ()
  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM g, a""",
)
def importance_one_cut(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    model = models.train_with_baseline(df, "o_totalprice", "Decision Tree", {"max_depth": 1}, REGRESSION, 0.25, ["o_orderkey"])
    return importances(spark, model)


@query(
    "train_logistic_fit",
    """WITH RECURSIVE d AS (SELECT CAST(n_chars AS DOUBLE) AS x, quality AS y FROM labels JOIN documents USING (doc_id)),
z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z, y FROM d),
fit AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT step, a, b, sum(q - y) AS ga, sum((q - y) * z) + b / {c} AS gb, sum(q * (1 - q)) AS haa, sum(q * (1 - q) * z) AS hab,
      sum(q * (1 - q) * z * z) + 1 / {c} AS hbb
    FROM (SELECT step, a, b, z, y, 1 / (1 + exp(-a - b * z)) AS q FROM fit, z WHERE step < 20) GROUP BY step, a, b))
SELECT round(a, 2) AS intercept, round(b, 2) AS coefficient FROM fit WHERE step = 20""".format(c="0.5::DOUBLE"),
)
def train_logistic_fit(spark, folder):
    """Both parameters of a fit to one scaled number, with a penalty on the coefficient alone."""
    left = fx.table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias(models.LABEL))
    df = left.join(fx.table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    core = models.fit_estimator(prepared(TablePrep(["n_chars"]).fit(df), df), CLASSIFICATION, "Logistic Regression", {"C": 0.5})
    found = [(core.intercept, float(core.coefficients[0]))]
    return rounded(spark.createDataFrame(found, "intercept double, coefficient double"), 2, "intercept", "coefficient")


def message(action) -> str:
    """What a guard says; empty where it lets the table pass."""
    try:
        action()
        return ""
    except ValueError as problem:
        return str(problem)


@query(
    "guard_messages",
    """SELECT 'rows' AS guard, CASE WHEN count(*) FILTER (o_orderkey < 0) = 0 THEN 'The table is empty: it has no rows or was not loaded.' ELSE '' END AS message FROM orders
UNION ALL SELECT 'some rows', CASE WHEN count(*) = 0 THEN 'The table is empty: it has no rows or was not loaded.' ELSE '' END FROM orders
UNION ALL SELECT 'columns', CASE WHEN count(*) FILTER (column_name IN ('o_orderkey', 'margin', 'region')) < 3 THEN 'Columns not found: [''margin'', ''region'']' ELSE '' END
  FROM (DESCRIBE orders)
UNION ALL SELECT 'label', CASE WHEN count(*) FILTER (column_name = 'margin') = 0 THEN 'The label column ''margin'' was not found.' ELSE '' END FROM (DESCRIBE orders)
UNION ALL SELECT 'complete label', CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'The label has missing values; fill them or drop their rows.' ELSE '' END FROM orders
UNION ALL SELECT 'features', string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE orders) WHERE column_name <> 'o_orderstatus'""",
)
def guard_messages(spark, folder):
    """The guards on tables that they refuse or let pass, and the features beside a label."""
    plain, missing = fx.table(spark, folder, "orders"), fx.orders(spark, folder)
    found = {
        "rows": message(lambda: checks.require_rows(plain.where("o_orderkey < 0"))), "some rows": message(lambda: checks.require_rows(plain)),
        "columns": message(lambda: require_columns(plain, ["o_orderkey", "margin", "region"])),
        "label": message(lambda: columns.features_and_label(plain, "margin")),
        "complete label": message(lambda: columns.features_and_label(missing, "price")),
        "features": ",".join(sorted(columns.features_and_label(plain, "o_orderstatus"))),
    }
    return spark.createDataFrame(list(found.items()), "guard string, message string")


@query(
    "workspace_forgotten",
    """SELECT 'saved' AS state, count(*) AS rows FROM orders UNION ALL SELECT 'in memory', 0 UNION ALL SELECT 'restored', 0
UNION ALL SELECT 'loaded again', count(*) FROM orders""",
)
def workspace_forgotten(spark, folder):
    """A workspace reset after saving: tables, history, log and snapshot are gone, and it can be used anew."""
    df, place = fx.table(spark, folder, "orders"), f"{shared_folder(spark)}/forgotten-{folder.rstrip('/').rsplit('/', 1)[-1]}"
    work = Workspace(spark, place).load(df, "Orders")
    work.apply(lambda d: d.withColumn("o_totalprice", F.col("o_totalprice") + 1), "Raise prices")
    work.save()
    other = Workspace(spark, place)
    found = [("saved", other.current.count() if other.restore() else 0)]
    work.reset_workspace()
    found.append(("in memory", 0 if work.current is None and not work.history and not work.steps else 1))
    found.append(("restored", 1 if Workspace(spark, place).restore() else 0))
    found.append(("loaded again", work.load(df, "Orders").current.count()))
    return spark.createDataFrame(found, "state string, rows long")
