"""The query list: each operator over a whole table, with the SQL that checks it.

Every entry is ``name: (function, sql)``. The function takes a session and a folder
of Parquet tables; the SQL gives the same columns, or is ``None`` where a result has
no SQL form (trees, iterative fits, file digests).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.constants import CLASSIFICATION, REGRESSION
from gridwright.functions.ranks import seeded_sample, with_row_index
from gridwright.functions.storage import shared_folder
from gridwright.operators import charts, columns, encode, metrics, missing, models, neighbors, outliers, profile
from gridwright.operators import rows as row_ops
from gridwright.operators import rules, split
from gridwright.plans import fixtures as fx
from gridwright.plans.workspace import Workspace
from gridwright.sources import ingest, model_store, text_tables
from gridwright.streaming import FittedCleaning

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"Query listed twice: {name}")
        REGISTRY[name] = (function, sql)
        return function

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- profile ----------------------------------------------------------------------

STATS = """SELECT CAST(count(*) AS BIGINT) AS rows, CAST({cols} AS BIGINT) AS cols,
  CAST({missing} AS BIGINT) AS missing,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS BIGINT) AS duplicates FROM {t}"""
ORDERS_MISSING = "coalesce(sum((price IS NULL)::INT + (priority IS NULL)::INT), 0)"
SLIM = "SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem"


def slim_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


@query("dataset_stats", f"WITH {fx.ORDERS} " + STATS.format(cols=5, missing=ORDERS_MISSING, t="orders_d"))
def dataset_stats(spark, folder):
    return profile.dataset_stats(fx.orders(spark, folder))


@query("dataset_stats_duplicates", f"WITH t AS ({SLIM}) " + STATS.format(cols=3, missing=0, t="t"))
def dataset_stats_duplicates(spark, folder):
    return profile.dataset_stats(slim_lineitem(spark, folder))


@query(
    "stats_delta",
    f"""WITH t AS ({SLIM}), u AS (SELECT DISTINCT * FROM t), a AS ({STATS.format(cols=3, missing=0, t="u")}),
b AS ({STATS.format(cols=3, missing=0, t="t")})
SELECT a.rows - b.rows AS rows, a.cols - b.cols AS cols, a.missing - b.missing AS missing,
  a.duplicates - b.duplicates AS duplicates FROM a, b""",
)
def stats_delta(spark, folder):
    base = slim_lineitem(spark, folder)
    return profile.stats_delta(row_ops.drop_duplicates(base), base)


@query(
    "workspace_counters",
    f"WITH {fx.ORDERS} SELECT count(*) AS rows, CAST(5 AS BIGINT) AS cols, "
    f"CAST({ORDERS_MISSING} AS BIGINT) AS missing FROM orders_d",
)
def workspace_counters(spark, folder):
    return profile.workspace_counters(fx.orders(spark, folder))


MISSING_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM orders_d"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "price", "priority")
)


@query("missing_by_column", f"WITH {fx.ORDERS} SELECT * FROM ({MISSING_ROWS}) ORDER BY missing DESC, \"column\" LIMIT 15")
def missing_by_column(spark, folder):
    return profile.missing_by_column(fx.orders(spark, folder))


# Digits that leave no tie in a mean over these columns.
NUMBERS = {"l_quantity": 8, "l_discount": 8, "l_tax": 8, "price": 4}
DESCRIBED = ("mean", "std", "min", "p25", "p50", "p75", "max")


def describe_sql(name: str, digits: int) -> str:
    return f"""SELECT '{name}' AS "column", count({name}) AS count, round(avg({name}), {digits}) AS mean,
  round(stddev_samp({name}), {digits}) AS std, round(min({name}), {digits}) AS min,
  round(quantile_cont({name}, 0.25), {digits}) AS p25, round(quantile_cont({name}, 0.5), {digits}) AS p50,
  round(quantile_cont({name}, 0.75), {digits}) AS p75, round(max({name}), {digits}) AS max FROM lineitem_d"""


@query("describe_numeric", f"WITH {fx.LINEITEM} " + " UNION ALL ".join(describe_sql(n, d) for n, d in NUMBERS.items()))
def describe_numeric(spark, folder):
    found = profile.describe(fx.lineitem(spark, folder).select(*NUMBERS)).select("column", "count", *DESCRIBED)
    price = F.col("column") == "price"
    return found.withColumns(
        {n: F.when(price, F.round(n, NUMBERS["price"])).otherwise(F.round(n, 8)) for n in DESCRIBED}
    )


def describe_text_sql(name: str) -> str:
    return f"""SELECT '{name}' AS "column", count({name}) AS count, count(DISTINCT {name}) AS "unique",
  (SELECT {name} FROM orders_d WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
  (SELECT count(*) FROM orders_d WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY 1 DESC LIMIT 1) AS freq
  FROM orders_d"""


@query("describe_text", f"WITH {fx.ORDERS} " + " UNION ALL ".join(map(describe_text_sql, ("o_orderstatus", "priority"))))
def describe_text(spark, folder):
    found = profile.describe(fx.orders(spark, folder).select("o_orderstatus", "priority"))
    return found.select("column", "count", "unique", "top", "freq")


@query(
    "value_counts_top10",
    "SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 10",
)
def value_counts_top10(spark, folder):
    return profile.value_counts(fx.table(spark, folder, "part"), "p_name")


TASK_COLUMNS = {
    "l_orderkey": 0, "l_linenumber": 0, "l_quantity": 0, "l_discount": 0, "l_tax": 0, "l_returnflag": 1,
    "l_linestatus": 1, "price": 0,
}


@query(
    "task_detect",
    f"WITH {fx.LINEITEM} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN {text} = 1 OR count(DISTINCT {c}) < 10 THEN 'classification' "
        f"ELSE 'regression' END AS task FROM lineitem_d" for c, text in TASK_COLUMNS.items()
    ),
)
def task_detect(spark, folder):
    df = fx.lineitem(spark, folder)
    return spark.createDataFrame(list(profile.task_types(df, df.columns).items()), "column string, task string")


@query(
    "default_features",
    f"""WITH {fx.CUSTOMER} SELECT round(coalesce(avg(acctbal), 0), 6) AS acctbal,
  coalesce((SELECT segment FROM customer_d WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), '')
  AS segment FROM customer_d""",
)
def default_features(spark, folder):
    df = fx.customer(spark, folder).select("acctbal", "segment")
    return rounded(profile.default_features_table(df), 6, "acctbal")


@query("column_range", f"WITH {fx.CUSTOMER} SELECT coalesce(min(acctbal), 0) AS low, coalesce(max(acctbal), 0) AS high FROM customer_d")
def column_range(spark, folder):
    return profile.column_range(fx.customer(spark, folder), "acctbal")


@query("distinct_values", f"WITH {fx.CUSTOMER} SELECT DISTINCT segment FROM customer_d WHERE segment IS NOT NULL")
def distinct_values(spark, folder):
    return row_ops.distinct_values(fx.customer(spark, folder), "segment")


@query("class_counts", f"WITH {fx.ORDERS} SELECT priority, count(*) AS rows FROM orders_d GROUP BY 1")
def class_counts(spark, folder):
    return profile.class_counts(fx.orders(spark, folder), "priority")


@query(
    "usable_folds",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, min(n) AS smallest_class, CAST(least(5, sum(n), min(n)) AS BIGINT) AS folds
FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)""",
)
def usable_folds(spark, folder):
    return profile.usable_folds(fx.table(spark, folder, "orders"), "o_orderstatus")


@query(
    "unchanged_steps",
    """SELECT 'sorted' AS step, NOT EXISTS (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL
  SELECT o_orderkey, o_totalprice FROM orders) AS unchanged
UNION ALL SELECT 'doubled', NOT EXISTS (SELECT o_orderkey, o_totalprice * 2 FROM orders EXCEPT ALL
  SELECT o_orderkey, o_totalprice FROM orders)""",
)
def unchanged_steps(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    doubled = df.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    found = [
        ("sorted", profile.is_unchanged(df.sort("o_totalprice"), df)), ("doubled", profile.is_unchanged(doubled, df)),
    ]
    return spark.createDataFrame(found, "step string, unchanged boolean")


# -- columns and rows ----------------------------------------------------------------


@query("search_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def search_columns(spark, folder):
    df = fx.table(spark, folder, "customer")
    return columns.search_columns(df.drop("c_nationkey"), "K")


@query("numeric_columns", f"WITH {fx.CUSTOMER} SELECT c_custkey, c_nationkey, acctbal FROM customer_d")
def numeric_columns(spark, folder):
    return columns.columns_of_class(fx.customer(spark, folder), "numeric")


@query("categorical_columns", f"WITH {fx.CUSTOMER} SELECT c_name, segment FROM customer_d")
def categorical_columns(spark, folder):
    return columns.columns_of_class(fx.customer(spark, folder), "categorical")


@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(spark, folder):
    return columns.drop_columns(fx.table(spark, folder, "customer"), ["c_acctbal", "c_mktsegment"])


@query("drop_existing_columns", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_existing_columns(spark, folder):
    return columns.drop_existing(fx.table(spark, folder, "customer"), ["c_acctbal", "no_such_column"])


@query("rename_column", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal AS balance FROM supplier")
def rename_column(spark, folder):
    return columns.rename_column(fx.table(spark, folder, "supplier"), "s_acctbal", " balance ")


@query(
    "coerce_number",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) ELSE event_type END
  AS DOUBLE) AS code FROM events""",
)
def coerce_number(spark, folder):
    mixed = F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    df = fx.table(spark, folder, "events").select("event_id", mixed.alias("code"))
    return columns.to_number(df, ["code"])


@query("row_index", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row, o_orderkey, o_totalprice FROM orders")
def row_index(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return with_row_index(df, ["o_orderkey"])


@query(
    "drop_row_index",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
WHERE NOT (r IN (0, 5) OR r BETWEEN 8 AND 12 OR r BETWEEN 90 AND 400)""",
)
def drop_row_index(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return row_ops.drop_row_positions(df, "0, 5, 8-12, 400 - 90,", ["o_orderkey"])


@query("drop_missing_rows", f"WITH {fx.ORDERS} SELECT * FROM orders_d WHERE price IS NOT NULL")
def drop_missing_rows(spark, folder):
    return row_ops.drop_missing_rows(fx.orders(spark, folder), "price")


@query("dedupe", SLIM.replace("SELECT", "SELECT DISTINCT"))
def dedupe(spark, folder):
    return row_ops.drop_duplicates(slim_lineitem(spark, folder))


@query(
    "dedupe_keep_first",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
)
def dedupe_keep_first(spark, folder):
    df = fx.table(spark, folder, "events").select("user_id", "event_type", "event_id")
    return row_ops.drop_duplicates(df, row="event_id")


@query("preview_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def preview_rows(spark, folder):
    return row_ops.preview(fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 25, ["o_orderkey"])


@query(
    "seeded_sample",
    """SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id LIMIT 6000""",
)
def sample(spark, folder):
    return seeded_sample(fx.table(spark, folder, "events").select("event_id", "value"), 6000, ["event_id"])


# -- rules ---------------------------------------------------------------------------

PRICED = "SELECT l_orderkey, l_linenumber, price FROM lineitem_d WHERE "
# Rule name, symbol, value and SQL mask; the mask is never null.
NUMBER_RULES = {
    "gt": (">", 50000.0, 0.0, "coalesce(price > 50000, FALSE)"),
    "ge": (">=", 50000.0, 0.0, "coalesce(price >= 50000, FALSE)"),
    "lt": ("<", 50000.0, 0.0, "coalesce(price < 50000, FALSE)"),
    "le": ("<=", 50000.0, 0.0, "coalesce(price <= 50000, FALSE)"),
    "between": ("between", 60000.0, 20000.0, "coalesce(price BETWEEN 20000 AND 60000, FALSE)"),
}
QUANTITY_RULES = {
    "eq": ("==", 7.0, "l_quantity IS NOT DISTINCT FROM 7"),
    "ne": ("!=", 7.0, "l_quantity IS DISTINCT FROM 7"),
}
SOURCES = "SELECT doc_id, src FROM documents_d WHERE "
TEXT_RULES = {
    "contains": ("contains", " SRC1[0-4] ", "regexp_matches(coalesce(src, ''), 'SRC1[0-4]', 'i')"),
    "equals": ("equals", "SRC3 ", "lower(coalesce(src, '')) = 'src3'"),
    "starts": ("starts with", "Src1", "starts_with(lower(coalesce(src, '')), 'src1')"),
    "ends": ("ends with", "C7", "ends_with(lower(coalesce(src, '')), 'c7')"),
    "empty": ("is empty", "", "trim(coalesce(src, '')) = ''"),
    "notempty": ("is not empty", "", "trim(coalesce(src, '')) <> ''"),
}


def _add_rules() -> None:
    def number_rule(column, rule, a, b, keep):
        def run(spark, folder):
            df = fx.lineitem(spark, folder).select("l_orderkey", "l_linenumber", column)
            return keep(df, rules.numeric_mask(df, column, rule, a, b))
        return run

    def text_rule(rule, value, keep):
        def run(spark, folder):
            df = fx.documents(spark, folder).select("doc_id", "src")
            return keep(df, rules.text_mask(df, "src", rule, value))
        return run

    for side, keep, sql_not in (("keep", rules.keep_rows, ""), ("drop", rules.drop_rows, "NOT ")):
        for name, (rule, a, b, mask) in NUMBER_RULES.items():
            query(f"rule_num_{name}_{side}", f"WITH {fx.LINEITEM} {PRICED}{sql_not}({mask})")(
                number_rule("price", rule, a, b, keep)
            )
        for name, (rule, a, mask) in QUANTITY_RULES.items():
            sql = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {sql_not}({mask})"
            query(f"rule_num_{name}_{side}", sql)(number_rule("l_quantity", rule, a, 0.0, keep))
        for name, (rule, value, mask) in TEXT_RULES.items():
            query(f"rule_txt_{name}_{side}", f"WITH {fx.DOCUMENTS} {SOURCES}{sql_not}({mask})")(
                text_rule(rule, value, keep)
            )


_add_rules()


@query("rule_ne_missing", f"WITH {fx.LINEITEM} {PRICED} price IS DISTINCT FROM 901")
def rule_ne_missing(spark, folder):
    df = fx.lineitem(spark, folder).select("l_orderkey", "l_linenumber", "price")
    return rules.keep_rows(df, rules.numeric_mask(df, "price", "!=", 901.0))


@query(
    "rule_match_count",
    f"WITH {fx.LINEITEM} SELECT count(*) FILTER (price > 50000) AS matching, count(*) AS total FROM lineitem_d",
)
def rule_match_count(spark, folder):
    df = fx.lineitem(spark, folder)
    return rules.count_matches(df, rules.rule_mask(df, "price", ">", 50000.0))


@query("range_view", f"WITH {fx.LINEITEM} {PRICED} price BETWEEN 10000 AND 20000")
def range_view(spark, folder):
    return rules.range_view(fx.lineitem(spark, folder).select("l_orderkey", "l_linenumber", "price"), "price", 10000, 20000)


@query("contains_view", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|BLUE) ', 'i')")
def contains_view(spark, folder):
    return rules.contains_view(fx.table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "^(red|BLUE) ")


@query("contains_text_view", "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, 'license', 'i')")
def contains_text_view(spark, folder):
    return rules.contains_view(fx.table(spark, folder, "documents"), "text", "license").select("doc_id", "n_chars")


# -- missing cells, duplicates, outliers, flags -----------------------------------------

MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
MEDIAN = "(SELECT quantile_cont({c}, 0.5) FROM {t})"
PRIORITY_MODE = MODE.format(c="priority", t="orders_d")
FILLS = {
    "mean": ("Mean", ["price"], "round(coalesce(price, (SELECT avg(price) FROM orders_d)), 4)", "priority"),
    "median": ("Median", ["price"], f"round(coalesce(price, {MEDIAN.format(c='price', t='orders_d')}), 4)", "priority"),
    "mode": ("Mode", ["priority"], "round(price, 4)", f"coalesce(priority, {PRIORITY_MODE})"),
    "zero": ("Zero", ["price", "priority"], "round(coalesce(price, 0), 4)", "coalesce(priority, '0')"),
    "unknown": ("Unknown", ["priority"], "round(price, 4)", "coalesce(priority, 'Unknown')"),
    "auto": (
        missing.AUTO, ["price", "priority"],
        f"round(coalesce(price, {MEDIAN.format(c='price', t='orders_d')}), 4)", f"coalesce(priority, {PRIORITY_MODE})",
    ),
}


def _add_fills() -> None:
    def fill(strategy, names):
        def run(spark, folder):
            df = fx.orders(spark, folder).select("o_orderkey", "price", "priority")
            return rounded(missing.fill_missing(df, names, strategy), 4, "price")
        return run

    for name, (strategy, names, price, priority) in FILLS.items():
        sql = f"WITH {fx.ORDERS} SELECT o_orderkey, {price} AS price, {priority} AS priority FROM orders_d"
        query(f"fill_{name}", sql)(fill(strategy, names))


_add_fills()


@query(
    "fill_report",
    f"WITH {fx.ORDERS} SELECT count(*) FILTER (price IS NULL) AS price, count(*) FILTER (priority IS NULL) AS priority FROM orders_d",
)
def fill_report(spark, folder):
    fitted = missing.fit_fill(fx.orders(spark, folder), ["price", "priority"], missing.AUTO)
    return spark.createDataFrame([tuple(fitted.missing_before.values())], "price bigint, priority bigint")


@query(
    "smart_fill",
    f"""WITH {fx.DOCUMENTS}, d AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN n_chars END AS n_chars, src,
  CAST(NULL AS VARCHAR) AS note FROM documents_d)
SELECT doc_id, CAST(coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM d)) AS DOUBLE) AS n_chars,
  coalesce(src, {MODE.format(c="src", t="d")}) AS src, coalesce(note, 'Unknown') AS note FROM d""",
)
def smart_fill(spark, folder):
    df = fx.documents(spark, folder).select(
        "doc_id", F.when(F.col("lang") != "en", F.col("n_chars")).alias("n_chars"), "src",
        F.lit(None).cast("string").alias("note"),
    )
    return missing.smart_fill(df)


IQR = """b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {t}),
f AS (SELECT q1, q3, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM b)"""
LINE_IQR = IQR.format(t="lineitem_d", k="CAST(0.5 AS DOUBLE)")


@query(
    "iqr_bounds",
    f"""WITH {fx.LINEITEM}, {LINE_IQR} SELECT 'price' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr, round(lo, 6) AS lower, round(hi, 6) AS upper FROM f""",
)
def iqr_bounds(spark, folder):
    found = outliers.bounds_table(fx.lineitem(spark, folder), ["price"], 0.5)
    return rounded(found, 6, "q1", "q3", "iqr", "lower", "upper")


@query(
    "clip_iqr",
    f"""WITH {fx.LINEITEM}, {LINE_IQR} SELECT l_orderkey, l_linenumber,
  CASE WHEN price IS NOT NULL THEN round(least(greatest(price, lo), hi), 6) END AS price FROM lineitem_d, f""",
)
def clip_iqr(spark, folder):
    df = fx.lineitem(spark, folder).select("l_orderkey", "l_linenumber", "price")
    return rounded(outliers.clip_outliers(df, "price", 0.5), 6, "price")


def outlier_counts_sql(name: str) -> str:
    return f"""SELECT '{name}' AS "column", count({name}) AS numeric_rows,
  count(*) FILTER ({name} < lo OR {name} > hi) AS will_clip,
  count({name}) - count(*) FILTER ({name} < lo OR {name} > hi) AS will_keep
  FROM lineitem_d, (SELECT q1 - CAST(0.5 AS DOUBLE) * (q3 - q1) AS lo, q3 + CAST(0.5 AS DOUBLE) * (q3 - q1) AS hi
    FROM (SELECT quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.75) AS q3 FROM lineitem_d))"""


@query("outlier_counts", f"WITH {fx.LINEITEM} {outlier_counts_sql('price')} UNION ALL {outlier_counts_sql('l_quantity')}")
def outlier_counts(spark, folder):
    return outliers.outlier_counts(fx.lineitem(spark, folder), ["price", "l_quantity"], 0.5)


@query(
    "outlier_labels",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT event_id, value, CASE WHEN value < lo OR value > hi THEN 'Will clip' ELSE 'Keep' END AS status
FROM events, f ORDER BY md5(CAST(event_id AS VARCHAR) || '-42'), event_id LIMIT 2500""",
)
def outlier_labels(spark, folder):
    return outliers.outlier_labels(fx.table(spark, folder, "events"), "value", ["event_id"])


@query(
    "presence_flag",
    f"""WITH {fx.DOCUMENTS} SELECT doc_id, src, CASE WHEN trim(coalesce(src, '')) <> '' THEN 1 ELSE 0 END AS "Hassrc"
FROM documents_d""",
)
def presence_flag(spark, folder):
    return outliers.presence_flag(fx.documents(spark, folder).select("doc_id", "src"), "src")


# -- charts --------------------------------------------------------------------------

CORRELATED = ("l_quantity", "l_discount", "l_tax", "price", "flat")


def pair_sql(a: str, b: str) -> str:
    value = f"corr({a}, {b})"
    return (
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        f"CASE WHEN '{a}' <> 'flat' AND '{b}' <> 'flat' THEN round({value}, 6) END AS r FROM l"
    )


MATRIX = (
    f"WITH {fx.LINEITEM}, l AS (SELECT *, CAST(1 AS DOUBLE) AS flat FROM lineitem_d), m AS ("
    + " UNION ALL ".join(pair_sql(a, b) for a in CORRELATED for b in CORRELATED)
    + ")"
)


def correlations(spark: SparkSession, folder: str) -> DataFrame:
    df = fx.lineitem(spark, folder).withColumn("flat", F.lit(1.0)).select(*CORRELATED)
    # Rounding hides summation order and turns -0.0 into 0.0.
    return rounded(charts.correlation_matrix(df), 6, "r").withColumn("r", F.col("r") + 0.0)


@query("corr_matrix", f"{MATRIX} SELECT col_a, col_b, r + 0.0 AS r FROM m")
def corr_matrix(spark, folder):
    return correlations(spark, folder)


@query("top_corr_pair", f"{MATRIX} SELECT * FROM m WHERE col_a < col_b AND r IS NOT NULL ORDER BY abs(r) DESC, col_a, col_b LIMIT 1")
def top_corr_pair(spark, folder):
    return charts.top_pair(correlations(spark, folder))


@query(
    "strongest_columns",
    f"{MATRIX} SELECT col_a, round(avg(abs(r)), 9) AS mean_abs_r FROM m GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10",
)
def strongest_columns(spark, folder):
    return rounded(charts.strongest_columns(correlations(spark, folder)), 9, "mean_abs_r")


@query(
    "corr_top3",
    f"""{MATRIX}, best AS (SELECT col_a AS c FROM m GROUP BY 1 ORDER BY avg(abs(r)) DESC NULLS LAST, 1 LIMIT 3)
SELECT col_a, col_b, r + 0.0 AS r FROM m WHERE col_a IN (SELECT c FROM best) AND col_b IN (SELECT c FROM best)""",
)
def corr_top3(spark, folder):
    return charts.heat_map(correlations(spark, folder), 3)


BINS = """s AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
h AS (SELECT *, CAST(least(floor(35 * ({c} - lo) / (hi - lo)) + 1, 35) AS INT) AS bin FROM {t}, s WHERE {c} IS NOT NULL)"""
BIN_COLUMNS = "bin, round(min(lo) + (bin - 1) * ((min(hi) - min(lo)) / 35), 4) AS low, round(min(lo) + bin * ((min(hi) - min(lo)) / 35), 4) AS high, count(*) AS rows"


@query("histogram35", f"WITH {fx.LINEITEM}, {BINS.format(c='price', t='lineitem_d')} SELECT {BIN_COLUMNS} FROM h GROUP BY bin")
def histogram35(spark, folder):
    return rounded(charts.histogram(fx.lineitem(spark, folder), "price"), 4, "low", "high")


@query("histogram_text", f"WITH {fx.ORDERS} SELECT coalesce(priority, 'nan') AS value, count(*) AS rows FROM orders_d GROUP BY 1")
def histogram_text(spark, folder):
    return charts.histogram(fx.orders(spark, folder), "priority")


@query(
    "box_by",
    f"""WITH {fx.LINEITEM}, q AS (SELECT l_linestatus, count(price) AS rows, quantile_cont(price, 0.25) AS q1,
  quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3 FROM lineitem_d GROUP BY 1)
SELECT l_linestatus, rows, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
  round(any_value(q3), 4) AS q3,
  min(price) FILTER (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(price) FILTER (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (price NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM lineitem_d JOIN q USING (l_linestatus) GROUP BY l_linestatus, rows""",
)
def box_by(spark, folder):
    return rounded(charts.box_summary(fx.lineitem(spark, folder), "l_linestatus", "price"), 4, "q1", "median", "q3")


@query("bar_sum", f"WITH {fx.LINEITEM} SELECT l_linestatus, round(sum(price), 2) AS height FROM lineitem_d GROUP BY 1")
def bar_sum(spark, folder):
    return rounded(charts.bar_sum(fx.lineitem(spark, folder), "l_linestatus", "price"), 2, "height")


@query("scatter_points", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scatter_points(spark, folder):
    return charts.scatter_points(fx.table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


@query(
    "scatter_sample",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 6000""",
)
def scatter_sample(spark, folder):
    return charts.scatter_points(fx.table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 6000)


@query(
    "suggested_charts",
    f"""{MATRIX} SELECT 'Target distribution' AS chart, (SELECT count(DISTINCT l_linestatus) FROM lineitem_d) AS points
UNION ALL SELECT 'Top correlated pair: ' || col_a || ' vs ' || col_b, (SELECT count(*) FROM lineitem_d)
  FROM (SELECT * FROM m WHERE col_a < col_b AND r IS NOT NULL AND col_a <> 'flat' AND col_b <> 'flat'
    ORDER BY abs(r) DESC, col_a, col_b LIMIT 1)
UNION ALL SELECT 'Correlation heatmap (top 10 numeric)', 16""",
)
def suggested_charts(spark, folder):
    df = fx.lineitem(spark, folder).select("l_quantity", "l_discount", "l_tax", "price", "l_linestatus")
    keyed = charts.suggest_charts(df, ["l_quantity", "l_discount", "l_tax", "price"], "l_linestatus")
    parts = [t.agg(F.lit(name).alias("chart"), F.count("*").alias("points")) for name, t in keyed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- split, folds, baseline, metrics ------------------------------------------------------

SPLIT = """c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS train FROM c),
q AS (SELECT s, c.n, (c.n * train) // t.n AS fl, (c.n * train) % t.n AS rest, train FROM c, t),
e AS (SELECT *, row_number() OVER (ORDER BY rest DESC, s) <= train - (SELECT sum(fl) FROM q) AS extra FROM q),
p AS (SELECT o.*, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey) <= e.n - fl - extra::INT
  THEN 'Test' ELSE 'Train' END AS split FROM orders o JOIN e ON o_orderstatus = s)"""
EVEN_SPLIT = """p AS (SELECT o.*, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey)
  <= ceil(CAST(0.25 AS DOUBLE) * (SELECT count(*) FROM orders)) THEN 'Test' ELSE 'Train' END AS split FROM orders o)"""


def class_split(spark: SparkSession, folder: str) -> DataFrame:
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return split.train_test_split(df, "o_orderstatus", 0.2, CLASSIFICATION, ["o_orderkey"])


def even_split(spark: SparkSession, folder: str) -> DataFrame:
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return split.train_test_split(df, "o_totalprice", 0.25, REGRESSION, ["o_orderkey"])


@query("strat_split", f"WITH {SPLIT} SELECT o_orderkey, o_orderstatus, split FROM p")
def strat_split(spark, folder):
    return class_split(spark, folder).select("o_orderkey", "o_orderstatus", "split")


@query("plain_split", f"WITH {EVEN_SPLIT} SELECT o_orderkey, split FROM p")
def plain_split(spark, folder):
    return even_split(spark, folder).select("o_orderkey", "split")


@query(
    "split_sizes",
    f"""WITH {SPLIT} SELECT count(*) FILTER (split = 'Train') AS train_rows, count(*) FILTER (split = 'Test') AS test_rows,
  round(100.0 * count(*) FILTER (split = 'Test') / count(*), 1) AS held_out_pct FROM p""",
)
def split_sizes(spark, folder):
    return split.split_sizes(class_split(spark, folder))


@query(
    "split_class_dist",
    f"""WITH {SPLIT}, g AS (SELECT s AS class, x.split FROM c, (VALUES ('Train'), ('Test')) AS x(split))
SELECT class, g.split, count(p.o_orderkey) AS rows FROM g LEFT JOIN p ON p.o_orderstatus = class AND p.split = g.split
GROUP BY 1, 2""",
)
def split_class_dist(spark, folder):
    return split.split_class_counts(class_split(spark, folder), "o_orderstatus")


@query(
    "split_target_dist",
    f"WITH {EVEN_SPLIT}, {BINS.format(c='o_totalprice', t='p')} SELECT split, {BIN_COLUMNS} FROM h GROUP BY split, bin",
)
def split_target_dist(spark, folder):
    return rounded(split.split_target_histogram(even_split(spark, folder), "o_totalprice"), 4, "low", "high")


@query(
    "split_preview",
    f"WITH {EVEN_SPLIT} SELECT o_orderkey, split, FALSE AS stratified FROM p",
)
def split_preview(spark, folder):
    # Each customer-order pair is a class of its own here, so classes cannot be kept apart.
    df = fx.table(spark, folder, "orders").select("o_orderkey", F.concat_ws("-", "o_custkey", "o_orderkey").alias("pair"))
    parts, stratified, _ = split.split_preview(df, "pair", 0.25, CLASSIFICATION, ["o_orderkey"])
    return parts.select("o_orderkey", "split", F.lit(stratified).alias("stratified"))


@query(
    "cv_preview_class",
    """SELECT o_orderstatus, count(*) AS rows, least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM orders
  GROUP BY o_orderstatus))) AS folds FROM orders GROUP BY 1""",
)
def cv_preview_class(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderstatus", "o_totalprice")
    chart, folds = split.cv_preview(df, "o_orderstatus")
    return chart.withColumn("folds", F.lit(folds.first()["folds"]).cast("bigint"))


@query(
    "cv_preview_reg",
    f"WITH {BINS.format(c='o_totalprice', t='orders')} SELECT {BIN_COLUMNS}, CAST(5 AS BIGINT) AS folds FROM h GROUP BY bin",
)
def cv_preview_reg(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderstatus", "o_totalprice")
    chart, folds = split.cv_preview(df, "o_totalprice")
    return rounded(chart, 4, "low", "high").withColumn("folds", F.lit(folds.first()["folds"]).cast("bigint"))


@query("cv_folds", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders")
def cv_folds(spark, folder):
    df = with_row_index(fx.table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])
    return split.assign_folds(df, "_row").select("o_orderkey", "fold")


@query(
    "cv_folds_class",
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS s, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
c AS (SELECT s, min(pos) AS head FROM r GROUP BY 1),
d AS (SELECT s, (row_number() OVER (ORDER BY head, r.pos) - 1) % 5 AS fold FROM r JOIN c USING (s)),
k AS (SELECT s, fold, sum(count(*)) OVER (PARTITION BY s ORDER BY fold) AS upto FROM d GROUP BY 1, 2),
n AS (SELECT o_orderkey, s, row_number() OVER (PARTITION BY s ORDER BY pos) AS nth FROM r)
SELECT o_orderkey, s AS o_orderstatus, CAST(min(fold) AS INT) AS fold FROM n JOIN k USING (s) WHERE nth <= upto GROUP BY 1, 2""",
)
def cv_folds_class(spark, folder):
    df = with_row_index(fx.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    return split.assign_folds(df, "_row", label="o_orderstatus").select("o_orderkey", "o_orderstatus", "fold")


CLASS_BASELINE = f"""WITH {SPLIT}, v AS (SELECT o_orderstatus AS prediction FROM p WHERE split = 'Train'
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), b AS (SELECT o_orderkey, o_orderstatus, prediction FROM p, v WHERE split = 'Test')"""
NUMBER_BASELINE = f"""WITH {EVEN_SPLIT}, v AS (SELECT avg(o_totalprice) AS prediction FROM p WHERE split = 'Train'),
b AS (SELECT o_orderkey, o_totalprice, prediction FROM p, v WHERE split = 'Test')"""
F1_SQL = """, k AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS said,
  count(*) FILTER (y = c AND p = c) AS hit FROM s, (SELECT y AS c FROM s UNION SELECT p FROM s) GROUP BY c)
SELECT round(sum(hit) / sum(support), 6) AS "Accuracy",
  round(sum(support * 2.0 * hit / (support + said)) / sum(support), 6) AS "F1" FROM k"""
R2_SQL = """ SELECT round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS "R2", round(avg((y - p) * (y - p)), 0) AS "MSE"
FROM s, (SELECT avg(y) AS m FROM s)"""


@query("baseline_class", f"{CLASS_BASELINE} SELECT * FROM b")
def baseline_class(spark, folder):
    found = models.baseline_predictions(class_split(spark, folder), "o_orderstatus", CLASSIFICATION)
    return found.select("o_orderkey", "o_orderstatus", "prediction")


@query("baseline_reg", f"{NUMBER_BASELINE} SELECT o_orderkey, o_totalprice, round(prediction, 4) AS prediction FROM b")
def baseline_reg(spark, folder):
    found = models.baseline_predictions(even_split(spark, folder), "o_totalprice", REGRESSION)
    return rounded(found.select("o_orderkey", "o_totalprice", "prediction"), 4, "prediction")


@query("metrics_class", f"WITH s AS (SELECT l_linestatus AS y, CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'R' END AS p FROM lineitem){F1_SQL}")
def metrics_class(spark, folder):
    guess = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("R")
    df = fx.table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("y"), guess.alias("p"))
    return rounded(metrics.classification_metrics(df, "y", "p"), 6, "Accuracy", "F1")


@query("metrics_reg", f"WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem){R2_SQL}")
def metrics_reg(spark, folder):
    df = fx.table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p")
    )
    return rounded(rounded(metrics.regression_metrics(df, "y", "p"), 6, "R2"), 0, "MSE")


# -- features ------------------------------------------------------------------------

SCALED = """(coalesce(acctbal, m.v) - (SELECT avg(coalesce(acctbal, m.v)) FROM customer_d, m)) /
  (SELECT stddev_pop(coalesce(acctbal, m.v)) FROM customer_d, m)"""


@query(
    "standardize",
    f"""WITH {fx.CUSTOMER}, m AS (SELECT quantile_cont(acctbal, 0.5) AS v FROM customer_d)
SELECT c_custkey, round({SCALED}, 6) AS acctbal FROM customer_d, m""",
)
def standardize(spark, folder):
    df = fx.customer(spark, folder).select("c_custkey", "acctbal")
    return rounded(encode.standardised(df, ["acctbal"]), 6, "acctbal")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


@query(
    "one_hot",
    f"WITH {fx.CUSTOMER}, v AS (SELECT c_custkey, coalesce(segment, {MODE.format(c='segment', t='customer_d')}) AS s FROM customer_d) "
    "SELECT c_custkey, " + ", ".join(f"CAST(s = '{s}' AS INT) AS \"segment_{s}\"" for s in SEGMENTS) + " FROM v",
)
def one_hot(spark, folder):
    return encode.one_hot_columns(fx.customer(spark, folder).select("c_custkey", "segment"), "segment")


@query(
    "feature_vector",
    f"""WITH {fx.CUSTOMER}, m AS (SELECT quantile_cont(acctbal, 0.5) AS v FROM customer_d),
v AS (SELECT *, coalesce(segment, {MODE.format(c="segment", t="customer_d")}) AS s FROM customer_d),
f AS (SELECT c_custkey, round({SCALED.replace('coalesce(acctbal, m.v) -', 'coalesce(v.acctbal, m.v) -', 1)}, 6) AS num__acctbal, s FROM v, m)
SELECT c_custkey, num__acctbal, """
    + ", ".join(f"CAST(s = '{s}' AS DOUBLE) AS \"cat__segment_{s}\"" for s in SEGMENTS) + " FROM f",
)
def feature_vector(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = fx.customer(spark, folder).select("c_custkey", "acctbal", "segment")
    prep = encode.TablePrep(["acctbal", "segment"]).fit(df)
    ready = encode.prepared(prep, df)
    names = encode.feature_names(prep, ready)
    flat = ready.select("c_custkey", vector_to_array(F.col(encode.FEATURES)).alias("f"))
    return flat.select("c_custkey", *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(names)])


# -- nearest neighbours -----------------------------------------------------------------

NEAR = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, CAST(embedding[1] AS DOUBLE) AS len FROM embeddings),
n AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label, b.len, list_distance(a.e, b.e) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank FROM v a, v b)"""


def embedding_rows(spark: SparkSession, folder: str, label: str):
    df = fx.table(spark, folder, "embeddings").withColumn("first", F.col("embedding")[0])
    vector = F.col("embedding").cast("array<double>").alias("_vec")
    train = df.select(F.col("vec_id").alias("_id"), vector, F.col(label).cast("double").alias("_label"))
    return df.select(F.col("vec_id").alias("_query"), vector), train


@query(
    "knn_embeddings",
    f"WITH {NEAR} SELECT query, CAST(rank AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM n WHERE rank <= 5",
)
def knn_embeddings(spark, folder):
    df = fx.table(spark, folder, "embeddings")
    return rounded(neighbors.nearest_neighbours(df, df, 5, "embedding", "vec_id", "vec_id"), 6, "distance")


@query(
    "knn_vote",
    f"""WITH {NEAR}, w AS (SELECT query, label, count(*) AS w FROM n WHERE rank <= 7 GROUP BY 1, 2)
SELECT query, CAST(label AS INT) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w DESC, label) AS r FROM w)
WHERE r = 1""",
)
def knn_vote(spark, folder):
    asked, train = embedding_rows(spark, folder, "label")
    votes = neighbors.vote(neighbors.nearest_rows(asked, train, 7))
    return votes.select(F.col("_query").alias("query"), F.col("prediction").cast("int"))


@query(
    "knn_weighted_mean",
    f"""WITH {NEAR}, z AS (SELECT *, min(distance) OVER (PARTITION BY query) AS least FROM n WHERE rank <= 7),
w AS (SELECT query, len, CASE WHEN least = 0 THEN (distance = 0)::INT ELSE 1 / distance END AS w FROM z)
SELECT query, round(sum(len * w) / sum(w), 6) AS prediction FROM w GROUP BY 1""",
)
def knn_weighted_mean(spark, folder):
    asked, train = embedding_rows(spark, folder, "first")
    votes = neighbors.vote(neighbors.nearest_rows(asked, train, 7), "distance", classes=False)
    return rounded(votes.select(F.col("_query").alias("query"), "prediction"), 6, "prediction")


# -- models --------------------------------------------------------------------------


def line_features(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a price, to be predicted from quantity, discount, tax and return flag."""
    df = fx.lineitem(spark, folder).where(F.col("price").isNotNull())
    return df.select("l_orderkey", "l_linenumber", "price", "l_quantity", "l_discount", "l_tax", "l_returnflag")


LINE_KEY = ["l_orderkey", "l_linenumber"]


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer's facts; the status is to be predicted."""
    left = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    right = fx.customer(spark, folder).select("c_custkey", "acctbal", "segment")
    return left.join(right, left.o_custkey == right.c_custkey).drop("o_custkey", "c_custkey")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    left = fx.table(spark, folder, "labels").select("doc_id", "quality")
    return left.join(fx.documents(spark, folder).select("doc_id", "n_chars", "lang", "src"), "doc_id")


def scores(spark: SparkSession, model: models.TrainedModel) -> DataFrame:
    found = [("model", k, float(v)) for k, v in model.metrics.items()]
    found += [("baseline", k, float(v)) for k, v in model.baseline.items() if k != "strategy"]
    return spark.createDataFrame(found, "part string, metric string, value double")


LINE_FIT = f"""WITH {EVEN_SPLIT}, x AS (SELECT *, o_custkey AS x, o_totalprice AS y FROM p),
t AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy, count(*) AS n FROM x WHERE split = 'Train')
SELECT o_orderkey, round(my + (x - mx) / sx * (cxy / sx * n / (n + {{penalty}})), 0) AS prediction FROM x, t"""


def _single_feature(spark, folder, algo):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = models.train_with_baseline(df, "o_totalprice", algo, {}, REGRESSION, 0.25, ["o_orderkey"])
    return rounded(model.predict(df).select("o_orderkey", "prediction"), 0, "prediction")


@query("train_linear_fit", LINE_FIT.format(penalty=0))
def train_linear_fit(spark, folder):
    return _single_feature(spark, folder, "Linear/Logistic Regression")


@query("train_ridge_fit", LINE_FIT.format(penalty=1))
def train_ridge_fit(spark, folder):
    return _single_feature(spark, folder, "Ridge")


@query(
    "train_baseline_scores",
    f"""{CLASS_BASELINE}, s AS (SELECT o_orderstatus AS y, prediction AS p FROM b){F1_SQL}""",
)
def train_baseline_scores(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    model = models.train_with_baseline(df, "o_orderstatus", "Decision Tree", {"max_depth": 4}, None, 0.2, ["o_orderkey"])
    found = scores(spark, model).where("part = 'baseline'").groupBy().pivot("metric", ["Accuracy", "F1"]).agg(F.first("value"))
    return rounded(found, 6, "Accuracy", "F1")


@query("train_logistic")
def train_logistic(spark, folder):
    df = labelled_documents(spark, folder)
    return scores(spark, models.train_with_baseline(df, "quality", "Linear/Logistic Regression", {"C": 1.0}, key=["doc_id"]))


@query("train_random_forest")
def train_random_forest(spark, folder):
    params = {"n_estimators": 120, "max_depth": 12, "min_samples_leaf": 2}
    return scores(spark, models.train_with_baseline(order_features(spark, folder), "o_orderstatus", "Random Forest", params, key=["o_orderkey"]))


@query("train_decision_tree")
def train_decision_tree(spark, folder):
    df = line_features(spark, folder)
    return scores(spark, models.train_with_baseline(df, "price", "Decision Tree", {"max_depth": 10}, key=LINE_KEY))


@query("train_knn")
def train_knn(spark, folder):
    params = {"n_neighbors": 5, "weights": "distance"}
    return scores(spark, models.train_with_baseline(labelled_documents(spark, folder), "quality", "KNN", params, key=["doc_id"]))


@query("compare_models_reg")
def compare_models_reg(spark, folder):
    df = fx.table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size", "p_type", "p_brand")
    return models.compare_models(df, "p_retailprice", order_by=["p_partkey"])


@query("compare_models_class")
def compare_models_class(spark, folder):
    df = labelled_documents(spark, folder)
    return models.compare_models(df, "quality", order_by=["doc_id"])


@query("feature_importance")
def feature_importance(spark, folder):
    model = models.train_with_baseline(line_features(spark, folder), "price", "Random Forest", {"n_estimators": 10, "max_depth": 5}, key=LINE_KEY)
    return spark.createDataFrame(model.importance()[:20], "feature string, importance double")


@query("score_batch", LINE_FIT.format(penalty=0))
def score_batch(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = models.train_with_baseline(df, "o_totalprice", "Linear/Logistic Regression", {}, REGRESSION, 0.25, ["o_orderkey"])
    rows = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    found = models.score_batch(model, rows, ["o_custkey"], df)
    return rounded(found.select("o_orderkey", "prediction"), 0, "prediction")


@query(
    "score_batch_defaults",
    LINE_FIT.format(penalty=0).replace("(x - mx)", "((SELECT avg(x) FROM x) - mx)"),
)
def score_batch_defaults(spark, folder):
    """No feature is given, so each row takes the source's mean."""
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = models.train_with_baseline(df, "o_totalprice", "Linear/Logistic Regression", {}, REGRESSION, 0.25, ["o_orderkey"])
    found = models.score_batch(model, df.select("o_orderkey"), [], df)
    return rounded(found.select("o_orderkey", "prediction"), 0, "prediction")


@query("model_round_trip", "SELECT CAST(0 AS BIGINT) AS changed, count(*) AS rows FROM part")
def model_round_trip(spark, folder):
    df = fx.table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size", "p_type")
    model = models.train_with_baseline(df, "p_retailprice", "Linear Regression", key=["p_partkey"])
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model_store.save_model(spark, model, path)
    before = model.predict(df).select("p_partkey", F.col("prediction").alias("before"))
    after = model_store.load_model(spark, path).predict(df).select("p_partkey", F.col("prediction").alias("after"))
    return before.join(after, "p_partkey").agg(
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"), F.count("*").alias("rows")
    )


# -- sources, workspace, report, stream ------------------------------------------------------


@query("read_csv", f"WITH {fx.ORDERS} SELECT * FROM orders_d")
def read_csv(spark, folder):
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}.csv"
    fx.orders(spark, folder).write.option("header", True).option("nullValue", "NA").csv(path)
    return text_tables.read_csv(spark, path)


@query("read_csv_text_cells", "SELECT doc_id, text FROM documents")
def read_csv_text_cells(spark, folder):
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}.csv"
    df = fx.table(spark, folder, "documents").select("doc_id", "text")
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return text_tables.read_csv(spark, path)


@query("file_signatures")
def file_signatures(spark, folder):
    return ingest.file_signatures(spark, f"{folder}/*.parquet").select("name", "size", "digest")


@query("snapshot_round_trip", f"WITH {fx.ORDERS} SELECT * FROM orders_d WHERE price IS NOT NULL")
def snapshot_round_trip(spark, folder):
    path = f"{shared_folder(spark)}/workspace-{uuid.uuid4().hex}"
    first = Workspace(spark, path).load(fx.orders(spark, folder), "orders")
    first.apply(lambda df: row_ops.drop_missing_rows(df, "price"), "Drop rows missing: price")
    first.save()
    second = Workspace(spark, path)
    second.restore()
    return second.current


CLEANED = f"""WITH {fx.ORDERS}, o AS (SELECT o_orderkey, coalesce(price, {MEDIAN.format(c='price', t='orders_d')}) AS price,
  CAST(price IS NOT NULL AS INT) AS "Hasprice" FROM orders_d),
{IQR.format(t='o', k='CAST(0.5 AS DOUBLE)')}
SELECT o_orderkey, round(least(greatest(price, lo), hi), 6) AS price, "Hasprice" FROM o, f"""


@query("workspace_steps", CLEANED)
def workspace_steps(spark, folder):
    """The flagship: flag, fill and clip as workspace steps, with a step undone in between."""
    work = Workspace(spark).load(fx.orders(spark, folder).select("o_orderkey", "price"), "orders")
    work.apply(lambda df: outliers.presence_flag(df, "price"), "Presence flag: price")
    work.apply(lambda df: row_ops.drop_missing_rows(df, "price"), "Drop rows missing: price")
    work.undo()
    work.apply(lambda df: missing.fill_missing(df, "price"), "Fill missing: price")
    work.apply(lambda df: outliers.clip_outliers(df, "price", 0.5), "Clip outliers: price")
    return rounded(work.current, 6, "price")


@query(
    "report_parts",
    f"""WITH {fx.ORDERS}, s AS ({STATS.format(cols=5, missing=ORDERS_MISSING, t='orders_d')})
SELECT 'rows' AS item, rows AS value FROM s UNION ALL SELECT 'cols', cols FROM s UNION ALL SELECT 'missing', missing FROM s
UNION ALL SELECT 'duplicates', duplicates FROM s
UNION ALL SELECT "column", missing FROM (SELECT * FROM ({MISSING_ROWS}) ORDER BY missing DESC, "column" LIMIT 15)""",
)
def report_parts(spark, folder):
    df = fx.orders(spark, folder)
    names = ["rows", "cols", "missing", "duplicates"]
    facts = profile.dataset_stats(df).unpivot([], names, "item", "value")
    return facts.unionByName(profile.missing_by_column(df).toDF("item", "value"))


@query("stream_clean", CLEANED)
def stream_clean(spark, folder):
    """Values fitted on the batch, applied to the same rows arriving as a stream."""
    batch = fx.orders(spark, folder).select("o_orderkey", "price")
    fitted = FittedCleaning.fit(batch, fill=["price"], clip=["price"], factor=0.5, flags=["price"])
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = fx.table(spark, folder, "orders").schema
    source = spark.readStream.schema(schema).parquet(f"{folder}/orders*.parquet")
    stream = source.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )
    fitted.start(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"), 6, "price")
