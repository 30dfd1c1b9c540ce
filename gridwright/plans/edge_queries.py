"""More queries: whole tables through the parts that small tables never reach, and the workspace's own steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.constants import CLASSIFICATION, REGRESSION
from gridwright.functions.quantiles import exact_quantiles, grouped_quantiles
from gridwright.functions.ranks import with_row_index
from gridwright.functions.storage import shared_folder
from gridwright.operators import charts, missing, models, neighbors, profile, rules, split
from gridwright.operators import rows as row_ops
from gridwright.plans import fixtures as fx
from gridwright.plans.queries import (
    CORRELATED,
    EVEN_SPLIT,
    MATRIX,
    NEAR,
    SPLIT,
    describe_sql,
    describe_text_sql,
    embedding_rows,
    query,
    rounded,
)
from gridwright.plans.report import build_report
from gridwright.plans.workspace import Workspace
from gridwright.sources import ingest, text_tables

# -- rules on whole numbers, row lists ----------------------------------------------

KEYS = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
KEY_RULES = {
    "gt": (">", 1000.5, 0, "l_orderkey > 1000.5"), "ge": (">=", 1000.5, 0, "l_orderkey >= 1000.5"),
    "lt": ("<", 700, 0, "l_orderkey < 700"), "le": ("<=", 700.0, 0, "l_orderkey <= 700"),
    "between": ("between", 900.25, 100, "l_orderkey BETWEEN 100 AND 900.25"), "eq": ("==", 7, 0, "l_orderkey = 7"),
    "eq_part": ("==", 7.5, 0, "l_orderkey = 7.5"), "ne": ("!=", 7, 0, "l_orderkey <> 7"),
    "gt_all": (">", -1e30, 0, "TRUE"), "lt_none": ("<", -1e30, 0, "FALSE"),
}
BEYOND = 9007199254740992  # the first whole number whose successor a double does not hold


def key_rule(rule: str, a, b):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = fx.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
        return rules.keep_rows(df, rules.numeric_mask(df, "l_orderkey", rule, a, b))

    return run


def large_key_rule(rule: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = fx.table(spark, folder, "orders").select((F.col("o_orderkey") + F.lit(BEYOND)).alias("k"))
        return rules.keep_rows(df, rules.numeric_mask(df, "k", rule, BEYOND + 3))

    return run


for _name, (_rule, _a, _b, _mask) in KEY_RULES.items():
    query(f"rule_key_{_name}", KEYS + f"({_mask})")(key_rule(_rule, _a, _b))
for _name, (_rule, _sign) in {"eq": ("==", "="), "ne": ("!=", "<>"), "gt": (">", ">"), "le": ("<=", "<=")}.items():
    query(
        f"rule_large_key_{_name}",
        f"SELECT o_orderkey + {BEYOND} AS k FROM orders WHERE o_orderkey + {BEYOND} {_sign} {BEYOND + 3}",
    )(large_key_rule(_rule))


@query(
    "drop_row_index_long",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
WHERE r % 3 <> 1 AND r % 10 NOT IN (4, 5, 6)""",
)
def drop_row_index_long(spark, folder):
    """Every third row, and three rows of each ten as ranges: a list that grows with the table, so it is a table itself."""
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    rows = df.count()
    single = spark.range(1, rows, 3).selectExpr("id AS low", "id AS high")
    ranges = spark.range(4, rows, 10).selectExpr("id AS low", f"least(id + 2, {rows - 1}) AS high")
    return row_ops.drop_rows_listed(df, single.unionAll(ranges), ["o_orderkey"])


# -- the far side of each size bound --------------------------------------------------

WIDE = {"l_quantity": 8, "price": 4}


@query(
    "quantiles_narrowed",
    f"WITH {fx.LINEITEM} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.95), 6) AS p95 FROM lineitem_d""" for c in WIDE
    ),
)
def quantiles_narrowed(spark, folder):
    """Ranks found by narrowing brackets, as for columns that no buffer holds."""
    found = exact_quantiles(fx.lineitem(spark, folder), list(WIDE), [0.1, 0.5, 0.95], buffer_values=20)
    table = spark.createDataFrame([(c, *q) for c, q in found.items()], "column string, p10 double, p50 double, p95 double")
    return rounded(table, 6, "p10", "p50", "p95")


@query(
    "quantiles_by_running_counts",
    f"""WITH {fx.LINEITEM} SELECT l_returnflag, count(l_quantity) AS n, quantile_cont(l_quantity, 0.25) AS q0,
  quantile_cont(l_quantity, 0.9) AS q1 FROM lineitem_d GROUP BY 1""",
)
def quantiles_by_running_counts(spark, folder):
    """Three groups hold all rows; each spans range partitions."""
    return grouped_quantiles(fx.lineitem(spark, folder), "l_returnflag", "l_quantity", [0.25, 0.9], buffer_values=5)


@query("corr_matrix_by_batches", f"{MATRIX} SELECT col_a, col_b, r + 0.0 AS r FROM m")
def corr_matrix_by_batches(spark, folder):
    df = fx.lineitem(spark, folder).withColumn("flat", F.lit(1.0)).select(*CORRELATED)
    return charts.correlation_matrix(df, jvm_columns=1).withColumn("r", F.round("r", 6) + 0.0)


@query("strat_split_in_buckets", f"WITH {SPLIT} SELECT o_orderkey, split FROM p")
def strat_split_in_buckets(spark, folder):
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return split.train_test_split(df, "o_orderstatus", 0.2, CLASSIFICATION, ["o_orderkey"], group_rows=100).select("o_orderkey", "split")


@query(
    "knn_in_blocks",
    f"WITH {NEAR} SELECT query, CAST(rank AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM n WHERE rank <= 5",
)
def knn_in_blocks(spark, folder):
    df = fx.table(spark, folder, "embeddings")
    found = neighbors.nearest_neighbours(
        df, df, 5, "embedding", "vec_id", "vec_id", piece_rows=2, query_piece=100, pivots=8, rings=3
    )
    return rounded(found, 6, "distance")


@query(
    "knn_vote_in_blocks",
    f"""WITH {NEAR}, w AS (SELECT query, label, count(*) AS w FROM n WHERE rank <= 7 GROUP BY 1, 2)
SELECT query, CAST(label AS INT) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w DESC, label) AS r FROM w)
WHERE r = 1""",
)
def knn_vote_in_blocks(spark, folder):
    asked, train = embedding_rows(spark, folder, "label")
    votes = neighbors.vote(neighbors.nearest_rows(asked, train, 7, piece_rows=2, query_piece=100, pivots=8, rings=3))
    return votes.select(F.col("_query").alias("query"), F.col("prediction").cast("int"))


#: Columns of the widened table.
MANY = 200


@query(
    "corr_matrix_wide",
    f"""WITH t AS (SELECT [CASE WHEN (p_partkey + i) % 11 > 0 OR i % 3 > 0 THEN (p_partkey * (i + 3) + p_size * i) % (17 + i) END::DOUBLE
  FOR i IN range({MANY})] AS x FROM part)
SELECT 'c' || i AS col_a, 'c' || j AS col_b, round(corr(x[i + 1], x[j + 1]), 6) + 0.0 AS r
FROM t, range({MANY}) AS a(i), range({MANY}) AS b(j) WHERE i < j GROUP BY i, j""",
)
def corr_matrix_wide(spark, folder):
    """All pairs of 200 columns, a third of them with missing cells."""
    made = [
        f"CAST(CASE WHEN (p_partkey + {i}) % 11 > 0 OR {i % 3} > 0 THEN (p_partkey * {i + 3} + p_size * {i}) % {17 + i} END AS double) AS c{i}"
        for i in range(MANY)
    ]
    matrix = charts.correlation_matrix(fx.table(spark, folder, "part").selectExpr(*made))
    upper = F.substring("col_a", 2, 9).cast("int") < F.substring("col_b", 2, 9).cast("int")
    return matrix.where(upper).withColumn("r", F.round("r", 6) + 0.0)


CLASSES_OF = {"spark": "o_orderkey DIV 5 * 2 + IF(o_orderkey % 5 < 2, 0, 1)", "sql": "o_orderkey // 5 * 2 + CASE WHEN o_orderkey % 5 < 2 THEN 0 ELSE 1 END"}
#: Two and three rows a class; more classes are to get a row more than there are such rows.
PAIRS = f"o AS (SELECT o_orderkey, {CLASSES_OF['sql']} AS class FROM orders)"


def paired_orders(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "orders").selectExpr("o_orderkey", f"{CLASSES_OF['spark']} AS class")


@query(
    "strat_split_many_classes",
    f"""WITH {PAIRS}, c AS (SELECT class AS s, count(*) AS n FROM o GROUP BY 1),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - ceil(CAST(0.45 AS DOUBLE) * sum(n)) AS BIGINT) AS train FROM c),
q AS (SELECT s, c.n, (c.n * train) // t.n AS fl, (c.n * train) % t.n AS rest, train FROM c, t),
e AS (SELECT *, row_number() OVER (ORDER BY rest DESC, s) <= train - (SELECT sum(fl) FROM q) AS extra FROM q)
SELECT o_orderkey, class, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey)
  <= e.n - fl - extra::INT THEN 'Test' ELSE 'Train' END AS split FROM o JOIN e ON class = s""",
)
def strat_split_many_classes(spark, folder):
    """As many classes as there are pairs and triples of rows: quotas and cut points are found without one task for all."""
    return split.train_test_split(paired_orders(spark, folder), "class", 0.45, CLASSIFICATION, ["o_orderkey"], group_rows=100)


@query(
    "cv_folds_many_classes",
    f"""WITH {PAIRS}, r AS (SELECT o_orderkey, class AS s, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM o),
c AS (SELECT s, min(pos) AS head FROM r GROUP BY 1),
d AS (SELECT s, (row_number() OVER (ORDER BY head, r.pos) - 1) % 3 AS fold FROM r JOIN c USING (s)),
k AS (SELECT s, fold, sum(count(*)) OVER (PARTITION BY s ORDER BY fold) AS upto FROM d GROUP BY 1, 2),
n AS (SELECT o_orderkey, s, row_number() OVER (PARTITION BY s ORDER BY pos) AS nth FROM r)
SELECT o_orderkey, s AS class, CAST(min(fold) AS INT) AS fold FROM n JOIN k USING (s) WHERE nth <= upto GROUP BY 1, 2""",
)
def cv_folds_many_classes(spark, folder):
    df = with_row_index(paired_orders(spark, folder), ["o_orderkey"])
    return split.assign_folds(df, "_row", 3, "class", group_rows=100).select("o_orderkey", "class", "fold")


@query(
    "ordered_steps",
    """WITH o AS (SELECT list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS p,
  bool_and(o_totalprice + 1 = o_totalprice) AS same FROM orders)
SELECT unnest(['by key', 'by price', 'by price again', 'back', 'one more']) AS step, unnest([k <> k, k <> p, p <> p, p <> k, NOT same]) AS changed FROM o""",
)
def ordered_steps(spark, folder):
    """Which steps count as changes: sorting does where rows change places."""
    work = Workspace(spark).load(fx.table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "Orders")
    by_price = lambda df: df.orderBy(F.desc("o_totalprice"), "o_orderkey")
    steps = {
        "by key": lambda df: df.orderBy("o_orderkey"), "by price": by_price, "by price again": by_price,
        "back": lambda df: df.orderBy("o_orderkey"), "one more": lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") + 1),
    }
    return spark.createDataFrame([(name, work.apply(step, name)) for name, step in steps.items()], "step string, changed boolean")


# -- a whole mixed table, a tree with one cut -----------------------------------------

MOMENT = """SELECT 'o_orderdate' AS "column", count(*) AS count, NULL::BIGINT AS "unique", NULL AS top, NULL::BIGINT AS freq,
  round(avg(s), 2) AS mean, round(stddev_samp(s), 2) AS std, round(min(s), 2) AS min, round(quantile_cont(s, 0.25), 2) AS p25,
  round(quantile_cont(s, 0.5), 2) AS p50, round(quantile_cont(s, 0.75), 2) AS p75, round(max(s), 2) AS max
  FROM (SELECT CAST(epoch(o_orderdate) AS DOUBLE) AS s FROM orders)"""


def number_sql(name: str, table: str, digits: int = 2) -> str:
    found = describe_sql(name, digits).replace("lineitem_d", table)
    return f"""SELECT "column", count, NULL::BIGINT AS "unique", NULL AS top, NULL::BIGINT AS freq, mean, std, min, p25, p50, p75, max
  FROM ({found})"""


def text_sql(name: str) -> str:
    empty = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return f"SELECT *, {empty} FROM ({describe_text_sql(name)})"


@query(
    "describe_mixed",
    f"WITH {fx.ORDERS} " + " UNION ALL ".join(
        [number_sql(c, "orders_d") for c in ("o_orderkey", "o_custkey", "price")] + [text_sql(c) for c in ("o_orderstatus", "priority")] + [MOMENT]
    ),
)
def describe_mixed(spark, folder):
    dates = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    found = profile.describe(fx.orders(spark, folder).join(dates, "o_orderkey"))
    return rounded(found, 2, "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "train_tree_one_cut",
    f"""WITH {EVEN_SPLIT}, t AS (SELECT * FROM p WHERE split = 'Train'),
g AS (SELECT o_orderpriority AS c, count(*) AS n, sum(o_totalprice) AS s FROM t GROUP BY 1),
a AS (SELECT sum(n) AS rows, sum(s) AS total FROM g),
best AS (SELECT c, s / n AS inside, (total - s) / (rows - n) AS outside FROM g, a
  ORDER BY s * s / n + (total - s) * (total - s) / (rows - n) DESC LIMIT 1)
SELECT o_orderkey, round(CASE WHEN o_orderpriority = best.c THEN inside ELSE outside END, 4) AS prediction FROM p, best""",
)
def train_tree_one_cut(spark, folder):
    """The best single cut of a regression tree over one text column."""
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    model = models.train_with_baseline(df, "o_totalprice", "Decision Tree", {"max_depth": 1}, REGRESSION, 0.25, ["o_orderkey"])
    return rounded(model.predict(df).select("o_orderkey", "prediction"), 4, "prediction")


MIN_SPLIT_SQL = f"""WITH RECURSIVE {EVEN_SPLIT}, t AS (SELECT * FROM p WHERE split = 'Train'),
g AS (SELECT o_orderpriority AS c, count(*) AS n, sum(o_totalprice) AS s FROM t GROUP BY 1),
cuts AS (SELECT 0 AS step, (SELECT list(c) FROM g) AS open
  UNION ALL
  SELECT step + 1, list_filter(open, lambda x: x <> best) FROM (
    SELECT step, open, arg_max(g.c, g.s * g.s / g.n + (total - g.s) * (total - g.s) / (rows - g.n)) AS best
    FROM (SELECT step, open, sum(g.n) AS rows, sum(g.s) AS total FROM cuts JOIN g ON list_contains(open, g.c) GROUP BY ALL) AS node
    JOIN g ON list_contains(open, g.c)
    WHERE len(open) > 1 AND rows >= (SELECT floor(sum(n) / 2) FROM g) GROUP BY step, open)),
rest AS (SELECT arg_max(open, step) AS open FROM cuts),
leaves AS (SELECT g.c, CASE WHEN list_contains(open, g.c) THEN (SELECT sum(s) / sum(n) FROM g, rest WHERE list_contains(rest.open, g.c))
  ELSE s / n END AS prediction FROM g, rest)
SELECT o_orderkey, round(prediction, 4) AS prediction FROM p JOIN leaves ON o_orderpriority = leaves.c"""


@query("train_tree_min_split", MIN_SPLIT_SQL)
def train_tree_min_split(spark, folder):
    """A regression tree over one text column; nodes of fewer than half the training rows are leaves."""
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = df.count()
    params = {"max_depth": 10, "min_samples_split": (rows - -(-rows // 4)) // 2}
    model = models.train_with_baseline(df, "o_totalprice", "Decision Tree", params, REGRESSION, 0.25, ["o_orderkey"])
    return rounded(model.predict(df).select("o_orderkey", "prediction"), 4, "prediction")


# -- sources ------------------------------------------------------------------------


def written_csv(df: DataFrame, **options) -> str:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}.csv"
    df.write.options(header=True, nullValue="NA", escape='"', **options).csv(path)
    return path


@query("read_csv_headers", f"WITH {fx.ORDERS} SELECT * FROM orders_d")
def read_csv_headers(spark, folder):
    """Files whose headers name the same columns in another order."""
    df = fx.orders(spark, folder)
    even = F.col("o_orderkey") % 2 == 0
    paths = [written_csv(df.where(even)), written_csv(df.where(~even).select(*reversed(df.columns)))]
    return text_tables.read_csv(spark, paths).select(*df.columns)


@query("read_csv_latin", "SELECT doc_id, text FROM documents")
def read_csv_latin(spark, folder):
    df = fx.table(spark, folder, "documents").select("doc_id", "text")
    path = written_csv(df, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return text_tables.read_csv(spark, path)


@query("load_path", f"WITH {fx.ORDERS} SELECT * FROM orders_d WHERE price IS NOT NULL")
def load_path(spark, folder):
    work = Workspace(spark).load_path(written_csv(fx.orders(spark, folder)))
    work.apply(lambda df: row_ops.drop_missing_rows(df, "price"), "Drop rows missing: price")
    return work.current


@query(
    "new_pages",
    """SELECT url AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS digest FROM pages
WHERE (url, sha256(html)) NOT IN (SELECT url, sha256(html) FROM pages WHERE page_id % 2 = 0)""",
)
def new_pages(spark, folder):
    """Signatures of pages that a manifest of half the pages does not hold."""
    pages = fx.table(spark, folder, "pages")
    marks = pages.select(
        "page_id", F.col("url").alias("name"), F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest")
    )
    manifest = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    ingest.remember_files(marks.where("page_id % 2 = 0"), manifest)
    return ingest.new_files(marks.drop("page_id"), spark.read.parquet(manifest)).select("name", "size", "digest")


# -- workspace and report ---------------------------------------------------------------


def priced(df: DataFrame) -> DataFrame:
    return row_ops.drop_missing_rows(df, "price")


@query("workspace_reset", f"WITH {fx.ORDERS} SELECT * FROM orders_d")
def workspace_reset(spark, folder):
    work = Workspace(spark).load(fx.orders(spark, folder), "orders")
    work.apply(priced, "Drop rows missing: price")
    work.apply(lambda df: missing.fill_missing(df, "priority"), "Fill missing: priority")
    work.reset()
    return work.current


@query("workspace_recover", f"WITH {fx.ORDERS} SELECT * FROM orders_d WHERE price IS NOT NULL")
def workspace_recover(spark, folder):
    """The current table has lost its rows; the newest usable one comes back."""
    work = Workspace(spark).load(fx.orders(spark, folder), "orders")
    work.apply(priced, "Drop rows missing: price")
    work.apply(lambda df: missing.fill_missing(df, "priority"), "Fill missing: priority")
    work.current = work.current.where("false")
    assert work.check() is False
    return work.current


@query("workspace_pending", f"WITH {fx.ORDERS} SELECT * FROM orders_d WHERE price IS NOT NULL")
def workspace_pending(spark, folder):
    """A result set aside and then taken over, after one that was thrown away."""
    work = Workspace(spark).load(fx.orders(spark, folder), "orders")
    work.stage(lambda df: df.where("price > 1000"))
    work.discard()
    work.stage(priced)
    work.commit()
    return work.current


@query("workspace_log", f"""WITH {fx.ORDERS} SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'orders'), (1, 'Drop rows missing: price'), (2, 'Undo')) AS s(place, step)
WHERE (SELECT count(*) FROM orders_d WHERE price IS NULL) > 0""")
def workspace_log(spark, folder):
    work = Workspace(spark).load(fx.orders(spark, folder), "orders")
    work.apply(priced, "Drop rows missing: price")
    work.apply(priced, "Drop rows missing: price once more")  # changes nothing, so it is not logged
    work.undo()
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("step", T.StringType())])
    return spark.createDataFrame(list(enumerate(work.steps)), schema)



@query(
    "report_numbers",
    f"""WITH {fx.ORDERS}, w AS (SELECT * FROM orders_d WHERE price IS NOT NULL)
SELECT 'Raw rows' AS item, count(*) AS value FROM orders_d UNION ALL SELECT 'Current rows', count(*) FROM w
UNION ALL SELECT 'Raw cols', 5 UNION ALL SELECT 'Current cols', 5
UNION ALL SELECT 'Raw missing', sum((price IS NULL)::BIGINT + (priority IS NULL)::BIGINT)::BIGINT FROM orders_d
UNION ALL SELECT 'Current missing', sum((priority IS NULL)::BIGINT)::BIGINT FROM w
UNION ALL SELECT 'Raw duplicates', 0 UNION ALL SELECT 'Current duplicates', 0""",
)
def report_numbers(spark, folder):
    """The dataset lines of the markdown report, read back from its text."""
    df = fx.orders(spark, folder)
    report = build_report(priced(df), df, ["Drop rows missing: price"], "price", order_by=["o_orderkey"])
    lines = [x[2:].rpartition(": ") for x in report.split("\n") if x.startswith(("- Raw ", "- Current "))]
    return spark.createDataFrame([(item, int(value)) for item, _, value in lines], "item string, value long")
