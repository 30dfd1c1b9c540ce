import math

import pytest
from pyspark.sql import functions as F

from gridwright.operators import columns, missing, outliers, rows, rules
from gridwright.operators.checks import checked, require_rows


def values(df, name, key="id"):
    return {r[key]: r[name] for r in df.select(key, f"`{name}`").collect()}


# -- fills


def test_mean_and_median_skip_nan_and_null(people):
    assert values(missing.fill_missing(people, "age", "Mean"), "age")[2] == pytest.approx(267.5)
    filled = values(missing.fill_missing(people, "age", "Median"), "age")
    assert filled[2] == filled[3] == 30.0 and filled[0] == 10.0


def test_mode_takes_the_smallest_on_a_tie(people):
    assert values(missing.fill_missing(people, "sex", "Mode"), "sex")[4] == "x"
    assert values(missing.fill_missing(people, "member", "Mode"), "member")[1] is True


def test_median_of_whole_numbers_becomes_double(people):
    out = missing.fill_missing(people, "n.o", "Median")
    assert dict(out.dtypes)["n.o"] == "double" and values(out, "n.o")[2] == 4.0


def test_complete_column_keeps_its_type(people):
    assert dict(missing.fill_missing(people, "id", "Median").dtypes)["id"] == "bigint"


def test_zero_and_unknown(people):
    out = missing.fill_missing(people, ["age", "sex", "member"], "Zero")
    assert (values(out, "age")[2], values(out, "sex")[4], values(out, "member")[1]) == (0.0, "0", False)
    assert values(missing.fill_missing(people, "sex", "Unknown"), "sex")[4] == "Unknown"


def test_all_missing_stays_missing(people):
    assert set(values(missing.fill_missing(people, "none"), "none").values()) == {None}


def test_smart_fill_leaves_no_text_missing(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "a"), (3, None, None)], "n int, t string, u string")
    assert [tuple(r) for r in missing.smart_fill(df).orderBy("n").collect()] == [
        (1.0, "Unknown", "a"), (2.0, "Unknown", "a"), (3.0, "Unknown", "a"),
    ]


@pytest.mark.parametrize(
    "names,strategy", [("sex", "Mean"), ("sex", "Median"), ("age", "Unknown"), ("age", "Guess"), ("gone", "Mean")]
)
def test_fill_errors(people, names, strategy):
    with pytest.raises(ValueError):
        missing.fill_missing(people, names, strategy)


def test_fill_counts_cells(people):
    assert missing.fit_fill(people, ["age", "sex"], missing.AUTO).cells == 3


# -- duplicates and rows


def test_duplicates_treat_missing_as_equal(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (1, nan), (2, None), (3, 1.0)], "row long, v double")
    assert rows.drop_duplicates(df.select("v")).count() == 2
    assert sorted(r["row"] for r in rows.drop_duplicates(df, row="row").collect()) == [0, 1]


def test_row_spec():
    assert rows.parse_row_spec("0, 5, 12-8,, 9-20 ", 30) == [(0, 0), (5, 5), (8, 20)]
    assert rows.parse_row_spec("  ", 30) == []
    for bad in ("-3", "a", "1-", "30", "5-40"):
        with pytest.raises(ValueError):
            rows.parse_row_spec(bad, 30)


def test_drop_positions_follow_the_order(people):
    left = rows.drop_row_positions(people, "1-2, 5", ["id"])
    assert sorted(r["id"] for r in left.collect()) == [0, 3, 4] and left.columns == people.columns


@pytest.mark.parametrize("order", [[], ["id"]])
def test_row_index_is_dense(spark, order):
    df = spark.range(1000).repartition(7)
    numbered = rows.with_row_index(df, order).collect()
    assert sorted(r["_row"] for r in numbered) == list(range(1000))
    if order:
        assert all(r["_row"] == r["id"] for r in numbered)


def test_drop_missing_rows(people):
    assert sorted(r["id"] for r in rows.drop_missing_rows(people, "age").collect()) == [0, 1, 4, 5]


# -- columns


def test_column_guards(people):
    with pytest.raises(ValueError, match="gone"):
        columns.drop_columns(people, ["age", "gone"])
    with pytest.raises(ValueError, match="exists"):
        columns.rename_column(people, "age", "SEX")
    with pytest.raises(ValueError, match="empty"):
        columns.rename_column(people, "age", "  ")
    assert "n_o" in columns.rename_column(people, "n.o", "n_o").columns
    assert columns.rename_column(people, "age", "age").columns == people.columns
    assert "n.o" not in columns.drop_columns(people, ["n.o"]).columns
    assert columns.search_columns(people, "E").columns == ["age", "sex", "email", "member", "none"]


def test_to_number_turns_text_into_missing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in columns.to_number(df, ["t"]).collect()] == [1.5, None, None, None]


def test_checked_rejects_unusable_results(spark, people):
    with pytest.raises(ValueError, match="not a DataFrame"):
        checked([1], "step")
    with pytest.raises(ValueError, match="0 rows"):
        checked(people.limit(0), "step")
    with pytest.raises(ValueError, match="all columns"):
        checked(people.select(), "step")
    with pytest.raises(ValueError, match="duplicate"):
        checked(people.select("age", F.col("sex").alias("AGE")), "step")
    with pytest.raises(ValueError):
        require_rows(None)


# -- rules


ORACLE = {
    ">": lambda v, a, b: v is not None and v > a,
    ">=": lambda v, a, b: v is not None and v >= a,
    "<": lambda v, a, b: v is not None and v < a,
    "<=": lambda v, a, b: v is not None and v <= a,
    "==": lambda v, a, b: v == a,
    "!=": lambda v, a, b: v != a,
    "between": lambda v, a, b: v is not None and min(a, b) <= v <= max(a, b),
}


@pytest.mark.parametrize("rule", rules.NUMERIC_RULES)
def test_numeric_rules_keep_and_drop_are_complements(people, rule):
    mask = rules.numeric_mask(people, "age", rule, 40.0, 10.0)
    known = {k: None if v is None or math.isnan(v) else v for k, v in values(people, "age").items()}
    want = {k for k, v in known.items() if ORACLE[rule](v, 40.0, 10.0)}
    assert set(values(rules.keep_rows(people, mask), "id")) == want
    assert set(values(rules.drop_rows(people, mask), "id")) == set(known) - want
    assert rules.count_matches(people, mask).first()["matching"] == len(want)


@pytest.mark.parametrize(
    "rule,value,want",
    [
        ("contains", " Z|X ", {0, 3, 5}), ("contains", "", {0, 1, 2, 3, 4, 5}), ("equals", "X ", {0, 3}),
        ("starts with", "z", {5}), ("ends with", "Y", {1, 2}), ("is empty", "", {4}), ("is not empty", "", {0, 1, 2, 3, 5}),
    ],
)
def test_text_rules(people, rule, value, want):
    mask = rules.text_mask(people, "sex", rule, value)
    assert set(values(rules.keep_rows(people, mask), "id")) == want
    assert set(values(rules.drop_rows(people, mask), "id")) == set(range(6)) - want


def test_blank_text_of_any_kind_is_empty(people):
    mask = rules.text_mask(people, "email", "is empty")
    assert set(values(rules.keep_rows(people, mask), "id")) == {0, 2, 3, 4}


def test_literal_contains_and_views(people):
    df = people.withColumn("t", F.lit("a.c"))
    assert rules.keep_rows(df, rules.text_mask(df, "t", "contains", "a.c", literal=True)).count() == 6
    assert rules.keep_rows(df, rules.text_mask(df, "t", "contains", "abc", literal=True)).count() == 0
    assert set(values(rules.range_view(people, "age", 10, 40), "id")) == {0, 1, 4}
    assert set(values(rules.contains_view(people, "sex", "[xz]"), "id")) == {0, 3, 5}
    assert rules.contains_view(people, "sex", "").count() == 6
    with pytest.raises(ValueError):
        rules.numeric_mask(people, "sex", ">", 1.0)


# -- outliers and flags


def test_clip_keeps_missing_and_bounds(people):
    out = values(outliers.clip_outliers(people, ["age", "none", "flat"], 0.5), "age")
    # q1 = 17.5, q3 = 280
    assert out == {0: 10.0, 1: 20.0, 2: None, 3: None, 4: 40.0, 5: 280 + 0.5 * 262.5}


def test_outlier_counts_and_labels(people):
    row = outliers.outlier_counts(people, ["age"], 0.5).first()
    assert (row["numeric_rows"], row["will_clip"], row["will_keep"]) == (4, 1, 3)
    labels = outliers.outlier_labels(people, "age", ["id"], 0.5).collect()
    assert [(r["id"], r["status"]) for r in labels] == [(0, "Keep"), (1, "Keep"), (4, "Keep"), (5, "Will clip")]
    with pytest.raises(ValueError, match="No numeric values"):
        outliers.outlier_counts(people, ["none"])
    with pytest.raises(ValueError, match="numeric"):
        outliers.clip_outliers(people, "sex")


def test_presence_flag(people):
    assert values(outliers.presence_flag(people, "email"), "Hasemail") == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    assert values(outliers.presence_flag(people, "age", "has"), "has") == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    for new in (" ", "AGE"):
        with pytest.raises(ValueError):
            outliers.presence_flag(people, "email", new)


# -- plans


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_rules_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.col("id").cast("double").alias("v"), F.lit("x").alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    kept = rules.keep_rows(df, rules.numeric_mask(df, "v", ">", 5.0)).select("id")
    assert "GreaterThan(v,5.0)" in physical(kept) and "t:string" not in physical(kept)
    assert "IsNotNull(v)" in physical(rows.drop_missing_rows(df, "v"))
    assert "EqualTo(v,5.0)" in physical(rules.keep_rows(df, rules.numeric_mask(df, "v", "==", 5.0)))


def test_fill_and_clip_are_one_projection(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.when(F.col("id") > 2, F.col("id").cast("double")).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = physical(outliers.clip_outliers(missing.fill_missing(df, "v"), "v"))
    assert "Exchange" not in plan and "Join" not in plan and "FileScan" in plan


def test_numeric_rules_reach_the_scan_in_the_columns_type(spark, tmp_path):
    path = str(tmp_path / "k")
    spark.range(10).selectExpr("id + 9007199254740990 AS k", "cast(id AS int) AS i", "cast(id AS decimal(5, 1)) AS d").write.parquet(path)
    df = spark.read.parquet(path)

    def pushed(mask):
        return rules.keep_rows(df, mask)._jdf.queryExecution().executedPlan().toString()

    assert "EqualTo(k,9007199254740993)" in pushed(rules.numeric_mask(df, "k", "==", 9007199254740993))
    assert "GreaterThan(i,5)" in pushed(rules.numeric_mask(df, "i", ">", 5.5))
    assert "LessThanOrEqual(d,2.5)" in pushed(rules.numeric_mask(df, "d", "<=", 2.5))
    count = lambda name, rule, a, b=0: rules.keep_rows(df, rules.numeric_mask(df, name, rule, a, b)).count()
    assert count("k", "==", 9007199254740993) == 1 and count("k", ">", 9007199254740992) == 7
    assert [count("i", r, 5.5) for r in (">", ">=", "<", "<=", "==", "!=")] == [4, 4, 6, 6, 0, 10]
    assert [count("i", r, 1e30) for r in (">", ">=", "<", "<=", "==", "!=")] == [0, 0, 10, 10, 0, 10]
    assert [count("d", r, -1e30) for r in (">", "<")] == [10, 0] and count("d", "between", 7.25, 2) == 6
    nan = float("nan")
    assert [count("i", r, nan) for r in ("==", "!=")] == [0, 10]
    assert rules.keep_rows(df, rules.rule_mask(df, "k", "==", "9007199254740993")).count() == 1


def test_long_row_lists(spark):
    df = spark.range(20_000).toDF("i").repartition(3)
    spec = ",".join(str(i) for i in range(0, 20_000, 3)) + ",19000-19999"
    kept = rows.drop_row_positions(df, spec, ["i"])
    assert sorted(r.i for r in kept.collect()) == [i for i in range(19_000) if i % 3]


def test_rows_of_a_listed_table(spark):
    df = spark.range(3_000).selectExpr("id AS i", "id % 7 AS v").repartition(4)
    spans = [(5, 5), (5, 5), (20, 11), (15, 30), (1_000, 2_100), (2_999, 2_999)]
    gone = {i for a, b in spans for i in range(min(a, b), max(a, b) + 1)}
    table = spark.createDataFrame(spans, "low long, high long")
    for size in (1, 100, 512, 10_000):
        left = rows.drop_rows_listed(df, table, ["i"], bucket_rows=size)
        assert {r.i for r in left.collect()} == set(range(3_000)) - gone and left.columns == df.columns
    assert rows.drop_rows_listed(df, table.limit(0), ["i"]).count() == 3_000
    for bad in ([(3, 3_000)], [(-1, 4)], [(None, 4)]):
        with pytest.raises(ValueError):
            rows.drop_rows_listed(df, spark.createDataFrame(bad, "low long, high long"), ["i"])

