"""CSV files: header, missing-value tokens, encodings and inferred types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.semantics import column

# Texts that mean "missing" in a CSV cell.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts that mean true and false when a whole column holds nothing else.
TRUE_TEXT = ["True", "TRUE", "true"]
FALSE_TEXT = ["False", "FALSE", "false"]
# The column for cells beyond the header while a file is read.
EXTRA = "_cells_beyond_header"
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?((([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)|(?i:inf(inity)?))\s*$"


def file_forms(spark: SparkSession, path: str | Sequence[str], any_charset: bool = False) -> list[Row]:
    """``header, latin, broken, files``: files that can be read together, in an order that does not change.

    One pass over the lines, of files of any size: ``latin`` files are not valid UTF-8, ``broken`` ones have
    a line with an odd number of quotes, so a quoted cell goes on in the next line. No more rows than
    different headers; together they list each file once, as Spark's own file index does.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", place.alias("place")
    )
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    forms = lines.groupBy("file").agg(
        F.min_by(F.rtrim(F.col("value"), F.lit("\r")), "place").alias("header"),
        F.max(F.lit(False) if any_charset else ~F.is_valid_utf8("value")).alias("latin"),
        F.max(quotes % 2 == 1).alias("broken"),
    )
    found = forms.groupBy("header", "latin", "broken").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return sorted(found, key=lambda r: r["files"][0])


def invalid_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Files that are not valid UTF-8."""
    return sorted(f for form in file_forms(spark, path) if form["latin"] for f in form["files"])


def _header(reader, path) -> list[str]:
    first = reader.option("header", False).csv(path).limit(1).collect()
    if not first:
        raise ValueError("Dataset is empty.")
    names: list[str] = []
    for i, given in enumerate(first[0]):
        base = given if given not in (None, "") else f"Unnamed: {i}"
        name, copy = base, 0
        while name in names:
            copy += 1
            name = f"{base}.{copy}"
        names.append(name)
    return names


def _cells(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool, separator: str, encoding: str | None
) -> tuple[DataFrame, Column]:
    """All cells as text, missing tokens as null; and the column that holds what a row has beyond its header."""
    forms = file_forms(spark, path, any_charset=bool(encoding))
    if not forms:
        raise ValueError("Dataset is empty.")
    table = None
    for form in forms:
        charset = encoding or ("ISO-8859-1" if form["latin"] else "UTF-8")
        reader = (
            spark.read.option("sep", separator).option("quote", '"').option("escape", '"')
            .option("encoding", charset).option("multiLine", multi_line or form["broken"])
        )
        names = _header(reader, form["files"][:1])
        schema = ", ".join(f"_c{i} string" for i in range(len(names) + 1))
        raw = reader.schema(schema).option("header", True).option("enforceSchema", True).csv(form["files"])
        part = raw.toDF(*names, EXTRA)
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    tokens = [F.lit(t) for t in MISSING_TOKENS]
    kept = [c for c in table.columns if c != EXTRA]
    cells = [F.when(~column(c).isin(*tokens), column(c)).alias(c) for c in kept]
    return table.select(*cells, column(EXTRA)), column(EXTRA)


def _too_long(rows: int) -> ValueError:
    return ValueError(f"{rows} rows have more cells than their header.")


def read_csv_text(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, separator: str = ",",
    encoding: str | None = None,
) -> DataFrame:
    """All columns as text, missing tokens as null; files that are not UTF-8 are read as Latin-1.

    Each file is read by its own header, and files are put together by column name; a column that a file
    lacks is null there. A repeated header ``a, a`` becomes ``a, a.1``. A file in which a quoted cell spans
    lines is read by one task, as is every file under ``multi_line``. Rows with too few cells are filled with
    null; rows with too many are an error, found in a pass of its own.
    """
    table, extra = _cells(spark, path, multi_line, separator, encoding)
    if beyond := table.where(extra.isNotNull()).count():
        raise _too_long(beyond)
    return table.drop(EXTRA)


def infer_types(table: DataFrame) -> DataFrame:
    """Give text columns the narrowest type that fits all their cells, found in one aggregate.

    Whole numbers, then decimals, then booleans, else text. Dates stay text. Rows that a reader has marked
    as too long are an error.
    """
    names = [c for c in table.columns if c != EXTRA]
    checks: list[Column] = [F.count(column(EXTRA)).alias("beyond")] if EXTRA in table.columns else []
    for i, name in enumerate(names):
        c = column(name)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(WHOLE) & c.try_cast("bigint").isNotNull()).alias(f"w{i}"),
            F.count_if(c.rlike(DECIMAL)).alias(f"d{i}"),
            F.count_if(c.isin(TRUE_TEXT + FALSE_TEXT)).alias(f"b{i}"),
        ]
    seen = table.agg(*checks).first()
    if EXTRA in table.columns and seen["beyond"]:
        raise _too_long(seen["beyond"])
    out = []
    for i, name in enumerate(names):
        c, total = column(name), seen[f"n{i}"]
        if total == 0 or total == seen[f"d{i}"] != seen[f"w{i}"]:
            typed = c.try_cast("double")
        elif total == seen[f"w{i}"]:
            typed = c.try_cast("bigint")
        elif total == seen[f"b{i}"]:
            typed = c.isin(TRUE_TEXT)
        else:
            typed = c
        out.append(typed.alias(name))
    return table.select(*out)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, separator: str = ",",
    encoding: str | None = None,
) -> DataFrame:
    """Read CSV files with a header row and inferred column types."""
    return infer_types(_cells(spark, path, multi_line, separator, encoding)[0])
