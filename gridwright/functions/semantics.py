"""What counts as missing, blank, numeric and categorical."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# At least one character that is not white space; (?U) covers Unicode blanks.
NON_BLANK = r"(?U)\S"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """Reference a column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def is_categorical(kind: T.DataType) -> bool:
    """Text and booleans; a boolean is never treated as a number."""
    return is_text(kind) or isinstance(kind, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f.dataType)]


def known(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null."""
    kind = dtype(df, name)
    if is_float(kind):
        return F.nanvl(column(name), F.lit(None).cast(kind))
    return column(name)


def number(df: DataFrame, name: str) -> Column:
    """The value as a double, NaN turned into null."""
    return known(df, name).cast("double")


def missing(df: DataFrame, name: str) -> Column:
    """True for null and NaN; never null itself."""
    if is_float(dtype(df, name)):
        return column(name).isNull() | F.isnan(column(name))
    return column(name).isNull()


def normalised(df: DataFrame) -> DataFrame:
    """NaN replaced by null in every float column, so missing has one form."""
    if not any(is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[known(df, c).alias(c) for c in df.columns])


def text(df: DataFrame, name: str) -> Column:
    """The text form of a column; missing becomes the empty string."""
    return F.coalesce(known(df, name).cast("string"), F.lit(""))


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits that stand for a row, missing cells included; NaN counts as missing, nested cells by their JSON text.

    The hash functions skip nulls, so whether a cell is null is hashed beside it.
    """
    cells: list[Column] = [F.lit(seed)]
    for field in df.schema.fields:
        cell = known(df, field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cell = F.to_json(F.struct(cell.alias("v")), {"ignoreNullFields": "false"})
        cells += [cell, cell.isNull()]
    return F.xxhash64(*cells)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"Columns not found: {absent}")


def require_numeric(df: DataFrame, names: Iterable[str], action: str) -> None:
    names = list(names)
    require_columns(df, names)
    other = [n for n in names if not is_numeric(dtype(df, n))]
    if other:
        raise ValueError(f"{action} requires numeric columns: {other}")
