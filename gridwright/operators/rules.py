"""Row rules: masks over one column, and keeping or dropping what they match.

A mask is written as a bare condition that may be null for missing cells. Keeping
uses it as it is, so a comparison still reaches the Parquet scan; dropping and
counting first turn null into false.
"""

from __future__ import annotations

import re
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.semantics import (
    NON_BLANK,
    column,
    dtype,
    is_float,
    is_numeric,
    known,
    require_columns,
    require_numeric,
    text,
)

Number = int | float | Decimal

# The rule names a user can choose.
NUMERIC_RULES = (">", ">=", "<", "<=", "==", "!=", "between")
TEXT_RULES = ("contains", "equals", "starts with", "ends with", "is empty", "is not empty")


def _exact(value: Number) -> Decimal:
    """The number as it was written; whole numbers of any size stay exact."""
    return value if isinstance(value, Decimal) else Decimal(repr(value) if isinstance(value, float) else int(value))


def _limit(kind: T.DataType, value: Number, up: bool) -> tuple[Column | None, int, bool]:
    """A limit in the column's own type: (literal, side, exact).

    The literal is the nearest value of the type on the wanted side; ``side`` is -1 or 1, without a literal,
    where ``value`` lies below or above all values of the type. ``exact``: the literal is ``value`` itself.
    """
    if is_float(kind):
        return F.lit(float(value)).cast(kind) if isinstance(kind, T.DoubleType) else F.lit(float(value)), 0, True
    value = _exact(value)
    digits = kind.scale if isinstance(kind, T.DecimalType) else 0
    if value.is_infinite():
        return None, 1 if value > 0 else -1, False
    with localcontext() as context:
        context.prec = 400
        near = value.quantize(Decimal(1).scaleb(-digits), ROUND_CEILING if up else ROUND_FLOOR)
    if isinstance(kind, T.DecimalType):
        top = Decimal(10) ** (kind.precision - kind.scale) - Decimal(1).scaleb(-digits)
        bottom = -top
    else:
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
        bottom, top = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    if near > top or near < bottom:
        return None, 1 if near > top else -1, False
    plain = near if isinstance(kind, T.DecimalType) else int(near)
    return F.lit(plain).cast(kind), 0, near == value


def numeric_mask(df: DataFrame, name: str, rule: str, a: Number, b: Number = 0.0) -> Column:
    """A numeric rule. Missing cells match only ``!=``.

    The limit is brought to the column's type, not the column to the limit's, so whole numbers of any size
    compare exactly and the comparison itself reaches the scan.
    """
    require_numeric(df, [name], f"Rule {rule}")
    if rule not in NUMERIC_RULES:
        raise ValueError(f"Unknown rule: {rule}")
    c, kind = column(name), dtype(df, name)
    if rule == "between":
        low, high = (a, b) if a <= b else (b, a)
        return numeric_mask(df, name, ">=", low) & numeric_mask(df, name, "<=", high)
    nothing = c.isNotNull() & F.lit(False)
    if not is_float(kind) and isinstance(a, (float, Decimal)) and a != a:  # NaN equals nothing
        return F.lit(True) if rule == "!=" else nothing
    limit, side, exact = _limit(kind, a, up=rule in (">=", "<"))
    if rule == "!=":
        return ~known(df, name).eqNullSafe(limit) if exact and limit is not None else F.lit(True)
    if rule == "==":
        return c == limit if exact and limit is not None else nothing
    if limit is None:
        return c.isNotNull() if (side < 0) == (rule in (">", ">=")) else nothing
    if rule == "<":
        return c < limit
    if rule == "<=":
        return c <= limit
    # NaN sorts above every number, so it has to be excluded here.
    mask = c > limit if rule == ">" else c >= limit
    return mask & ~F.isnan(c) if is_float(kind) else mask


def text_mask(df: DataFrame, name: str, rule: str, value: str = "", literal: bool = False) -> Column:
    """A text rule, without regard to case; missing counts as the empty text.

    ``contains`` takes a regular expression unless ``literal`` is set.
    """
    require_columns(df, [name])
    wanted = value.strip()
    content = text(df, name)
    if rule == "contains":
        if literal:
            return F.contains(F.lower(content), F.lit(wanted.lower()))
        return content.rlike("(?iu)" + wanted)
    if rule == "equals":
        return F.lower(content) == wanted.lower()
    if rule == "starts with":
        return F.startswith(F.lower(content), F.lit(wanted.lower()))
    if rule == "ends with":
        return F.endswith(F.lower(content), F.lit(wanted.lower()))
    if rule == "is empty":
        return ~content.rlike(NON_BLANK)
    if rule == "is not empty":
        return content.rlike(NON_BLANK)
    raise ValueError(f"Unknown rule: {rule}")


def rule_mask(df: DataFrame, name: str, rule: str, value: Number | str = "", value_b: Number | str = 0.0) -> Column:
    """The numeric or the text rule, by the type of the column."""
    require_columns(df, [name])
    if is_numeric(dtype(df, name)):
        return numeric_mask(df, name, rule, _given(value), _given(value_b))
    return text_mask(df, name, rule, str(value))


def _given(value: Number | str) -> Number:
    """A number from what a user typed; nothing typed is zero."""
    if not isinstance(value, str):
        return value
    shown = value.strip()
    return (int(shown) if re.fullmatch(r"[+-]?[0-9]+", shown) else float(shown)) if shown else 0


def keep_rows(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def drop_rows(df: DataFrame, mask: Column) -> DataFrame:
    """The exact complement of :func:`keep_rows`."""
    return df.where(~F.coalesce(mask, F.lit(False)))


def count_matches(df: DataFrame, mask: Column) -> DataFrame:
    return df.agg(F.count_if(mask).alias("matching"), F.count("*").alias("total"))


def range_view(df: DataFrame, name: str, low: Number, high: Number) -> DataFrame:
    """Rows with ``low <= value <= high``."""
    require_numeric(df, [name], "Range")
    if low > high:
        return df.where(F.lit(False))
    return df.where(numeric_mask(df, name, "between", low, high))


def contains_view(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose text matches the pattern in any case; missing cells never match."""
    require_columns(df, [name])
    if not pattern:
        return df
    return df.where(known(df, name).cast("string").rlike("(?iu)" + pattern))
