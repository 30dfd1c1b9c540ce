"""Turning a table into a feature vector: impute, standardise, one-hot, assemble."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridwright.functions.frequencies import most_frequent, stacked_counts
from gridwright.functions.quantiles import exact_quantiles, size_aggregates
from gridwright.functions.semantics import categorical_columns, known, number, numeric_columns, quoted, require_columns

FEATURES = "_features"
# Category names are kept on the driver and in the model, so their number is checked.
MAX_CATEGORIES = 100_000
# Suffixes of the helper columns that hold a category's text and number.
TEXT, CODE = "__text", "__code"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


class TablePrep(Estimator):
    """Learns all preparation values from the training rows.

    ``fit`` gives a ``PipelineModel`` of built-in stages only, which Spark saves and
    loads by itself. Numbers: missing cells take the median, then the column gets
    mean 0 and population standard deviation 1. Text and booleans: missing cells
    take the most frequent value, then one column per category; an unseen category
    gives all zeros. Other types, and columns without any known value, are left out.
    """

    def __init__(self, features: Sequence[str], max_categories: int = MAX_CATEGORIES):
        super().__init__()
        self.features = list(features)
        self.max_categories = max_categories

    def _fit(self, df: DataFrame) -> PipelineModel:
        require_columns(df, self.features)
        wanted = set(self.features)
        numbers = [c for c in numeric_columns(df) if c in wanted]
        groups = [c for c in categorical_columns(df) if c in wanted]
        as_text = df.select(*[known(df, n).cast("string").alias(n) for n in groups])
        facts = df.agg(
            F.count("*").alias("rows"),
            *size_aggregates(df, numbers),
            *_moments(df, numbers),
            *[F.approx_count_distinct(known(df, n).cast("string")).alias(f"g{i}") for i, n in enumerate(groups)],
        ).first()
        scales = _scales(df, numbers, facts)
        # The estimate keeps a hopeless column from being counted at all.
        rough = sum(facts[f"g{i}"] for i in range(len(groups)))
        if rough > 2 * self.max_categories:
            raise ValueError(_too_many(rough, self.max_categories))
        seen: dict[str, list] = {n: [] for n in groups}
        if groups:
            for row in stacked_counts(as_text, groups).limit(self.max_categories + 1).collect():
                seen[groups[row["slot"]]].append((-row["n"], row["value"]))
        total = sum(map(len, seen.values()))
        if total > self.max_categories:
            raise ValueError(_too_many(total, self.max_categories))
        categories = {n: sorted(found) for n, found in seen.items() if found}
        if not scales and not categories:
            raise ValueError("No usable feature columns.")
        return self._pipeline(df, scales, categories)

    @staticmethod
    def _pipeline(df, scales, categories) -> PipelineModel:
        taken = {c.lower() for c in df.columns}
        numbers = [_free_name("num", n, taken) for n in scales]
        groups = [_free_name("cat", n, taken) for n in categories]
        columns = []
        for new, (name, (median, mean, scale)) in zip(numbers, scales.items()):
            value = f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
            filled = f"coalesce({value}, {sql_number(median)})"
            columns.append(f"({filled} - {sql_number(mean)}) / {sql_number(scale)} AS {quoted(new)}")
        for new, (name, ranked) in zip(groups, categories.items()):
            # The leading '=' keeps the empty text a valid category name.
            filled = f"coalesce(CAST({quoted(name)} AS STRING), {sql_text(ranked[0][1])})"
            columns.append(f"concat('=', {filled}) AS {quoted(new + TEXT)}")
        stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
        if groups:
            texts, codes = [g + TEXT for g in groups], [g + CODE for g in groups]
            labels = [["=" + value for value in sorted(v for _, v in ranked)] for ranked in categories.values()]
            indexers = [
                StringIndexerModel.from_labels(found, inputCol=text, outputCol=code, handleInvalid="keep")
                for found, text, code in zip(labels, texts, codes)
            ]
            encoder = OneHotEncoder(inputCols=codes, outputCols=groups, dropLast=True)
            ready = stages[0].transform(df).select(*[quoted(t) for t in texts])
            stages += [*indexers, encoder.fit(PipelineModel(indexers).transform(ready))]
        stages.append(VectorAssembler(inputCols=numbers + groups, outputCol=FEATURES))
        return PipelineModel(stages)


def _too_many(found: int, limit: int) -> str:
    return f"About {found} categories exceed the limit of {limit}; drop wide text columns."


def _moments(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [
        f(number(df, n)).alias(f"{tag}{i}")
        for i, n in enumerate(names)
        for tag, f in (("a", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max))
    ]


def _scales(df: DataFrame, names: Sequence[str], facts: Row) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and population deviation of the column once filled with it.

    The latter two follow from the moments of the known values, without another pass.
    """
    scales = {}
    for i, (name, (median,)) in enumerate(exact_quantiles(df, names, [0.5], sizes=facts).items()):
        if median is None:
            continue
        known_share = facts[f"_n{i}"] / facts["rows"]
        average = facts[f"a{i}"]
        mean = known_share * average + (1 - known_share) * median
        spread = known_share * (facts[f"v{i}"] + (average - mean) ** 2) + (1 - known_share) * (median - mean) ** 2
        # A constant column, whose median then equals it, is only centred.
        flat = facts[f"lo{i}"] == facts[f"hi{i}"] or spread <= 0
        scales[name] = (median, facts[f"lo{i}"], 1.0) if flat else (median, mean, math.sqrt(spread))
    return scales


def _free_name(kind: str, name: str, taken: set[str]) -> str:
    """A helper column name that ML stages accept (no dots) and the table does not use."""
    new = f"{kind}__{re.sub('[.`]', '_', name)}"
    while {new.lower(), (new + TEXT).lower(), (new + CODE).lower()} & taken:
        new += "_"
    taken.update({new.lower(), (new + TEXT).lower(), (new + CODE).lower()})
    return new


def prepared(prep: PipelineModel, df: DataFrame) -> DataFrame:
    """The table with its feature vector and none of the helper columns."""
    return prep.transform(df).select(*[quoted(c) for c in df.columns], FEATURES)


def feature_names(prep: PipelineModel, features: DataFrame) -> list[str]:
    """Names of the vector's entries: ``num__column`` and ``cat__column_value``.

    ``features`` is any table prepared with ``prep``; only its schema is read.
    """
    groups = [c for c in prep.stages[-1].getInputCols() if c.startswith("cat__")]
    attributes = features.schema[FEATURES].metadata["ml_attr"]["attrs"]
    entries = sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])
    names = []
    for entry in (a["name"] for a in entries):
        source = next((g for g in groups if entry.startswith(g + "_=")), None)
        names.append(entry if source is None else f"{source}_{entry[len(source) + 2:]}")
    return names


def stage_names(prep: PipelineModel) -> list[str]:
    """Names of the vector's entries as the stages tell them, for a pipeline that comes without its facts.

    A column of one number is one entry; a one-hot column has an entry for each label of the indexer behind it,
    but for the one that the encoder drops.
    """
    labels = {}
    for stage in prep.stages:
        if isinstance(stage, StringIndexerModel):
            outs = [stage.getOutputCol()] if stage.isSet("outputCol") else stage.getOutputCols()
            for out, found in zip(outs, stage.labelsArray):
                unknown = ["unknown"] if stage.getHandleInvalid() == "keep" else []
                labels[out] = [*found, *unknown]
    spread = {}
    for stage in prep.stages:
        if isinstance(stage, OneHotEncoderModel):
            single = stage.isSet("inputCol")
            sources = [stage.getInputCol()] if single else stage.getInputCols()
            outs = [stage.getOutputCol()] if single else stage.getOutputCols()
            for source, out, size in zip(sources, outs, stage.categorySizes):
                known = labels.get(source, [str(i) for i in range(size)])
                spread[out] = known[: size - 1] if stage.getDropLast() else known
    names = []
    for column in prep.stages[-1].getInputCols():
        # Saved preparations put '=' before a category, so that the empty text has a name.
        names += [f"{column}_{v.removeprefix('=')}" for v in spread[column]] if column in spread else [column]
    return names


def standardised(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns imputed with the median and scaled to mean 0, population deviation 1."""
    names = list(names)
    facts = df.agg(F.count("*").alias("rows"), *size_aggregates(df, names), *_moments(df, names)).first()
    scales = _scales(df, names, facts)
    out = []
    for c in df.columns:
        if c in scales:
            median, mean, scale = scales[c]
            out.append(((F.coalesce(number(df, c), F.lit(median)) - mean) / scale).alias(c))
        else:
            out.append(F.col(quoted(c)))
    return df.select(*out)


def one_hot_columns(df: DataFrame, name: str) -> DataFrame:
    """Replace a text column by one 0/1 column per category, missing taking the mode."""
    require_columns(df, [name])
    value = known(df, name).cast("string")
    top = most_frequent(df.select(value.alias(name)), [name])[name]
    if top is None:
        return df.drop(quoted(name))
    if top.distinct > 1000:
        raise ValueError(f"{top.distinct} categories are too many for separate columns; use TablePrep.")
    seen = sorted(r[0] for r in df.select(value.alias("v")).na.drop().distinct().collect())
    filled = F.coalesce(value, F.lit(top.value))
    keep = [F.col(quoted(c)) for c in df.columns if c != name]
    return df.select(*keep, *[(filled == s).cast("int").alias(f"{name}_{s}") for s in seen])

