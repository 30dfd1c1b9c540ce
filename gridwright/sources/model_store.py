"""Saving and loading trained models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import SparkSession

from gridwright.operators.models import NeighbourModel, TrainedModel
from gridwright.sources.tables import read_text, write_text


def save_model(spark: SparkSession, model: TrainedModel | None, path: str) -> None:
    """Write the pipeline, and its facts as JSON beside it.

    The pipeline is plain ``pyspark.ml`` and can be loaded without this package. The
    training rows of a neighbour model are a Parquet table.
    """
    if model is None:
        raise ValueError("No model to save.")
    facts = {
        "task": model.task, "target": model.target, "features": model.features, "classes": model.classes,
        "target_type": model.target_type, "algo": model.algo, "params": model.params, "metrics": model.metrics,
        "baseline": model.baseline, "meta": model.meta, "neighbours": None,
    }
    stages = list(model.prep.stages)
    if isinstance(model.core, NeighbourModel):
        model.core.train.write.mode("overwrite").parquet(f"{path}/neighbours")
        facts["neighbours"] = {"k": model.core.k, "weights": model.core.weights, "classes": model.core.classes}
    else:
        stages.append(model.core)
    PipelineModel(stages).write().overwrite().save(f"{path}/pipeline")
    write_text(spark, f"{path}/facts", json.dumps(facts))


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Load a saved model, or a bare saved pipeline, whose facts are then empty.

    A bare pipeline predicts class texts if a stage of it turns class numbers back into texts; the names of its
    features come from its stages.
    """
    content = read_text(spark, f"{path}/facts")
    if content is None:
        whole = PipelineModel.load(path)
        prep, core = _cut(whole)
        texts = [s.getLabels() for s in whole.stages if isinstance(s, IndexToString) and s.getLabels()]
        return TrainedModel(prep, core, "", "", [], texts[-1] if texts else None, "string" if texts else "double")
    facts = json.loads(content)
    pipeline = PipelineModel.load(f"{path}/pipeline")
    near = facts.pop("neighbours")
    if near:
        prep = pipeline
        core = NeighbourModel(spark.read.parquet(f"{path}/neighbours"), near["k"], near["weights"], near["classes"])
    else:
        prep, core = _cut(pipeline)
    return TrainedModel(prep, core, **facts)


def _cut(pipeline: PipelineModel):
    """Everything up to the vector assembler prepares, the stage after it predicts."""
    at = next((i for i, s in enumerate(pipeline.stages) if isinstance(s, VectorAssembler)), None)
    if at is None or at + 1 >= len(pipeline.stages):
        raise ValueError("The saved pipeline has no preparation followed by a model.")
    return PipelineModel(pipeline.stages[: at + 1]), pipeline.stages[at + 1]


def target_warning(model: TrainedModel, columns: list[str]) -> str | None:
    """A hint when the model's target is not a column of the table at hand."""
    if model.target and model.target not in columns:
        return f"Model target '{model.target}' is not present in the current dataset."
    return None
