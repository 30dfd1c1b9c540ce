"""A trained model on a stream: encoding and prediction of the rows as they arrive."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridwright.operators.models import PREDICTION, NeighbourModel, TrainedModel
from gridwright.sources.model_store import load_model, save_model
from gridwright.sources.tables import read_text, write_text

MODEL_VERSION = "model_version"
#: Folder inside the checkpoint that holds the model and its facts, beside what Spark keeps there.
SCORER = "scorer"


class StreamScorer:
    """Scores a stream with one version of a model, cleaned by ``cleaning`` first if given.

    Model, version and defaults lie in the stream's checkpoint folder. A start there uses those of the first
    start, so a restart goes on with the same encoding and weights, whatever was trained in between. Scoring is one
    stateless projection: encoding and prediction run inside each micro-batch, and nothing is looked up elsewhere.
    A neighbour model compares rows with all training rows and so cannot score a stream.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, cleaning=None):
        self.spark, self.checkpoint, self.cleaning = spark, checkpoint, cleaning
        self._facts = f"{checkpoint}/{SCORER}/facts"

    def pin(self, model: TrainedModel, defaults: dict[str, Any] | None = None) -> str:
        """Keep ``model`` for this checkpoint and return its version; with one kept already, that one's version.

        The facts are written last, so a start that dies half-way has kept nothing.
        """
        if isinstance(model.core, NeighbourModel):
            raise ValueError("A neighbour model cannot score a stream; score its rows in batches.")
        kept = self.version()
        if kept is not None:
            return kept
        place = f"{self.checkpoint}/{SCORER}/{uuid.uuid4().hex}"
        save_model(self.spark, model, place)
        told = json.dumps([model.algo, model.params, model.target, model.features, model.metrics, place], sort_keys=True, default=str)
        version = hashlib.sha256(told.encode()).hexdigest()[:16]
        write_text(self.spark, self._facts, json.dumps({"place": place, "version": version, "defaults": defaults or {}}))
        return version

    def version(self) -> str | None:
        """Version of the model kept in the checkpoint; None before the first start."""
        found = read_text(self.spark, self._facts)
        return json.loads(found)["version"] if found else None

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows, of a batch or a stream, with prediction and model version.

        Null and unseen categories and missing numbers are encoded as in training; feature columns that the rows
        lack take the kept defaults.
        """
        found = read_text(self.spark, self._facts)
        if not found:
            raise ValueError("No model is kept in this checkpoint; pin one first.")
        facts = json.loads(found)
        taken = {PREDICTION, MODEL_VERSION} & {c.lower() for c in df.columns}
        if taken:
            raise ValueError(f"The rows already have columns named {sorted(taken)}.")
        model = load_model(self.spark, facts["place"])
        rows = self.cleaning.apply(df) if self.cleaning else df
        return model.predict(rows, facts["defaults"]).withColumn(MODEL_VERSION, F.lit(facts["version"]))

    def start(self, stream: DataFrame, path: str) -> StreamingQuery:
        """Score what is available in the stream and append it to a Parquet table; each row exactly once."""
        writer = self.apply(stream).writeStream.format("parquet").outputMode("append")
        state = f"{self.checkpoint}/query"
        return writer.option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
