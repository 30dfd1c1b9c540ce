"""Streams that are scored, stopped and started again, against the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridwright.constants import REGRESSION
from gridwright.functions.storage import shared_folder
from gridwright.operators import models
from gridwright.plans import fixtures as fx
from gridwright.plans.queries import EVEN_SPLIT, query, rounded
from gridwright.streaming import StreamScorer

LINE = f"""{EVEN_SPLIT}, t AS (SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM p WHERE split = 'Train'),
m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS slope, median(x) AS mid FROM t)"""


@query(
    "stream_score",
    f"""WITH {LINE}
SELECT o_orderkey, round(my + (coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END, mid) - mx) * slope, 3) AS prediction,
  true AS first_model FROM orders, m""",
)
def stream_score(spark, folder):
    """Orders arrive in two parts; the stream stops between them, and another model is trained before it goes on.

    Pending orders do not tell the customer, so the encoding fills it. All rows must carry the first model's version.
    """
    df = fx.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    train = df.select("o_orderkey", "o_custkey", "o_totalprice")

    def fitted(rows):
        return models.train_with_baseline(rows, "o_totalprice", "Linear Regression", {}, REGRESSION, 0.25, ["o_orderkey"])

    base = f"{shared_folder(spark)}/scored-{uuid.uuid4().hex}"
    come = df.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"))
    versions = []
    for part, model in enumerate((fitted(train), fitted(train.withColumn("o_totalprice", F.col("o_totalprice") * 2)))):
        come.where(F.col("o_orderkey") % 2 == part).write.mode("append").parquet(f"{base}/in")
        scorer = StreamScorer(spark, f"{base}/state")
        versions.append(scorer.pin(model))
        scorer.start(spark.readStream.schema(come.schema).parquet(f"{base}/in"), f"{base}/out").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    first = (F.col("model_version") == versions[0]).alias("first_model")
    return rounded(out.select("o_orderkey", "prediction", first), 3, "prediction")
