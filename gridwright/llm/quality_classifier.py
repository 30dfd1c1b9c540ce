"""Quality from compressed sizes: which dictionary, of good or of bad text, makes a text smaller?

Two zstandard dictionaries are built from labelled texts. A text is cut into blocks; each block is
compressed once with either dictionary. The difference of the summed sizes, divided by the text's bytes,
goes through a logistic curve fitted on labelled rows that no dictionary has seen, so the score is a
probability that the label is 1. Fitting uses a bounded sample; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import quoted, spare, text_of, values

BLOCK_BYTES = 2048
DICTIONARY_BYTES = 112 * 1024
#: Labelled rows of each class that fitting reads at most, and the longest text among them.
SAMPLE_ROWS = 2400
SAMPLE_CHARS = 32768
LEVEL = 3
#: How strongly the curve is held flat, in squared units of its coefficients.
RIDGE = 1e-3


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """The common substrings of ``texts``; the texts themselves where there are too few to choose from."""
    blocks = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content) if content else None
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
    )


@dataclass
class CompressionClassifier:
    """Dictionaries and curve; ``score`` is ``logistic(weights . (1, difference, size))``."""

    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    share: float = 0.5  # of label 1: the score of an empty text

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """For each text: 1, the normalised size difference, the normalised size itself."""
        good, bad = compressor(self.good), compressor(self.bad)
        rows = np.zeros((len(texts), 3))
        for i, text in enumerate(values(texts) if isinstance(texts, pa.Array) else texts):
            raw = text.encode("utf-8", "surrogatepass")
            blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
            a = sum(len(good.compress(b)) for b in blocks)
            b = sum(len(bad.compress(b)) for b in blocks)
            n = max(1, len(raw))
            rows[i] = 1.0, (b - a) / n, min(a, b) / n
        return rows

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        x = self.features(texts)
        found = 1.0 / (1.0 + np.exp(-np.clip(x @ np.asarray(self.weights), -40, 40)))
        return np.where(x[:, 2] > 0, found, self.share)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weight * (y - p)) - RIDGE * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> CompressionClassifier:
    """Fit on the texts of ``docs`` that ``labels`` marks with 0 or 1.

    At most ``sample_rows`` keys of each class are drawn from ``labels``, those of the smallest hash, and
    only their texts of at most ``SAMPLE_CHARS`` characters reach the driver, so the bound in bytes is
    fixed; no text is shuffled. Every other text drawn builds the dictionaries, the rest fits the curve,
    weighted to the classes' true shares. Null keys, other labels and null or empty texts are passed over;
    of a key with two labels the larger counts, of one with several texts any of them. Without texts of both classes the score is one constant:
    the smoothed share of label 1.
    """
    known = (
        labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
        .groupBy("k").agg(F.max("y").alias("y"))
    )
    counted = dict(known.groupBy("y").count().collect())
    drawn_keys = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
        drawn_keys = some if drawn_keys is None else drawn_keys.unionAll(some)
    texts = docs.select(quoted(key).alias("k"), text_of(text).alias("t")).where(F.length("t").between(1, SAMPLE_CHARS))
    # One text of a key, however often the key repeats.
    rows = texts.join(F.broadcast(drawn_keys), "k").groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).collect()
    drawn = {y: sorted({r.t for r in rows if r.y == y}) for y in (0, 1)}
    share = (counted.get(1, 0) + 1) / (sum(counted.values()) + 2)
    if min(len(drawn[0]), len(drawn[1])) < 2:
        return CompressionClassifier(b"", b"", [float(np.log(share / (1 - share))), 0.0, 0.0], share)
    halves = {y: (texts[::2], texts[1::2]) for y, texts in drawn.items()}
    model = CompressionClassifier(
        *(dictionary([t.encode("utf-8", "surrogatepass") for t in halves[y][0]]) for y in (1, 0)), share=share
    )
    x = np.vstack([model.features(halves[y][1]) for y in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(halves[0][1]), len(halves[1][1])])
    weight = np.where(y == 1, counted[1] / len(halves[1][1]), counted[0] / len(halves[0][1]))
    weight *= len(y) / weight.sum()
    spread = np.concatenate([[1.0], np.maximum(x[:, 1:].std(axis=0), 1e-6)])
    model.weights = [float(b) for b in _logistic(x / spread, y, weight) / spread]
    return model


def score(df: DataFrame, model: CompressionClassifier, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the score of each whole text (null text: empty) in ``into``; other columns stay as they are.

    An empty text gets the share of label 1. A column already called ``into`` is replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.probabilities(texts), pa.float64())

    return df.withColumn(into, probability(text_of(text)))


def reject(df: DataFrame, model: CompressionClassifier, threshold: float, text: str = "text") -> DataFrame:
    """The rows whose score reaches ``threshold``, with the columns of ``df``."""
    name = spare(df, "score_of_text")
    return score(df, model, text, name).where(F.col(name) >= threshold).drop(name)
