"""Quality by compression: how much smaller does a dictionary of good text make a text than a dictionary of bad text?

Two zstandard dictionaries are built from pieces of labelled good and bad texts. A text is cut into pieces of ``PIECE`` bytes, each
is compressed with either dictionary on its own (so that a long text doesn't become its own dictionary), and the sizes are summed
over the whole text. The normalised difference of both sums, with the size per byte and the length, goes through a logistic
curve that is fitted on labelled texts whose pieces are in neither dictionary.

Fitted on bounded samples: ``label_rows`` labelled rows per class, half of them for the dictionaries (``piece_rows`` pieces per class),
half for the curve; classes that were cut weigh as much as before the cut. Both are taken by hash order, so a fit is repeatable.
Every row is scored, on its whole text. Nothing is shuffled by the scoring.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

PIECE = 512
LEVEL = 3
DICTIONARY = 32 * 1024
#: Bytes that both sizes are taken to have besides: short texts stay near the middle.
BASE = 200


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """Trained where there are samples enough, else the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def measures(texts: pd.Series, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Per text: normalised difference, size per byte, its square, log of the length; all 0 for an empty text."""
    rows = []
    for text in texts:
        cut = pieces(text or "")
        g, b, n = sum(len(good.compress(x)) for x in cut), sum(len(bad.compress(x)) for x in cut), sum(map(len, cut))
        rate = g / (n + BASE)
        rows.append(((b - g) / (b + g + BASE), rate, rate * rate, np.log1p(n)))
    return np.array(rows, float).reshape(-1, 4)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    z, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return w


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the key as text leaves 1 when divided by 3. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", label_rows: int = 8000, piece_rows: int = 4000) -> Model:
    """Learn from the rows of ``labels`` (1 good, 0 bad) that are not held out.

    Labels that are null, neither 0 nor 1, or contradict each other for a key are left out; repeated ones count once. Where a class
    has no text the model gives every text the same score: 0.5 without labels, else leaning to the class that there is.
    """
    spark = small_batches(docs).sparkSession
    known = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key"))
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).alias("__other")).where("label = __other").drop("__other")
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(label_rows).collect()]
    picks = spark.createDataFrame([(r["key"], r["label"]) for r in drawn], f"key {dict(docs.dtypes)[key]}, label int")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picks), "key")
    texts = texts.withColumn("half", F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(y, zlib.crc32(x), x) for y, t in zip(batch["label"], batch["text"], strict=True) for x in pieces(t or "")]
            yield pd.DataFrame(rows, columns=["label", "hash", "piece"])

    parts = texts.where("half = 0").select("label", "text").mapInPandas(cut, "label int, hash long, piece binary")
    samples = [[bytes(r["piece"]) for r in parts.where(F.col("label") == y).orderBy("hash", "piece").limit(piece_rows).collect()] for y in (1, 0)]
    good, bad = map(dictionary, samples)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = compressor(good), compressor(bad)
        for batch in batches:
            yield pd.DataFrame(measures(batch["text"], *by), columns=list("abcd")).assign(label=batch["label"].to_numpy())

    seen = texts.where("half = 1").select("label", "text").mapInPandas(measure, "a double, b double, c double, d double, label int").toPandas()
    seen = seen.sort_values(list("abcd") + ["label"])
    x, y = seen[list("abcd")].to_numpy(float).reshape(-1, 4), seen["label"].to_numpy(float)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(4), np.ones(4))
    share = np.array([total.get(int(c), 0) / max(1, min(label_rows, total.get(int(c), 0))) for c in y])
    if all(samples) and 0 < y.sum() < len(y):
        weights = logistic((x - mean) / scale, y, share)
    else:
        weights = np.array([np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 1)), 0, 0, 0, 0])
    return Model(good, bad, tuple(mean), tuple(scale), tuple(weights))


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 for each whole text; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = compressor(model.good), compressor(model.bad)
        for batch in batches:
            yield pd.Series(model.probability(measures(batch, *by)))

    return scored(text)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    return docs.where(score(fit(docs, labels, text=text), F.col(text)) >= least)
