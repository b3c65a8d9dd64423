"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Tokens are the longest runs of letters and digits (and anything beyond ASCII) or of other signs; the
features are unigrams and bigrams of them, hashed to 2^BITS places, each worth SCALE / number of
features of its text. The model is one array of float32 weights, and a score is the sigmoid of a sparse
dot product, summed over whole texts.

Training takes a bounded sample of the labelled rows, at most `most_rows` by a seeded hash of their ids.
What is shuffled are their features, never their texts. They go to one task, sorted by epoch and hash
before Python gets them, so the learner reads each row once an epoch from a stream of small batches and
holds nothing but the model (12 MB), however long the sampled texts are; it is the same on every run. The
weights (4 MB) go to the workers. Only texts go to Python for a score, and only scores come back.

Defined results: a null text is empty; an empty text has the bias alone for a score; a text of any length
is scored whole; labels that are null are left out; of ties in the sample's order (repeated rows of one
doc_id) the order is that of labels and features, so reruns agree; without labels every score is 0.5;
repeated rows get equal scores; an empty table gives an empty result; extra columns come back as they are,
but for one of the score's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, mix, run_hashes, small_batches, text_chunks

BITS = 20
SCALE = 30.0
REPEAT = np.uint64(0xD6E8FEB86659FD93)
_CLASSES = np.full(256, 2, dtype=np.uint8)
_CLASSES[128:] = 1
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _CLASSES[_low:_high] = 1
_CLASSES[list(SPACES)] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of texts laid end to end, and the text of each.

    Of a token that is the last one or the last but one over again, the n-gram of the two is also counted
    under one name for all tokens.
    """
    h, first = run_hashes(data, offsets, _CLASSES)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    again = np.flatnonzero((h[2:] == h[:-2]) & (doc[2:] == doc[:-2])) + 2
    again = np.concatenate([again, np.flatnonzero((h[1:] == h[:-1]) & same) + 1])
    places = np.concatenate([h, pairs[same], np.full(len(again), REPEAT)]) >> np.uint64(64 - BITS)
    return places.astype(np.int64), np.concatenate([doc, doc[:-1][same], doc[again]])


def vectors(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and values of each text's features, with the bias last."""
    for i, j, data, offsets in text_chunks(texts):
        place, doc = features(data, offsets)
        order = np.argsort(doc, kind="stable")
        bounds = np.searchsorted(doc[order], np.arange(j - i + 1))
        for k in range(j - i):
            at, count = np.unique(place[order[bounds[k] : bounds[k + 1]]], return_counts=True)
            yield np.append(at, 1 << BITS).astype(np.int32), np.append(count * (SCALE / max(count.sum(), 1)), 1.0).astype(np.float32)


class Learner:
    """Weights, the bias last, by per-coordinate FTRL-proximal updates, one row after another."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(self, i: np.ndarray | slice) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weight(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 16_000, seed: int = 7, epochs: int = 2) -> np.ndarray:
    """Weights learnt from the rows of labels(doc_id, <label>) that aren't held out, at most `most_rows` of them."""
    usable = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("double").alias("_y"))
    sample = usable.withColumn("_at", F.xxhash64(F.lit(seed), "doc_id")).orderBy("_at", "doc_id", "_y").limit(most_rows)
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "_y", "_at", "doc_id")  # `most_rows` rows of three numbers

    def vectorized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(vectors(batch.column(0)))
            columns = [pa.array([v[k].tobytes() for v in made], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], names=["places", "values", "_y", "_at", "doc_id"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for batch in batches:
            for places, values, y in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                learner = learner or Learner()
                learner.learn(np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(values.as_buffer(), np.float32), y)
        if learner:
            yield pa.RecordBatch.from_arrays([pa.array([learner.weight(slice(None)).astype(np.float32).tobytes()], pa.binary())], names=["w"])

    kind = dict(rows.dtypes)["doc_id"]
    made = rows.mapInArrow(vectorized, f"places binary, values binary, _y double, _at long, doc_id {kind}").repartition(1)
    made = made.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).sortWithinPartitions("_epoch", "_at", "doc_id", "_y", "places", "values")
    made = made.select("places", "values", "_y").mapInArrow(learn, "w binary").collect()  # one row of 4 MB
    return np.frombuffer(bytes(made[0].w), dtype=np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def score_of(text: Column, sent: Broadcast) -> Column:
    """The score of a text column by the weights that were sent."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w, out = sent.value, np.zeros(len(texts))
        for i, j, data, offsets in text_chunks(texts):
            place, doc = features(data, offsets)
            total = np.bincount(doc, weights=w[place], minlength=j - i)
            out[i:j] = w[-1] + SCALE * total / np.maximum(np.bincount(doc, minlength=j - i), 1)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return scored(text)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """Adds the score to docs(text, ...) under the name."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return small_batches(docs).withColumn(name, score_of(F.col("text"), sent))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is `least` at least, with the columns they had."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return small_batches(docs).where(score_of(F.col("text"), sent) >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
