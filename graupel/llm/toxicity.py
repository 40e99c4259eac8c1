"""Toxicity with a factorization machine over hashed terms.

A text is the set of its terms (``terms``) and of their first 4 to 8 bytes, as
what insults is often a stem with many endings; each is hashed to one of
``BUCKETS`` buckets.  With x the 0/1 vector of a text, its logit is

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

so that two terms can say together what neither says alone.  The pairs cost no
pairs: their sum is half of |sum_i v_i|^2 - sum_i |v_i|^2.

Training takes at most ``per_class`` labelled texts a class, those of least hash
of the id (a documented bound: a classifier may be fitted on a sample), and at
most ``features`` buckets: half of them those whose share differs most between
the classes, half the most frequent ones of the rest.  What the driver holds is
so bounded by per_class * 2 * features bits and the bucket table.  Scores are of
all texts, whole.  The intercept is corrected to the share of the labels of all
training rows.

Cases: a null or empty text has no term and gets the score of the intercept;
labels that are null or neither 0 nor 1 are left out; a document labelled twice
alike counts once, labelled both ways once each; equal texts get equal scores;
without toxic labels every score is below 0.5; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .terms import Terms, packed

BUCKETS = 1 << 18
FACTORS = 8
FEATURES = 1024
#: Bytes of the prefixes of a term that are terms too, beside the whole.
PREFIXES = (4, 5, 6, 7, 8)
PER_CLASS = 8000
#: Bytes of text whose terms are hashed together in a task.
PIECE = 6 << 20


@dataclass
class Machine:
    """``feature`` is the number of a bucket among the learned ones, or -1."""

    feature: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The logits of ``n`` texts, given their (text, feature) pairs."""
        out = np.bincount(row, self.weights[feature], n) + self.bias
        for v in self.factors.T:
            x = v[feature]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        row, feature = features_of(column, self.feature)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(row, feature, n), -60, 60)))


def features_of(column: pa.Array, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs of a string column, in order, where
    ``feature`` gives a bucket's number or -1."""
    found = Terms(column)
    pairs = []
    for size in (0, *PREFIXES):
        which, h = found.prefixes(size) if size else (slice(None), found.hashes())
        got = feature[(h % np.uint64(BUCKETS)).astype(np.int64)]
        pairs.append(found.row[which][got >= 0] << 18 | got[got >= 0])
    pair = np.unique(np.concatenate(pairs))
    return pair >> 18, pair & (BUCKETS - 1)


def fitted(x: np.ndarray, labels: np.ndarray, steps: int = 3000, rate: float = 0.05, decay: float = 3e-3, weight: float = 3.0, factors: int = FACTORS, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) for the 0/1 rows of ``x``: gradient steps of
    clipped length with momentum on the logistic loss, which counts a text of
    label 1 ``weight`` times, with L2 decay."""
    rng = np.random.default_rng(seed)
    n, size = x.shape
    own = np.where(labels > 0, weight, 1.0)
    b, w, v = 0.0, np.zeros(size), rng.normal(0, 0.05, (size, factors))
    moved = [0.0, np.zeros_like(w), np.zeros_like(v)]
    for _ in range(max(20, min(200, steps * 256 // n))):
        shuffled = rng.permutation(n)
        for at in range(0, n, 256):
            chosen = shuffled[at : at + 256]
            part = x[chosen].astype(float)
            sums = part @ v
            logit = b + part @ w + 0.5 * ((sums**2).sum(1) - part @ (v**2).sum(1))
            g = (1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))) - labels[chosen]) * own[chosen] / len(chosen)
            down = part.T @ g
            slopes = [g.sum(), down + decay * w, part.T @ (g[:, None] * sums) - v * down[:, None] + decay * v]
            short = min(1.0, 1.0 / (np.sqrt((slopes[1] ** 2).sum() + (slopes[2] ** 2).sum()) + 1e-9))
            moved = [0.9 * m + short * d for m, d in zip(moved, slopes)]
            b, w, v = b - rate * float(moved[0]), w - rate * moved[1], v - rate * moved[2]
    return b, w, v


def _sample(labelled: DataFrame, per_class: int) -> DataFrame:
    picked = [labelled.where(F.col("toxic") == k).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(11)), "id").limit(per_class) for k in (0, 1)]
    return picked[0].unionByName(picked[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, per_class: int = PER_CLASS, features: int = FEATURES) -> Machine:
    """A machine from the rows of ``labels`` that ``learn`` allows and their
    texts in ``docs``."""
    spark = docs.sparkSession
    allowed = labels if learn is None else labels.where(learn)
    labelled = allowed.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").distinct()
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    none = Machine(np.full(BUCKETS, -1, np.int32), float(np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 1.0))), np.zeros(0), np.zeros((0, FACTORS)))
    if not sizes.get(1) or not sizes.get(0):
        return none
    chosen = F.broadcast(_sample(labelled, per_class))  # at most 2 per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "id").select("id", "toxic", "text")

    every_bucket = np.arange(BUCKETS)

    def hashed(batches):
        for piece in packed(batches, 2, PIECE):
            row, bucket = features_of(piece.column(2), every_bucket)
            bounds = np.searchsorted(row, np.arange(len(piece) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))], ["id", "toxic", "buckets"])

    rows = texts.mapInArrow(hashed, f"id {docs.schema[id_col].dataType.simpleString()}, toxic int, buckets array<int>").persist()
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    found = rows.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum(F.col("toxic").cast("long")).alias("ones"), F.count("*").alias("all")).toPandas()
    if not n.get(1) or not n.get(0) or not len(found):
        rows.unpersist()
        return none
    found = found.sort_values("bucket", ignore_index=True)
    ones, every = found["ones"].to_numpy(float), found["all"].to_numpy(float)
    part = (every + 20) / (n[0] + n[1])
    telling = np.abs(ones / n[1] - (every - ones) / n[0]) / np.sqrt(part * np.maximum(1 - part, 0.1) * (1 / n[1] + 1 / n[0]))
    telling[every < 3] = 0
    best = np.argsort(-telling, kind="stable")[: features * 4 // 5]
    best = best[(telling[best] >= 3) | (np.arange(len(best)) < 64)]
    rest = np.setdiff1d(np.arange(len(every)), best)
    rest = rest[np.argsort(-every[rest], kind="stable")][: len(best) // 4]
    bucket = np.sort(found["bucket"].to_numpy()[np.concatenate((best, rest))])
    feature = np.full(BUCKETS, -1, np.int32)
    feature[bucket] = np.arange(len(bucket))
    wanted = spark.sparkContext.broadcast(feature)

    def narrowed(batches):
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            f = wanted.value[lists.flatten().to_numpy()]
            row, f = row[f >= 0], f[f >= 0]
            bounds = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.astype(np.int32)))], ["toxic", "features"])

    held = rows.orderBy("id", "toxic").select("toxic", "buckets").mapInArrow(narrowed, "toxic int, features array<int>").toArrow()
    rows.unpersist()
    wanted.unpersist()
    lists = held["features"].combine_chunks()
    labels_ = held["toxic"].to_numpy().astype(float)
    x = np.zeros((len(labels_), len(bucket)), np.float32)
    x[np.repeat(np.arange(len(labels_)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1.0
    bias, weights, factors = fitted(x, labels_)
    shift = np.log(sizes[1] / sizes[0]) - np.log(n[1] / n[0])
    return Machine(feature, bias + float(shift), weights, factors)


def score(df: DataFrame, machine: Machine, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        machine = shared.value
        for piece in packed(batches, len(keep), PIECE):
            got = machine.scores(piece.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], [*(f"k{i}" for i in range(len(keep))), "score", "predicted"])

    cut = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "".join(f"k{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = cut.mapInArrow(run, f"{kinds}score double, predicted int")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score", "predicted")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from the labels of folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    machine = train(docs, table(spark, sf_dir, "labels"), learn=fold != 0)
    return score(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), machine, keep=("doc_id", "held_out"))
