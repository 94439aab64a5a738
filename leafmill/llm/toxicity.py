"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training runs on a bounded sample of labelled documents (``FtrlSettings.max_training_rows``), dealt to
shards of bounded rows and characters that each run FTRL with per-coordinate learning rates and L1; the shards'
weights are averaged.
L1 keeps only a few thousand non-zero weights, and never more than ``2**bits``, so the model is small
enough to travel to every task. Scoring reads whole texts in one pass without a shuffle.

Cases: a null or empty text has no features and gets the score of the bias; without labelled rows every score
is that of the bias ``UNTAUGHT_BIAS`` (0.119); labels of one class alone drive the bias to it, and nearly all
scores with it; of several labels of one id the toxic one counts; a null label or id teaches nothing; repeated
rows are scored row by row; an empty table gives an empty result; very long texts are hashed in slices; columns
other than the id and the text are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import in_slices, ship_package
from leafmill.llm.wordhash import hash_words, mix

_CHUNK_BYTES = 1 << 20
UNTAUGHT_BIAS = -2.0
_SALTS = {name: np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)) for k, name in enumerate(("word", "pair", "skip1", "skip2"), 1)}


@dataclass(frozen=True)
class FtrlSettings:
    """Parameters of training; ``max_training_rows`` bounds the labelled sample."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    epochs: int = 4
    max_training_rows: int = 40_000
    rows_per_shard: int = 20_000
    chars_per_shard: int = 100_000_000


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights: sorted feature ids, their weights, and the bias."""

    bits: int
    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits, dtype=np.float32)
        table[self.ids] = self.weights
        return table


def text_features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of words, word pairs and pairs with one or two words skipped; and each id's text."""
    words, offsets = hash_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    ids, owners = [mix(words + _SALTS["word"])], [owner]
    for name, gap in (("pair", 1), ("skip1", 2), ("skip2", 3)):
        if len(words) > gap:
            same = owner[gap:] == owner[:-gap]
            joined = mix(words[:-gap] * np.uint64(3) + mix(words[gap:] + _SALTS[name]))
            ids.append(joined[same])
            owners.append(owner[gap:][same])
    return (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about _CHUNK_BYTES characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= _CHUNK_BYTES:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _distinct_features(bits: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lists: list[np.ndarray] = []
            for a, b in _chunks(texts):
                ids, owner = text_features(texts[a:b], bits)
                keys = np.unique(owner.astype(np.int64) << 32 | ids)
                cuts = np.searchsorted(keys >> 32, np.arange(b - a + 1))
                ids32 = (keys & 0xFFFFFFFF).astype(np.int32)
                lists += [ids32[cuts[k] : cuts[k + 1]] for k in range(b - a)]
            values = pa.array([x.tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("order"), batch.column("label"), values], names=["shard", "order", "label", "features"])

    return run


def _ftrl(settings: FtrlSettings):
    def run(rows: pa.Table) -> pa.Table:
        n_features = 1 << settings.bits
        z, n = np.zeros(n_features + 1), np.zeros(n_features + 1)
        column = rows.column("features")
        docs = [np.frombuffer(x.as_buffer(), np.int32) for x in column]  # views into the batch, no copies
        labels = rows.column("label").to_numpy()
        order = np.argsort(rows.column("order").to_numpy(), kind="stable")
        for _ in range(settings.epochs):
            for k in order:
                ids, y = np.append(docs[k], n_features), labels[k]
                w = _weights(z[ids], n[ids], settings)
                w[-1] = -z[n_features] / ((settings.beta + np.sqrt(n[n_features])) / settings.alpha)  # no penalty on the bias
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
                root = np.sqrt(n[ids])
                n[ids] += g * g
                z[ids] += g - (np.sqrt(n[ids]) - root) / settings.alpha * w
        w = _weights(z, n, settings)
        w[n_features] = -z[n_features] / ((settings.beta + np.sqrt(n[n_features])) / settings.alpha)
        kept = np.append(np.flatnonzero(w[:n_features]), n_features)
        return pa.table({"feature": kept, "weight": w[kept]})

    return run


def _weights(z: np.ndarray, n: np.ndarray, settings: FtrlSettings) -> np.ndarray:
    """FTRL-proximal closed form: zero inside the L1 ball, else a per-coordinate step."""
    shrunk = np.sign(z) * settings.l1 - z
    return np.where(np.abs(z) <= settings.l1, 0.0, shrunk / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2))


def train(docs: DataFrame, labels: DataFrame, settings: FtrlSettings = FtrlSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the labelled documents; give only rows that may be learnt from.

    At most ``max_training_rows`` labels take part, chosen by a hash of their id, so that the choice is
    the same in every run. Rows of a null label or a null id are no examples.
    """
    ship_package(docs.sparkSession)
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id").agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("id"))
        .orderBy("order", "id").limit(settings.max_training_rows)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    n_rows, n_chars = sample.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, round(n_rows / settings.rows_per_shard), math.ceil(n_chars / settings.chars_per_shard))
    rows = sample.select(F.pmod("order", F.lit(shards)).cast("int").alias("shard"), "order", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"), "text")
    features = rows.mapInArrow(in_slices(_distinct_features(settings.bits)), "shard int, order long, label double, features binary")
    fitted = features.groupBy("shard").applyInArrow(_ftrl(settings), "feature long, weight double")
    mean = fitted.groupBy("feature").agg((F.sum("weight") / F.lit(shards)).alias("weight")).toPandas().sort_values("feature")
    bias = float(mean.loc[mean["feature"] == 1 << settings.bits, "weight"].sum()) if len(mean) else UNTAUGHT_BIAS
    mean = mean[mean["feature"] < 1 << settings.bits]
    return ToxicityModel(settings.bits, mean["feature"].to_numpy(np.int64), mean["weight"].to_numpy(np.float32), bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``score`` in [0, 1] of the whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        table = model.dense()
        for batch in batches:
            margins = _margins(batch.column("text").to_pylist(), model, table)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(margins, -50, 50))))], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(in_slices(run), f"id {id_type}, score double").withColumnRenamed("id", id_col)


def _margins(texts: list[str | None], model: ToxicityModel, table: np.ndarray) -> np.ndarray:
    """Log-odds of whole texts: the bias and the weight of every distinct feature."""
    margins = np.full(len(texts), model.bias)
    for a, b in _chunks(texts):
        ids, owner = text_features(texts[a:b], model.bits)
        active = np.flatnonzero(table[ids])
        keys = np.unique(owner[active].astype(np.int64) << 32 | ids[active])
        margins[a:b] += np.bincount(keys >> 32, weights=table[keys & 0xFFFFFFFF], minlength=b - a)
    return margins


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    position = docs.columns.index(text_col)

    def run(batches):
        table = sent.value.dense()
        for batch in batches:
            margins = _margins(batch.column(position).to_pylist(), sent.value, table)
            yield batch.filter(pa.array(1.0 / (1.0 + np.exp(-np.clip(margins, -50, 50))) < threshold))

    return docs.mapInArrow(in_slices(run), docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: FtrlSettings = FtrlSettings()) -> DataFrame:
    """Scores of all documents by a model learnt from the documents that are not held out."""
    from leafmill.llm.session import held_out

    model = train(docs.where(~held_out()), labels.where(~held_out()), settings)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
