"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 6).

A document's features are the distinct buckets of its words, their stems (the
first few bytes), word pairs and pairs with one word between. Training reads a bounded sample of labelled rows
(``MAX_TRAIN_ROWS``, by hash of the id); feature extraction is spread over the
cluster and one task runs the per-coordinate updates in the sample's order. It
holds 4 bytes for each distinct feature of a row (``2 ** BITS`` a row at most).
L1 leaves few weights, which are broadcast. Scoring reads every whole text where
it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm import textnum
from scrubjay.llm.common import fold, in_share, written

BITS = 20
#: Bytes of the stems.
STEMS = (4, 5, 6)
#: Labelled rows that training reads at most (the documented bound of the fit).
MAX_TRAIN_ROWS = 20_000
EPOCHS = 2
#: Per-coordinate rate, its offset, and the L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray, a: int, b: int):
    """(bucket, document) of every word, stem, pair and skip-pair of documents a to b, repeats included."""
    word, count, *stems = textnum.words(data, offsets, a, b, textnum.ALNUM, STEMS)
    doc = np.repeat(np.arange(b - a), count)
    shift = np.uint64(64 - BITS)
    each = [(textnum.mix(word), doc), *((textnum.mix(h + np.uint64(k)), doc) for k, h in zip(STEMS, stems, strict=True))]
    for h, d in (*each, textnum.pairs(word, count, 1), textnum.pairs(word, count, 2)):
        yield (h >> shift).astype(np.int64), d


def _features(batches):
    """The sorted distinct buckets of each text, the bias last."""
    for batch in batches:
        for block in textnum.blocks(batch, 2):
            data, offsets = textnum.text_buffers(block.column(2))
            both = np.unique(np.concatenate([d << BITS | f for f, d in _grams(data, offsets, 0, block.num_rows)]))
            cut = np.searchsorted(both, np.arange(block.num_rows + 1) << BITS)
            low = (both & ((1 << BITS) - 1)).astype("<i4")
            out = [np.append(low[x:y], np.int32(1 << BITS)).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([block.column(0), block.column(1), pa.array(out, pa.binary())], names=["key", "label", "features"])


class Ftrl:
    """FTRL-proximal state: one accumulated gradient and one squared sum per coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _train(batches):
    """Updates in the order of the rows, epoch after epoch; the sample is held as plain integers."""
    parts, sizes, labels = [], [], []
    for batch in batches:
        data, offsets = _binary(batch.column("features"))
        parts.append(data[offsets[0]:offsets[-1]].copy())
        sizes.append(np.diff(offsets))
        labels += batch.column("label").to_pylist()
    model = Ftrl((1 << BITS) + 1)
    for _ in range(EPOCHS):
        row = iter(labels)
        for part, size in zip(parts, sizes, strict=True):
            end = 0
            for n in size.tolist():
                begin, end = end, end + n
                model.learn(part[begin:end], next(row))
    del parts
    w = model.weights(slice(None))
    kept = np.flatnonzero(w)
    yield pa.record_batch([pa.array(kept, pa.int64()), pa.array(w[kept])], names=["bucket", "weight"])


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of little-endian 32-bit integers as (all integers, offsets), without copies."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) // 4
    return np.frombuffer(data, "<i4") if data is not None else np.empty(0, "<i4"), at


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Weights from labelled rows whose id's crc32 leaves no remainder 1 modulo 3.

    Rows without id or label do not teach; an id labelled twice counts as
    toxic if one of its labels is. Without any labelled row all weights are 0.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    ids = docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id").distinct().join(known, "doc_id")
    ids = written(ids.withColumn("key", F.md5(F.col("doc_id").cast("string"))), "labelled")
    few = ids.where(in_share(F.col("key"), max_rows, ids.count()))
    sample = written(few.orderBy("key").limit(max_rows), "sample")  # at most max_rows short rows: broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # of several texts under one id the one with the smallest md5 teaches
    text = F.coalesce("text", F.lit(""))
    rows = rows.groupBy("key", F.col("label").cast("int").alias("label")).agg(F.min_by(text, F.md5(text)).alias("text"))
    features = rows.mapInArrow(_features, "key string, label int, features binary")
    w = features.repartition(1).sortWithinPartitions("key").mapInArrow(_train, "bucket long, weight double").toPandas()
    w = w.sort_values("bucket")
    bias = w.weight[w.bucket == 1 << BITS].sum()
    w = w[w.bucket < 1 << BITS]
    return Model(float(bias), w.bucket.to_numpy(np.int64), w.weight.to_numpy(float))


def _scorer(model: Model):
    table = np.zeros(1 << BITS, np.float32)
    table[model.buckets] = model.weights

    def scores(column: pa.Array) -> np.ndarray:
        data, offsets = textnum.text_buffers(column)
        out = np.full(len(column), model.bias)
        for a, b in textnum.chunks(offsets):
            hits = []
            for f, d in _grams(data, offsets, a, b):
                at = np.flatnonzero(table[f])  # weights are sparse: few grams are looked at again
                hits.append(d[at] << BITS | f[at])
            both = np.unique(np.concatenate(hits))
            out[a:b] += np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], b - a)
        return _sigmoid(out)

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, whole texts.

    Null and empty texts score the bias alone; repeated rows and null ids are
    scored like others; an empty table gives an empty result; other columns
    are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _scorer(sent.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1)))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more.

    Rows are scored as by ``score``, null and empty texts and repeated rows
    too; an empty table stays empty. Only the text goes to Python.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _scorer(sent.value)
        for text in texts:
            yield pa.array(scores(text))

    scored = F.arrow_udf(run, "double")
    return docs.where(scored(F.col(f"`{text_col}`").cast("string")) < threshold)
