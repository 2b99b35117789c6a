"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words and pairs of words, and the shapes of words and pairs of shapes (letter case, digits, the
symbols a word carries, whether it repeats the word before), all hashed into one table. A text's score is a sparse dot
product of its feature shares with the weights. Shares, not counts, make long and short texts comparable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import free_name, one_in, only, with_fields
from tidepost.llm.words import IS_SPACE, constants, mixed, pieces, summed, text_bytes, word_hashes, word_starts
from tidepost.session import written


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the labelled rows that train (chosen by a hash of the id, about so many); ``shards`` are trained
    apart and averaged; the other fields are those of the updates."""

    bits: int = 18
    sample: int = 8192
    shards: int = 4
    epochs: int = 4
    rate: float = 0.5
    smooth: float = 0.1
    l1: float = 0.001
    l2: float = 0.0001
    seed: int = 7


#: A text's feature shares are multiplied by this, so that updates move the weights at a useful pace.
SCALE = 16.0
_BYTE = np.arange(256)
_UPPER = ((_BYTE >= 65) & (_BYTE <= 90)).astype(np.int64)
_DIGIT = ((_BYTE >= 48) & (_BYTE <= 57)).astype(np.int64)
_LETTER = (((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128)).astype(np.int64)
_SYMBOL = np.where((_LETTER + _DIGIT == 0) & ~IS_SPACE, constants(11, 256), np.uint64(0))
_KIND = constants(12, 8)


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts of a piece, text by text, and where each text's begin."""
    starts, bounds = word_starts(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    words = word_hashes(data, starts)
    tail = data[starts[0] :]
    begin = starts - starts[0]
    upper, digits, letters = (np.minimum(summed(t[tail], begin), 2) for t in (_UPPER, _DIGIT, _LETTER))
    shape = mixed(summed(_SYMBOL[tail], begin) + (upper * 9 + digits * 3 + letters).astype(np.uint64) * _KIND[0])
    follows = np.ones(len(words), bool)
    follows[bounds[:-1][bounds[:-1] < len(words)]] = False
    same = follows.copy()
    same[1:] &= words[1:] == words[:-1]
    same &= follows
    shape = np.where(same, _KIND[1], shape)
    out = np.zeros((len(words), 4), np.uint64)
    out[:, 0] = words * _KIND[2]
    out[:, 1] = shape * _KIND[3]
    # The first word of a text has no word before it: its pairs are with the text's beginning.
    for column, values, kind in ((2, words, 4), (3, shape, 5)):
        before = np.where(follows, np.concatenate([[np.uint64(0)], values[:-1]]), np.uint64(1))
        out[:, column] = np.where(same, _KIND[kind + 2], before * _KIND[kind] + values * _KIND[3])
    number = (mixed(out) >> np.uint64(64 - bits)).astype(np.int64)
    return number.ravel(), bounds * 4


def train(numbers: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, how: Training) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates, one row after the other. The last weight is the constant."""
    size = (1 << how.bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    positive = max(1, int(labels.sum()))
    heavy = {1: len(labels) / (2 * positive), 0: len(labels) / (2 * max(1, len(labels) - positive))}
    order = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for row in order.permutation(len(labels)):
            i, x, y = numbers[row], shares[row], labels[row]
            p = 1 / (1 + np.exp(-np.clip(w[i] @ x, -30, 30)))
            g = (p - y) * x * min(heavy[int(y)], 4.0)
            step = n[i] + g * g
            z[i] += g - (np.sqrt(step) - np.sqrt(n[i])) / how.rate * w[i]
            n[i] = step
            over = np.abs(z[i]) > how.l1
            w[i] = np.where(over, (np.sign(z[i]) * how.l1 - z[i]) / ((how.smooth + np.sqrt(step)) / how.rate + how.l2), 0)
    return w


def sparse(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, shares) of each text, the constant last."""
    for data, at in pieces(*text_bytes(column)):
        number, bounds = features(data, at, bits)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            i, c = np.unique(number[a:b], return_counts=True)
            yield np.append(i, 1 << bits), np.append(c / max(1, b - a) * SCALE, 1.0)


def fit(labelled: DataFrame, how: Training) -> np.ndarray:
    """Weights from ``labelled`` (key long, text, label 0 or 1): about ``how.sample`` rows in ``how.shards`` groups of bounded
    size, each trained in a task; the shards' weights are averaged by Spark. No labelled row gives weights of 0."""
    dealt = labelled.withColumn("shard", F.pmod(F.xxhash64(F.col("key"), F.lit(3)), F.lit(how.shards)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "text"], ignore_index=True)
        numbers, shares = zip(*sparse(pa.array(rows["text"], pa.string()), how.bits), strict=True)
        w = train(list(numbers), list(shares), rows["label"].to_numpy(float), how)
        used = np.flatnonzero(w)
        return pd.DataFrame({"number": used, "weight": w[used]})

    trained = dealt.groupBy("shard").applyInPandas(one, "number long, weight double")
    summed_up = trained.groupBy("number").agg(F.sum("weight").alias("weight")).collect()  # at most 2**bits + 1 rows
    weights = np.zeros((1 << how.bits) + 1)
    for number, weight in summed_up:
        weights[number] = weight / how.shards
    return weights


def scored(docs: DataFrame, weights: np.ndarray, how: Training, text: str, score: str) -> DataFrame:
    """``docs`` and the score of each whole text: a sparse dot product in one pass over the words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2**bits weights, whatever the input
    bits = how.bits
    schema = with_fields(docs, **{score: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for data, at in pieces(*text_bytes(batch.column(batch.schema.get_field_index(text)))):
                number, bounds = features(data, at, bits)
                sums = np.concatenate([[0.0], np.cumsum(w[number])])
                count = np.maximum(1, np.diff(bounds))
                dot = w[-1] + SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / count
                parts.append(1 / (1 + np.exp(-np.clip(dot, -30, 30))))
            arrays = [*batch.columns, pa.array(np.concatenate(parts), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, score])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the rows that never train: the CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, how: Training, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of about ``how.sample`` labelled documents that are not held out.

    Labels of an id that occurs with both values, or with none, are left out. An id is one row, however many rows of
    ``docs`` have it: the text with the lowest hash.
    """
    known = (
        only(labels, doc_id="doc_id", quality="quality")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter(F.col("label") == F.col("other"))
        .select("doc_id", "label")
    )
    known = written(known, "labels")
    chosen = known.filter(one_in(F.xxhash64("doc_id"), known.count(), how.sample))
    return (
        only(docs, doc_id=doc_id, text=text)
        .join(chosen, "doc_id")
        .select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "label")
        .groupBy("key", "label")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("key", "text", "label")
    )


def score_documents(
    docs: DataFrame, labels: DataFrame, how: Training | None = None, text: str = "text", score: str = "score"
) -> DataFrame:
    """All columns of ``docs`` and a score from 0 to 1, higher where quality is likelier to be 1.

    Null and empty texts are scored by the constant alone; without any label every score is 0.5. Repeated rows stay
    repeated and score alike. A column that is already called ``score`` is kept; the new one has an underscore in front.
    """
    how = how or Training()
    weights = fit(labelled_sample(docs, labels, how, text=text), how)
    return scored(docs, weights, how, text, free_name(docs, score))
