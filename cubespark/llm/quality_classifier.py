"""A factorisation machine that scores documents as labels.quality marks them.

A document is a sparse vector: its words, hashed into WORD_SLOTS weights of unit length together; structure statistics (letter
case, symbols, digits, word lengths, repetition, lines), each standardised; and its length class as metadata. The score is
the logistic function of bias + <w, x> + the sum over pairs <v_i, v_j> x_i x_j, whose pair part is worked out in linear time
as half of (sum of v_i x_i)^2 - sum of (v_i x_i)^2.

At most FIT_ROWS labelled rows, those of the smallest id hash, train it: their vectors are made in Spark, and one task runs
Adam over that bounded set. The model is WORD_SLOTS + STATS + SIZES rows of 1 + RANK numbers and goes to all tasks.

Cases: a null text is an empty one and is scored. Without labels, or with labels of one kind, every score is that share (0.5
without any). A row stands for itself; repeated rows repeat, a null id counts as not held out, an empty table gives an
empty result. A repeated label row trains once; where labels of an id disagree, the larger counts. Very long texts are read whole,
in memory of some 60 bytes a word. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import bounded_sample, held_out, keyed_texts, small_batches, with_long, word_hashes

FIT_ROWS = 8_000
WORD_SLOTS = 1 << 15
RANK = 8
STATS = 12
SIZES = 24
DIM = WORD_SLOTS + STATS + SIZES
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.02, 1e-5
THRESHOLD = 0.7

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@", np.uint8)
_STOP = np.frombuffer(b".,;:!?", np.uint8)


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features; the statistics are not standardised yet."""
    data = (text or "").encode("utf-8", "replace")
    h, start, end = word_hashes(data)
    slot, n = np.unique(h & np.uint64(WORD_SLOTS - 1), return_counts=True)
    value = np.sqrt(n)
    norm = np.sqrt((value**2).sum()) or 1.0
    raw = np.frombuffer(data, np.uint8)
    by = np.bincount(raw, minlength=256)
    size, count = max(1, len(raw)), max(1, len(h))
    lines = data.split(b"\n")
    length = end - start
    pairs = np.unique(h[:-1] ^ (h[1:] >> np.uint64(1))) if len(h) > 1 else h
    stats = (
        by[_UPPER].sum() / max(1, by[_UPPER].sum() + by[_LOWER].sum()), by[_SYMBOL].sum() / count, by[_DIGIT].sum() / size,
        by[_STOP].sum() / count, by[33] / count, by[124] / count, (length.mean() if len(h) else 0.0), (length.std() if len(h) else 0.0),
        len(slot) / count**0.8, len(pairs) / count, len(set(lines)) / len(lines), np.log1p(len(h)),
    )
    sizes = min(SIZES - 1, len(raw).bit_length())
    index = np.concatenate((slot.astype(np.int64), WORD_SLOTS + np.arange(STATS), [WORD_SLOTS + STATS + sizes]))
    return index, np.concatenate((value / norm, stats, [1.0])).astype(np.float32)


class Machine:
    """A fitted factorisation machine."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.bias, self.weight, self.factor, self.mean, self.scale = bias, weight, factor, mean, scale

    def standardise(self, value: np.ndarray, at: slice) -> np.ndarray:
        value = value.copy()
        value[at] = np.clip((value[at] - self.mean) / self.scale, -4, 4) / 4
        return value

    def score(self, text: str | None) -> float:
        index, value = vector(text)
        value = self.standardise(value, slice(len(index) - STATS - 1, len(index) - 1))
        vx = self.factor[index] * value[:, None]
        pair = 0.5 * float((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
        z = self.bias + float(self.weight[index] @ value) + pair
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=self.bias, weight=self.weight, factor=self.factor, mean=self.mean, scale=self.scale)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Machine:
        z = np.load(io.BytesIO(data))
        return Machine(float(z["bias"]), z["weight"], z["factor"], z["mean"], z["scale"])

    @staticmethod
    def constant(share: float) -> Machine:
        share = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(STATS, np.float32)
        return Machine(float(np.log(share / (1 - share))), np.zeros(DIM, np.float32), np.zeros((DIM, 1), np.float32), zero, zero + 1)


def train(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray) -> Machine:
    """Adam on the logistic loss, in a fixed order of batches."""
    if not len(label) or label.min() == label.max():
        return Machine.constant(float(label.mean()) if len(label) else 0.5)
    stats = np.array([v[-STATS - 1 : -1] for v in value])
    rng = np.random.default_rng(11)
    m = Machine(0.0, np.zeros(DIM), rng.normal(0, 0.02, (DIM, RANK)), stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    value = [m.standardise(v, slice(len(v) - STATS - 1, len(v) - 1)) for v in value]
    theta = np.column_stack((m.weight, m.factor))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    b = np.zeros(3)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            i, x = np.concatenate([index[k] for k in part]), np.concatenate([value[k] for k in part])
            begin = np.cumsum([0, *(len(index[k]) for k in part)])
            vx = theta[i, 1:] * x[:, None]
            total = np.add.reduceat(vx, begin[:-1])
            pair = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), begin[:-1]))
            z = b[0] + np.add.reduceat(theta[i, 0] * x, begin[:-1]) + pair
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
            e = np.repeat(error, np.diff(begin))
            grad = np.column_stack((e * x, (e * x)[:, None] * (np.repeat(total, np.diff(begin), axis=0) - vx)))
            used, place = np.unique(i, return_inverse=True)
            sums = np.column_stack([np.bincount(place, grad[:, k], len(used)) for k in range(RANK + 1)]) + DECAY * theta[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * sums
            second[used] = 0.99 * second[used] + 0.01 * sums**2
            size = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            theta[used] -= size * first[used] / (np.sqrt(second[used]) + 1e-8)
            g = error.sum()
            b[1], b[2] = 0.9 * b[1] + 0.1 * g, 0.99 * b[2] + 0.01 * g * g
            b[0] -= size * b[1] / (np.sqrt(b[2]) + 1e-8)
    m.bias, m.weight, m.factor = float(b[0]), theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32)
    m.mean, m.scale = m.mean.astype(np.float32), m.scale.astype(np.float32)
    return m


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [vector(text) for text in batch["text"]]
        frame = batch[["doc_id", "label"]].copy()
        frame["index"], frame["value"] = [i for i, _ in made], [v for _, v in made]
        yield frame


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if parts := list(batches):
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.assign(first=[tuple(v[:4]) for v in rows["value"]]).sort_values(["doc_id", "label", "first"], kind="stable")
        model = train([np.asarray(i) for i in rows["index"]], [np.asarray(v) for v in rows["value"]], rows["label"].to_numpy(float))
        yield pd.DataFrame({"model": [model.dump()]})


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """The machine of at most ``fit_rows`` rows of ``labels`` (doc_id, quality) and the texts of ``docs`` (doc_id, text); held-out ids
    are left out."""
    small_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = bounded_sample(known, "doc_id", fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    made = rows.mapInPandas(_vectors, "doc_id long, label int, index array<long>, value array<float>")
    model = made.repartition(1).mapInPandas(_train, "model binary").collect()  # fit_rows rows in the task, one row here
    return Machine.load(bytes(model[0].model)) if model else Machine.constant(0.5)


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine.dump())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Machine.load(shared.value)
        for batch in batches:
            score = np.array([model.score(text) for text in batch["text"]], float)
            yield batch[["doc_id", "held_out"]].assign(score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    rows = keyed_texts(docs, held_out(F.col("doc_id")).alias("held_out"))
    return with_long(rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int"), "doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
