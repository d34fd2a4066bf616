"""Text quality by naive Bayes support vectors.

A document's features are indicators of n-grams: words, word pairs, and runs of one to three word shapes (case,
punctuation, digits, length, repetition of the word before), hashed to ``DIM`` columns, with the shares of a few
shapes in steps. Class log-count ratios scale the indicators, and a linear hinge-loss model is fitted to them by
dual coordinate descent.

The fit uses at most ``max_rows`` labelled rows, those whose hash of doc_id is lowest, with all their features, of
which there are ``DIM`` at most; it runs in one task of that bounded size. Ratios and weights have ``DIM`` entries at
any size of the corpus. Scoring reads every whole text once and shuffles nothing.

Defined results. Null and empty texts have no n-grams and get the score of that. Labels that contradict each other
for a doc_id count as the lower, and of texts that share a doc_id the least teaches; null labels, and labels without
a document, teach nothing. Repeated rows are each
scored. If no row or one class only can be learned from, scores are that class's (0.5 without rows). An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import written

DIM = 1 << 18
MAX_ROWS = 12_000
_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 0 if b in (9, 10, 11, 12, 13, 32) else 4 for b in range(256)], np.uint8)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature columns of each row."""
    starts, ends, rows = tk.words(data, offsets, tk.NOT_SPACE)
    if not len(starts):
        return [np.zeros(0, np.int32)] * (len(offsets) - 1)
    h = tk.word_hashes(tk.LOWER[data], starts, ends)
    kinds = _CLASS[data]
    count = []
    for kind in (1, 2, 3, 4):
        total = np.concatenate([[0], np.cumsum(kinds == kind)])
        count.append(total[ends] - total[starts])
    upper, lower, digits, marks = count
    last = data[ends - 1]
    repeated = np.concatenate([[False], h[1:] == h[:-1]])
    case = np.where(upper == 0, 0, np.where(lower > 0, np.where(_CLASS[data[starts]] == 1, np.where(upper == 1, 1, 2), 2), 3))
    shape = (((case * 4 + np.minimum(marks, 3)) * 2 + (digits > 0)) * 2 + repeated) * 8 + np.minimum(np.log2(ends - starts).astype(np.int64), 5)
    shape = tk.mix((shape * 256 + np.where(_CLASS[last] == 4, last, 0)).astype(np.uint64) + np.uint64(1 << 40))
    grams = [h, tk.pairs(h), shape, tk.pairs(shape), tk.runs(shape, 3)]
    columns = [(tk.mix(g ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - 18)).astype(np.int32) for k, g in enumerate(grams)]
    shares = [np.concatenate([[0], np.cumsum(x)]) for x in (repeated, (case == 3) & (ends - starts > 1), marks >= 2, (marks > 0) & (upper + lower + digits == 0), digits > 0, ends - starts > 20)]
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if a == b:
            out.append(np.zeros(0, np.int32))
            continue
        own = [c[a : max(a, b - w)] for c, w in zip(columns, (0, 1, 0, 1, 2), strict=True)]
        steps = [tk.mix_int((k + 7) * 1000 + int(round(8 * (s[b] - s[a]) / (b - a)))) % DIM for k, s in enumerate(shares)]
        out.append(np.unique(np.concatenate([*own, np.array(steps, np.int32)])))
    return out


def packed(columns: np.ndarray) -> bytes:
    """Sorted distinct columns as they are or, where that is shorter, as a bit for each of DIM: never more than DIM / 8 bytes."""
    if 32 * len(columns) <= DIM:
        return columns.astype("<i4").tobytes()
    bits = np.zeros(DIM, bool)
    bits[columns] = True
    return b"b" + np.packbits(bits).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == DIM // 8 + 1:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1))).astype(np.int32)
    return np.frombuffer(raw, "<i4")


class Rows:
    """Feature rows to learn from, packed until they are looked at: long texts take no more memory than their bits."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, k: int) -> np.ndarray:
        return unpacked(self.raw[k])

    def __iter__(self):
        return map(unpacked, self.raw)


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = (np.full(DIM, smooth) for _ in range(2))
    for x, y in zip(rows, positive, strict=True):
        (p if y else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, values: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss; row i has values[rows[i]] scaled to length 1, and a constant 1.

    A weight is only ever used times its column's value, so that product is what is kept, and no scaled copy of the rows.
    """
    product, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    squares = values * values
    scale = np.array([1 / max(1e-9, np.sqrt(squares[r].sum())) for r in rows])
    share = max(1e-9, (y > 0).mean()), max(1e-9, (y < 0).mean())
    most = np.where(y > 0, c * min(1.0, share[1] / share[0]) ** 0.5, c * min(1.0, share[0] / share[1]) ** 0.5)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (product[rows[i]].sum() * scale[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), most[i])  # the row's squared length is 2 with the constant
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                product[rows[i]] += step * scale[i] * squares[rows[i]]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return product, bias


def _featurise(batches):
    for batch in batches:
        for lo, hi, data, offsets in tk.chunks(batch.column("text")):
            rows = features(data, offsets)
            yield pa.record_batch([batch.column("label").slice(lo, hi - lo), pa.array(list(map(packed, rows)), pa.binary())], ["label", "columns"])


def sample_labels(labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, label) of at most max_rows rows to learn from."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.filter(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    n, span = own.count(), 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    # Little more than max_rows rows are put in order.
    return own.filter(place < int(span * min(1.0, 1.1 * max_rows / max(n, 1)))).orderBy(place, "doc_id").limit(max_rows)


class Model:
    def __init__(self, values: np.ndarray, bias: float, scale: np.ndarray, steep: float = 3.0):
        self.values, self.bias, self.scale, self.steep = values.astype(np.float32), bias, scale.astype(np.float32), steep

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for k, r in enumerate(rows):
            length = np.sqrt(float(np.square(self.scale[r], dtype=np.float64).sum()))
            out[k] = float(self.values[r].sum(dtype=np.float64)) / max(1e-9, length) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.steep * out, -30, 30)))


def learn(rows: list[np.ndarray] | Rows, positive: np.ndarray) -> Model:
    """A model from feature rows and whether their label is 1, whatever order they come in."""
    def place(k: int):
        row = rows[k]
        return bool(positive[k]), len(row), hashlib.blake2b(row, digest_size=16).digest()

    order = sorted(range(len(rows)), key=place)
    rows, positive = Rows([rows.raw[k] for k in order]) if isinstance(rows, Rows) else [rows[k] for k in order], positive[order]
    if not len(rows) or positive.all() or not positive.any():
        known = 0.0 if not len(rows) else 10.0 if positive.all() else -10.0
        return Model(np.zeros(DIM), known, np.ones(DIM))
    ratios = log_count_ratios(rows, positive)
    weights, bias = dual_coordinate_descent(rows, np.where(positive, 1.0, -1.0), ratios)
    return Model(weights, bias, ratios)


def _learn(batches):
    rows, labels = [], []
    for batch in batches:
        rows += batch.column("columns").to_pylist()
        labels += batch.column("label").to_pylist()
    model = learn(Rows(rows), np.array(labels, np.int64) == 1)
    yield pa.record_batch([pa.array([model.values.tobytes()]), pa.array([float(model.bias)]), pa.array([model.scale.tobytes()])], ["values", "bias", "scale"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    # The sample is bounded by max_rows, so that it may be broadcast: only its documents' texts are read on.
    chosen = F.broadcast(sample_labels(labels, label, max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    taught = written(texts.select("text", "label").mapInArrow(_featurise, "label int, columns binary"), "taught")
    found = taught.coalesce(1).mapInArrow(_learn, "values binary, bias double, scale binary").first()
    if found is None:
        return learn([], np.zeros(0, bool))
    return Model(np.frombuffer(found["values"], np.float32), found["bias"], np.frombuffer(found["scale"], np.float32))


def _predict(model, keep: list[str], into: str):
    def run(batches):
        m = model.value
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(m.scores(features(data, offsets)))], [*keep, into])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """The columns of keep and, in the column into, the estimate that the label is 1, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))
    texts = docs.select(*columns).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.mapInArrow(_predict(shared, list(keep), into), f"{schema}, {into} double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least that, with all their columns."""
    return score(docs, model, tuple(docs.columns), "__svm_score").filter(F.col("__svm_score") >= least).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    scored = score(docs, fit(docs, labels, label))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
