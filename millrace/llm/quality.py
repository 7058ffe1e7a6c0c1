"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

A few statistics of each text are scaled by the training rows' mean and deviation; random Fourier features approximate a
Gaussian kernel over them. The normal equations are sums over rows, so each partition adds up its own and the driver adds a
bounded number of such sums. Ridge scores of training rows that took no part in them give the isotonic curve from score to
chance.

Labels come from a hash sample of at most about MAX_TRAIN labelled rows outside the held-out fold; the model reads the texts of
these alone, one row an id (of repeated ids the one with the least statistics). Then each document is read once, for its statistics and
score. Training rows are added up in order of id and scores worked out in blocks of one shape, so reruns agree to the last bit. Null texts count as empty, and empty texts get a score as any other. Documents with a null id are never held
out. Repeated rows get equal scores. Without labels of both kinds every score is the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged
from .learning import held_out, isotonic, training_labels

#: Labelled rows that fit and calibrate the model, at most (about).
MAX_TRAIN = 80_000
#: Partitions of the training rows, so sums that come to the driver at once.
TRAIN_PARTS = 16
FEATURES, RIDGE, SEED = 384, 1.0, 20240
#: Rows scored at once.
BLOCK = 1_024

#: Classes of bytes by which a text's bytes are counted.
_CLASS = np.full(256, 7, dtype=np.int64)  # control characters
for _c, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,;:?'\"-()")):
    _CLASS[list(_chars)] = _c
_CLASS[[i for i in range(33, 127) if _CLASS[i] == 7]] = 6  # other signs
_CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """Numbers that describe a text, none of them of its language or source."""
    data = text.encode()
    size = len(data)
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * 20
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) / size
    kinds = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = sum(1 for w, k in kinds.items() for _ in range(k) if len(w) > 1 and w.isupper()) / n if counts[1] > 0.02 else 0.0
    top = kinds.most_common(1)[0][1] / n
    same = sum(a == b for a, b in pairwise(words)) / n
    spread = -sum(k * np.log(k) for k in kinds.values() if k > 1) / n + np.log(n)
    signs = sum(k for w, k in kinds.items() if not w.isalnum() and w[-1:] not in b".,;:?'\")-" and w.isascii()) / n
    stop = sum(w.count(b".") + w.count(b"?") for w in lines) / n
    return [np.log1p(n), *counts.tolist(), lengths.mean(), lengths.std(), len(kinds) / n, top, same, spread / np.log(n + 1), upper, signs, len(set(lines)) / len(lines), min(stop, 1.0)]


def document_statistics(rows: DataFrame) -> DataFrame:
    """The columns of rows, with stats in place of text (null as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.float32()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], stats], [*names, "stats"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_arrow(rows, run, f"{kinds}, stats array<float>")


class Model:
    """Maps statistics to chances of label 1."""

    def __init__(self, prior: float) -> None:
        self.prior, self.weights = prior, None

    def scale(self, n: float, total: np.ndarray, squares: np.ndarray) -> None:
        self.mean = total / n
        self.deviation = np.sqrt(np.maximum(squares / n - self.mean**2, 1e-6))
        rng, d = np.random.default_rng(SEED), len(total)
        self.directions = rng.normal(scale=1 / np.sqrt(d), size=(d, FEATURES))  # kernel width: the root of the dimension
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES), z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Worked out in blocks of one shape, as a product's last bits turn with its shape: a row's score doesn't depend on its batch."""
        out = np.empty(len(stats))
        for at in range(0, len(stats), BLOCK):
            mine = stats[at : at + BLOCK]
            block = np.zeros((BLOCK, stats.shape[1]))
            block[: len(mine)] = mine
            out[at : at + BLOCK] = np.einsum("ij,j->i", self.features(block), self.weights)[: len(mine)]
        return out

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.raw(stats), self.knots, self.chances), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, of) -> np.ndarray | None:
    """The sum over partitions of what `of` makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = None
    for row in map_arrow(rows, run, "sums binary").collect():  # TRAIN_PARTS rows, in order of the partitions
        part = np.frombuffer(row["sums"])
        total = part if total is None else total + part
    return total


def fit(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, from the labelled rows of docs alone."""
    chosen = training_labels(labels, label_col, folds, fold, MAX_TRAIN, id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = document_statistics(base.join(F.broadcast(chosen), "doc_id"))  # chosen has about MAX_TRAIN rows at most
    rows = rows.groupBy("doc_id", "label", "part").agg(F.min("stats").alias("stats"))  # one row an id, however often it comes
    rows = staged(rows.repartition(TRAIN_PARTS, "doc_id").sortWithinPartitions("doc_id", "stats"), "quality-train")
    ones = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(ones.get(1, 0) / sum(ones.values()) if ones else 0.5)
    fitting, calibration = rows.where("part < 75"), rows.where("part >= 75")
    if len(ones) < 2 or calibration.limit(1).count() == 0:
        return model

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    sums = _sums(fitting, moments)
    if sums is None:
        return model
    d = (len(sums) - 1) // 2
    model.scale(sums[0], sums[1 : 1 + d], sums[1 + d :])

    def normal_equations(batch: pa.RecordBatch) -> np.ndarray:
        a, y = model.features(_matrix(batch)), np.array(batch.column("label").to_pylist(), dtype=np.float64)
        return np.concatenate([(a.T @ a).ravel(), a.T @ y])

    sums = _sums(fitting, normal_equations)
    k = FEATURES + d + 1
    model.weights = np.linalg.solve(sums[: k * k].reshape(k, k) + RIDGE * np.eye(k), sums[k * k :])
    held = calibration.select("stats", "label").toArrow()  # a part of the MAX_TRAIN ids
    raw = model.raw(np.array(held.column("stats").to_pylist(), dtype=np.float64))
    model.knots, model.chances = isotonic(raw, np.array(held.column("label").to_pylist()))
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    model = fit(docs, labels, label_col, folds, fold, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array([statistics(t.as_py() or "") for t in batch.column("text")], dtype=np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = map_arrow(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not rejected. Texts are scored where they are, so no text is moved."""
    model = fit(docs, labels, label_col, folds, fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = model.score(np.array([statistics(t.as_py() or "") for t in batch.column("text")], dtype=np.float32)) >= threshold
                yield batch.filter(pa.array(good))

    return map_arrow(docs, run, docs.schema)
