"""Quality: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics in ``stats.NAMES``; the covariance is shrunk,
S = (1 - a - b) * S_class + a * S_pooled + b * tr(S_pooled) / d * I, and its Cholesky factor is kept in the
model. A text's score is the logistic function of the difference of the two log densities (Mahalanobis
distances from triangular solves, and log determinants) divided by ``temper`` and added to the log odds of
the classes.

All labelled rows are learned from: counts, sums and sums of products of each class are added up in the
cluster, and a few rows of a fixed size reach the driver.

Nulls: a null or wordless text has zeros for statistics and is scored like any other; null labels or keys
are not learned from. A key with contradicting labels counts as label 1. With fewer than two texts of a
class all scores are the share of label 1. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantry.llm import stats
from pantry.llm import text as T
from pantry.llm.shared import kept
from pantry.llm.toxicity import labelled


@dataclass
class Model:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    log_dets: list[float]
    log_odds: float
    temper: float


def solve(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled_share: float = 0.2, ridge: float = 0.002, temper: float = 1.0) -> Model | None:
    """moments: of each class the number of texts, the sum of their rows and the sum of the rows' outer products."""
    if any(y not in moments or moments[y][0] < 2 for y in (0, 1)):
        return None
    means, covariances = [], []
    for y in (0, 1):
        n, total, outer = moments[y]
        means.append(total / n)
        covariances.append(outer / n - np.outer(means[-1], means[-1]))
    n0, n1 = moments[0][0], moments[1][0]
    pooled = (n0 * covariances[0] + n1 * covariances[1]) / (n0 + n1)
    d = len(pooled)
    small = ridge * np.trace(pooled) / d * np.eye(d) + 1e-9 * np.eye(d)
    factors, log_dets = [], []
    for c in covariances:
        low = np.linalg.cholesky((1 - pooled_share - ridge) * c + pooled_share * pooled + small)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Model(means, factors, log_dets, float(np.log(n1 / n0)), temper)


def score(model: Model, rows: np.ndarray) -> np.ndarray:
    density = [-0.5 * (((rows - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(model.means, model.factors, model.log_dets)]
    z = (density[1] - density[0]) / model.temper + model.log_odds
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row): each text's statistics as doubles in a binary value, written once; texts go no further than this scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                x = stats.transformed(*T.view(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("key"), T.blobs(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], ["key", "row"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return kept(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, row binary"), "statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, key: str = "doc_id", **shrinkage: float) -> tuple[Model | None, float]:
    """measured: as ``statistics`` gives it. The model, and the share of label 1 among the texts learned from. All labelled rows count."""
    rows = measured.join(labelled(labels, label, learn, key), "key").select("row", "y")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(stats.NAMES)
        count, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("row")), batch.column("y").to_numpy()
                for c in (0, 1):
                    own = x[y == c]
                    count[c] += len(own)
                    total[c] += own.sum(0)
                    outer[c] += own.T @ own
        if count.any():
            yield pa.RecordBatch.from_pydict({"y": [0, 1], "n": count.tolist(), "total": total.tolist(), "outer_sum": outer.reshape(2, -1).tolist()})

    d = len(stats.NAMES)
    partial = rows.mapInArrow(gather, "y long, n double, total array<double>, outer_sum array<double>")
    flat = partial.groupBy("y").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(d)], *[F.sum(F.col("outer_sum")[i]).alias(f"o{i}") for i in range(d * d)])
    moments = {r["y"]: (r["n"], np.array(r[2 : 2 + d], float), np.array(r[2 + d :], float).reshape(d, d)) for r in flat.collect()}
    n0, n1 = (moments.get(y, (0.0,))[0] for y in (0, 1))
    return solve(moments, **shrinkage), float(n1 / (n0 + n1)) if n0 + n1 else 0.0


def scored(measured: DataFrame, model: Model | None, share: float, name: str = "score") -> DataFrame:
    """(key, score) of each row of ``statistics``."""
    if model is None:
        return measured.select("key", F.lit(float(share)).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score(model, _matrix(batch.column("row"))))], ["key", name])

    return measured.mapInArrow(run, f"key {measured.schema['key'].dataType.simpleString()}, {name} double")
