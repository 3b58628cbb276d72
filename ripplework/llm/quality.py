"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

Statistics of a text are standardized with means and deviations over all documents; random
Fourier features then approximate a Gaussian kernel over them.  Each task sums the normal
equations of its labelled rows, and the sums meet ``GATHER`` at a time, level by level, until
one is left, so no task and not the driver ever holds more of these small matrices.  Ridge scores are calibrated by isotonic
regression on labelled rows that the ridge was not fitted on, over score bins.

Learning takes labels only of rows whose crc32(doc_id) mod 3 is not 1: remainder 0 fits the
ridge and 2 the calibration.

Defined cases: null text is empty text; null labels and labels of no document are ignored;
with no labels to learn from all scores are 0.5, and with one kind only that kind's rate;
repeated rows repeat results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, release
from .rules import labelled
from .stats import RATIOS, stat_table

FEATURES, GAMMA, RIDGE, SEED = 256, 0.05, 1.0, 42
#: Sums that meet in a task, and bins of scores for the calibration.
GATHER, BINS = 32, 1000


class Model:
    """Standardization, features, weights and calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        r = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.w = r.normal(0, np.sqrt(2 * GAMMA), (d, FEATURES))
        self.b = r.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.edges, self.values = np.zeros(1), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.values)


def isotonic(at: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins; places and never-falling rates."""
    blocks: list[list[float]] = []  # positives, rows, sum of places
    for x, p, n in zip(at, positives, counts):
        blocks.append([p, n, x * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _matrix(x: dict) -> np.ndarray:
    return np.array([x[c] for c in RATIOS], float).T.reshape(-1, len(RATIOS))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over ``rows`` (RATIOS and __quality), summed level by level."""
    size = FEATURES + 1

    def part(batches):
        total, any_ = np.zeros((size, size + 1)), False
        for batch in batches:
            x = batch.to_pydict()
            if x["__quality"]:
                f = model.features(_matrix(x))
                total += f.T @ np.hstack([f, np.array(x["__quality"], float)[:, None]])
                any_ = True
        from pyspark import TaskContext

        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], names=["i", "m"])

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy())
        cells = table.column("m")
        total = np.zeros(size * (size + 1))
        for k in order:
            total += np.frombuffer(cells[int(k)].as_py())
        return pa.table({"i": [int(table.column("g")[0].as_py())], "m": [total.tobytes()]})

    sums = materialize(rows.mapInArrow(part, "i long, m binary"), "sums")
    most = sums.agg(F.max("i")).first()[0]
    while most:
        less = materialize(sums.withColumn("g", F.expr(f"i div {GATHER}")).groupBy("g").applyInArrow(gather, "i long, m binary"), "sums")
        release(sums)
        sums, most = less, most // GATHER
    total = np.zeros((size, size + 1))
    for r in sums.collect():  # one row or none
        total += np.frombuffer(r["m"]).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    marks = stats.agg(*(f(c).alias(f"{t}_{c}") for c in RATIOS for t, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    model = Model(*(np.array([marks[f"{t}_{c}"] or 0.0 for c in RATIOS]) for t in "ms"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    known = labelled(stats, labels.where(fold != 1)).select(*RATIOS, F.when(F.col("__quality") > 0, 1.0).otherwise(0.0).alias("__quality"), fold.alias("__fold"))
    xx, xy = normal_equations(known.where("__fold = 0").select(*RATIOS, "__quality"), model)
    if xx[-1, -1] == 0:
        return model
    model.beta = np.linalg.solve(xx + RIDGE * np.eye(len(xx)), xy)

    def raw(batches):
        for batch in batches:
            x = batch.to_pydict()
            if x["__quality"]:
                place = np.clip(np.round(model.raw(_matrix(x)) * BINS / 2), -BINS, 2 * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(x["__quality"], pa.float64())], names=["place", "y"])

    bins = known.where("__fold = 2").select(*RATIOS, "__quality").mapInArrow(raw, "place long, y double").groupBy("place").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    rows = sorted(bins.collect(), key=lambda r: r["place"])  # at most 3 * BINS rows
    if rows:
        model.edges, model.values = isotonic(np.array([r["place"] for r in rows]) * 2.0 / BINS, np.array([r["p"] for r in rows]), np.array([r["n"] for r in rows], float))
    else:
        model.edges, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = materialize(stat_table(docs).select("doc_id", *RATIOS), "stats")
    model = fit(stats, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))

    def make():
        def step(x: dict) -> dict:
            s = model.score(_matrix(x))
            return {"doc_id": x["doc_id"], "held_out": x["held_out"], "score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}

        return step

    return map_rows(stats.withColumn("held_out", held), make, "doc_id long, held_out boolean, score double, predicted int")
