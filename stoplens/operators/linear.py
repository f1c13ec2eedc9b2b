"""One-vs-rest linear SVM with squared hinge loss, all classes in one pass over the data per step.

Minimises half the squared length of each class's weights (the constant term included) plus c times the weighted squared
hinge losses, by L-BFGS over the sum of the classes' objectives. Each evaluation is one Spark job: tasks turn their
rows into sums per class and slot, Spark adds these up, and the driver holds classes x slots numbers (at most 2^17 slots).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048
MEMORY = 8


def margins(weights: np.ndarray, places: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(classes, rows) of rows whose entries are places[offsets[i]:offsets[i + 1]]; the last slot is the constant term."""
    out = np.repeat(weights[:, -1:], len(offsets) - 1, axis=1)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[:, filled] += np.add.reduceat(weights[:, places] * values, offsets[filled], axis=1)
    return out


def pieces(batch: pa.RecordBatch):
    """(places, values, offsets, first row) of a few rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        rows = part.column(0)
        offsets = rows.offsets.to_numpy()
        entries = rows.values.slice(offsets[0], offsets[-1] - offsets[0])
        yield entries.field(0).to_numpy(), entries.field(1).to_numpy(), offsets - offsets[0], part


def slope_task(held):
    """For mapInArrow: rows (class, slot, value) of the loss's slope over the task; the loss itself under slot -1."""
    def run(batches):
        weights = held.value
        n_classes, size = weights.shape
        slope, loss = np.zeros((n_classes, size)), np.zeros(n_classes)
        for batch in batches:
            for places, values, offsets, part in pieces(batch):
                own, weight = part.column(1).to_numpy(), part.column(2).to_numpy()
                sign = np.where(own[None, :] == np.arange(n_classes)[:, None], 1.0, -1.0)
                short = np.maximum(1 - sign * margins(weights, places, values, offsets), 0)
                loss += (weight * short * short).sum(axis=1)
                pull = -2 * weight * sign * short
                counts = np.diff(offsets)
                for k in range(n_classes):
                    slope[k, :-1] += np.bincount(places, np.repeat(pull[k], counts) * values, size - 1)
                slope[:, -1] += pull.sum(axis=1)
        k, slot = np.nonzero(slope)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([k, np.arange(n_classes)]).astype(np.int32)), pa.array(np.concatenate([slot, np.full(n_classes, -1)]).astype(np.int32)),
             pa.array(np.concatenate([slope[k, slot], loss]))], ["class", "slot", "value"])
    return run


def evaluate(rows: DataFrame, weights: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """Objective and slope at ``weights``."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    sums = rows.mapInArrow(slope_task(held), "class int, slot int, value double").groupBy("class", "slot").agg(F.sum("value").alias("value")).toArrow()
    held.destroy()
    k, slot, value = (sums.column(i).to_numpy() for i in range(3))
    slope = weights.copy()
    real = slot >= 0
    slope[k[real], slot[real]] += c * value[real]
    return 0.5 * float((weights * weights).sum()) + c * float(value[~real].sum()), slope


def fit_svm(rows: DataFrame, n_classes: int, size: int, c: float, steps: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (classes, size + 1) for rows (entries array<struct<place, w>>, index int, weight double)."""
    weights = np.zeros((n_classes, size + 1))
    value, slope = evaluate(rows, weights, c)
    start = float(np.abs(slope).max())
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if float(np.abs(slope).max()) <= tolerance * start:
            break
        direction, kept = -slope, []
        for s, y, r in reversed(moves):
            a = r * float((s * direction).sum())
            direction = direction - a * y
            kept.append(a)
        if moves:
            s, y, r = moves[-1]
            direction = direction / (r * float((y * y).sum()))
        else:
            direction = direction / max(1.0, 2 * c * float(np.abs(slope).max()))
        for (s, y, r), a in zip(moves, reversed(kept), strict=True):
            direction = direction + (a - r * float((y * direction).sum())) * s
        fall, length = float((slope * direction).sum()), 1.0
        while True:
            new_value, new_slope = evaluate(rows, weights + length * direction, c)
            if new_value <= value + 1e-4 * length * fall or length < 1e-6:
                break
            length /= 2
        s, y = length * direction, new_slope - slope
        weights, value, slope = weights + s, new_value, new_slope
        if (curved := float((s * y).sum())) > 1e-12:
            moves = [*moves[-MEMORY + 1:], (s, y, 1 / curved)]
    return weights


def margin_task(held):
    def run(batches):
        for batch in batches:
            for places, values, offsets, part in pieces(batch):
                found = margins(held.value, places, values, offsets)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(
                    pa.array(np.arange(found.shape[1] + 1, dtype=np.int32) * found.shape[0]), pa.array(found.T.ravel()))], ["digest", "margins"])
    return run


def score_svm(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(digest, margins) of rows (entries, digest)."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    return rows.select("entries", "digest").mapInArrow(margin_task(held), "digest string, margins array<double>")
