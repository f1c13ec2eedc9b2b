"""Whitening of embeddings from an exact covariance, gathered by bit planes.

Each entry becomes a whole number x. A task takes its rows in blocks, shifts every dimension of a block by its least x,
and packs each bit plane of a dimension across the rows into 64-bit words. The population count of two ANDed planes,
times two to the sum of their bit numbers, is their part of a cross-product; shifts are undone in whole numbers. Tasks
give their sums as 32-bit limbs, which Spark adds without overflow; the driver gets (d + 1) * (d + 2) / 2 rows for d
dimensions, centres them as whole numbers (n * sum of x_i x_j - S_i S_j) and only then goes to floating point for eigh.

Vectors that are null or hold null or non-finite entries drop out. Vectors of another length than the table's most
common one (the longer on ties) drop out too; empty vectors have no components. Entries beyond 2**61 / 1024 are cut to that.
Repeated rows and null ids count and stay as rows of their own. Components whose eigenvalue is zero to within rounding
get a null ``whitened``; with one distinct vector that is all of them. Empty tables give empty tables. Other columns are
not read.
"""

from dataclasses import astuple, dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import in_tasks, written

SCALE, SHIFT = 1024, 100_000
FARTHEST = 2.0 ** 61
BLOCK = 4096  # rows whose planes are packed at once
LIMBS = 5
COMPONENTS = 8


def whole(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers."""
    values = np.asarray(vectors.flatten(), np.float64).reshape(-1, width)
    return np.clip(np.floor(values * SCALE), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT


def planes_of(shifted: np.ndarray) -> np.ndarray:
    """(bits, dimensions, words): bit planes of non-negative columns, 64 rows a word."""
    bits = int(shifted.max(initial=0)).bit_length()
    padded = np.zeros((-(-len(shifted) // 64) * 64, shifted.shape[1]), np.int64)
    padded[:len(shifted)] = shifted
    columns = np.ascontiguousarray(padded.T)
    return np.stack([np.packbits(((columns >> b) & 1).astype(np.uint8), axis=1).view(np.uint64) for b in range(bits)]) if bits else \
        np.zeros((0, shifted.shape[1], 0), np.uint64)


def cross_products(rows: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of (x, 1)(x, 1)^T, as Python integers."""
    n, d = rows.shape
    least = rows.min(axis=0)
    planes = planes_of(rows - least)
    product, total = np.zeros((d, d), object), np.zeros(d, object)
    for a in range(len(planes)):
        total += np.bitwise_count(planes[a]).sum(axis=1, dtype=np.int64).astype(object) << a
        for b in range(a, len(planes)):
            counts = np.stack([np.bitwise_count(planes[a, i] & planes[b]).sum(axis=1, dtype=np.int64) for i in range(d)])
            both = counts if a == b else counts + counts.T
            product += both.astype(object) << (a + b)
    shift = least.astype(object)
    out = np.zeros((d + 1, d + 1), object)
    out[:d, :d] = product + np.outer(shift, total) + np.outer(total, shift) + n * np.outer(shift, shift)
    out[:d, d] = out[d, :d] = total + n * shift
    out[d, d] = n
    return out


def scatter_batches(batches, width: int):
    """(pair, limbs) of the task's rows: pair numbers run along the upper triangle."""
    total, held, count = None, [], 0

    def fold(total, held):
        part = cross_products(np.concatenate(held))
        return part if total is None else total + part

    for batch in batches:
        rows = whole(batch.column(0), width)
        for begin in range(0, len(rows), BLOCK):
            held.append(rows[begin:begin + BLOCK])
            count += len(held[-1])
            if count >= BLOCK:
                total, held, count = fold(total, held), [], 0
    if held:
        total = fold(total, held)
    if total is not None:
        upper = total[np.triu_indices(width + 1)]
        limbs = [[int(v >> 32 * k) if k == LIMBS - 1 else int(v >> 32 * k) & 0xFFFFFFFF for v in upper] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper))), *[pa.array(x, pa.int64()) for x in limbs]], ["pair", *[f"limb{k}" for k in range(LIMBS)]])


@dataclass
class Whitener:
    """Of the fit list: rows, sums per dimension, eigenvalues and vectors of the leading components, trace of the covariance."""
    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    trace: float

    @property
    def alive(self) -> list[bool]:
        floor = len(self.sums) * np.finfo(float).eps * max([*self.values, 0.0])
        return [v > floor for v in self.values]


def usable(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part, and their number of dimensions (0: none)."""
    kept = vectors.where(F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))))
    most = kept.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = most[0]["width"] if most else 0
    return kept.where(F.size(vector) == width), width


def fit_whitener(vectors: DataFrame, width: int, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Fit on all rows of ``vectors`` (as ``usable`` gives them)."""
    if not width:
        return None
    sums = vectors.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(
        in_tasks(__name__, "scatter_batches", width), "pair long, " + ", ".join(f"limb{k} long" for k in range(LIMBS)))\
        .groupBy("pair").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)])
    total = np.zeros((width + 1, width + 1), object)
    at = np.triu_indices(width + 1)
    for r in sums.collect():
        i, j = at[0][r["pair"]], at[1][r["pair"]]
        total[i, j] = total[j, i] = sum(r[f"limb{k}"] << 32 * k for k in range(LIMBS))
    return solve(total, components)


def solve(total: np.ndarray, components: int) -> Whitener:
    """Centre exact cross-products as whole numbers, then take the leading eigenvectors; the largest entry of each is positive."""
    d = len(total) - 1
    n, sums = int(total[d, d]), [int(s) for s in total[:d, d]]
    centred = np.array([[(n * int(total[i, j]) - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")[:components]
    chosen = vectors[:, order]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    trace = sum(n * int(total[i, i]) - sums[i] ** 2 for i in range(d)) / (n * n)
    return Whitener(n, sums, [float(max(v, 0.0)) for v in values[order]], chosen, trace)


def whiten_batches(batches, fitted: tuple):
    model = Whitener(*fitted)
    width, sums, n = len(model.sums), model.sums, model.n
    alive = [k for k, yes in enumerate(model.alive) if yes]
    scale = np.sqrt(np.array([model.values[k] for k in alive]))
    for batch in batches:
        x = whole(batch.column(1), width)
        farthest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
        wide = farthest >= 2 ** 62
        centred = (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)
        if wide or width * int(np.abs(centred).max(initial=0)) ** 2 >= 2 ** 63:
            squares = (centred.astype(object) ** 2).sum(axis=1)
            deviation = pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in squares], pa.decimal128(38, 0))
        else:
            deviation = pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
        found = (centred.astype(np.float64) / n) @ model.vectors[:, alive] / scale
        out = [[None] * len(model.values) for _ in range(len(x))]
        for row, got in zip(out, found.tolist(), strict=True):
            for k, value in zip(alive, got, strict=True):
                row[k] = value
        yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.array(out, pa.list_(pa.float64()))], ["id", "deviation", "whitened"])


def identity_error(whitened: DataFrame, alive: list[bool]) -> float | None:
    """Measured over the rows: the largest absolute entry of the covariance of ``whitened`` minus the identity."""
    live = [k for k, yes in enumerate(alive) if yes]
    entries = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - (1.0 if i == j else 0.0)) for a, i in enumerate(live) for j in live[a:]]
    if not entries:
        return None
    return whitened.agg(F.array_max(F.array(*entries)).alias("worst")).collect()[0]["worst"]


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: id, component, n, deviation (decimal; null from 10**38 on), whitened,
    explained, identity_error."""
    kept, width = usable(vectors, vector)
    kind = vectors.select(id).schema[0].dataType.simpleString()
    model = fit_whitener(kept, width, vector, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = written(kept.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(
        in_tasks(__name__, "whiten_batches", astuple(model)), f"id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    worst = identity_error(rows, model.alive)
    shares = F.array(*[F.lit(v / model.trace if model.trace else 0.0) for v in model.values])
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(worst).cast("double").alias("identity_error"))
