"""Whitening of vectors by a one-sided Jacobi SVD.

Each task centres its rows and reduces them, block by block, to one triangular R (TSQR); the Rs are merged in groups of FAN_IN until one is left, whose
Gram matrix is that of all centred rows. Plane rotations make R's columns orthogonal; their lengths over sqrt(n) are the standard deviations, and the rotations
together are the components. No Gram matrix of the rows is ever formed, so small standard deviations keep their digits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Scratch, free_names, list_array

#: Rows that are reduced to a triangle at once; partial results that one task merges.
BLOCK_ROWS, FAN_IN = 4096, 16
#: Two columns count as orthogonal when the cosine between them is below this; most sweeps over all pairs.
ORTHOGONAL, SWEEPS = 1e-15, 40
#: Standard deviations below this part of the largest one are zero but for rounding: they belong to no component.
NEGLIGIBLE = 1e-12
#: Fixed values of the report: entries become floor(SCALE * c) + OFFSET; most components.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8


def valid_vector(v: Column) -> Column:
    """Not null, not empty, no null, NaN or infinite entry."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine), F.lit(False))


def fixed_point(v: Column) -> Column:
    """Entries as whole numbers."""
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column; they must share one length."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors must share one length, found {lengths.min()} and {lengths.max()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches, name: str, dim: int | None = None):
    """(batch, rows) with BLOCK_ROWS rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            x = matrix(part.column(part.schema.get_field_index(name)))
            if dim is not None and x.shape[1] != dim:
                raise ValueError(f"vectors must share one length, found {dim} and {x.shape[1]}")
            yield part, x


def merged(parts: DataFrame, fields: str, merge, scratch: Scratch) -> pd.DataFrame:
    """The one row left of (node, fields) after groups of FAN_IN neighbouring nodes are merged, again and again: `merge` takes and gives a pandas frame without node.
    What a task holds depends on FAN_IN only, what reaches the driver on the length of the vectors only."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge(pdf.sort_values("node").drop(columns="node"))
        out.insert(0, "node", [int(pdf["node"].iloc[0]) // FAN_IN])
        return out

    parts = scratch.table(parts)
    while parts.agg(F.max("node")).head()[0]:
        parts = scratch.table(parts.groupBy(F.expr(f"node div {FAN_IN}")).applyInPandas(step, f"node long, {fields}"))
        scratch.keep(parts)
    return parts.toPandas()


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def rotate(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations) by one-sided Jacobi: r @ rotations has orthogonal columns of these lengths, the longest first.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that turn together (one column stands still, the others move on by one place).
    """
    d = r.shape[1]
    a, v = r.copy(), np.eye(d)
    circle = list(range(d + d % 2))  # an odd number gets an idle place
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(circle) - 1):
            half = len(circle) // 2
            pairs = [(min(i, j), max(i, j)) for i, j in zip(circle[:half], circle[: half - 1 : -1]) if max(i, j) < d]
            i, j = (np.array(p, int) for p in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.maximum(np.sqrt(xx) * np.sqrt(yy), np.finfo(float).tiny)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > ORTHOGONAL
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            x, y = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * x - s * y, s * x + c * y
            circle = [circle[0], circle[-1], *circle[1:-1]]
        if worst <= ORTHOGONAL * max(1, d):
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


@dataclass
class Whitening:
    """What a table of vectors has taught: n rows, exact per-dimension `sums`, unit `components` (a column each) by falling standard deviation `deviations`."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    vector: str

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        """Share of the total variance of each component."""
        variances = self.deviations**2
        return variances / variances.sum() if variances.sum() else variances

    def scales(self, most: int) -> np.ndarray:
        """(dimensions, components up to `most`), by which centred rows become whitened ones; NaN where nothing varies."""
        top = self.deviations[:most]
        kept = top > NEGLIGIBLE * max(self.deviations.max(initial=0.0), np.finfo(float).tiny)
        return self.components[:, :most] / np.where(kept, top, np.nan)

    def transform(self, rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
        """rows with `whitened` array<double>: one entry a component up to `most` (NaN where the fitted rows do not vary), and `deviation` long: the sum of
        (n * x - S) squared over the dimensions, exact (null if it does not fit). Vectors must be whole numbers of the fitted length."""
        n, sums, mean, scales, vector = self.n, np.array(self.sums, np.int64), self.mean, self.scales(most), self.vector

        def run(batches):
            for batch, x in blocks(batches, vector, len(mean)):
                whitened = (x - mean) @ scales
                off = n * x.astype(np.int64) - sums
                largest = float(np.abs(off).max(initial=0))
                squares = (off * off).sum(1) if largest * largest * off.shape[1] < 2.0**62 else None
                if squares is None:  # in whole numbers of any size
                    squares = pa.array([q if (q := sum(int(o) ** 2 for o in row)) < 1 << 63 else None for row in off], pa.int64())
                lists = list_array(whitened.ravel(), [whitened.shape[1]] * len(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(squares)], names=[*batch.schema.names, "whitened", "deviation"])

        kept = rows.drop("whitened", "deviation")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", whitened array<double>, deviation long"
        return kept.mapInArrow(run, schema)


def fit(rows: DataFrame, vector: str) -> Whitening | None:
    """The whitening of all rows' vectors (array<long>, of one length, none null); None for an empty table."""
    scratch = Scratch(rows.sparkSession, "whiten")
    rows = rows.select(F.col(vector).alias("x"))

    def add_up(batches):
        total, n = None, 0
        for _, x in blocks(batches, "x"):
            if total is not None and len(total) != x.shape[1]:
                raise ValueError(f"vectors must share one length, found {len(total)} and {x.shape[1]}")
            total, n = x.sum(0) if total is None else total + x.sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total)), "total": total, "n": np.full(len(total), n)})

    totals = rows.mapInArrow(add_up, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    if not totals:
        return None
    n, sums = totals[0]["n"], [r["total"] for r in totals]
    if any(r["n"] != n for r in totals):
        raise ValueError("vectors must share one length")
    mean = np.array([s / n for s in sums])

    def reduce_rows(batches):
        r = np.zeros((0, len(mean)))
        for _, x in blocks(batches, "x", len(mean)):
            r = triangle(np.vstack([r, x - mean]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [triangle(np.vstack([r.reshape(-1, len(mean)) for r in pdf["r"]])).ravel()]})

    r = merged(rows.mapInArrow(reduce_rows, "node long, r array<double>"), "r array<double>", merge, scratch)["r"].iloc[0]
    lengths, components = rotate(np.asarray(r).reshape(-1, len(mean)))
    return Whitening(n, sums, components, lengths / math.sqrt(n), vector)


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of column `whitened` less the identity, over entries that are not NaN; 0 for no rows.

    Counts, means and centred products are taken block by block and merged, so nothing cancels.
    """
    scratch = Scratch(whitened.sparkSession, "whitened")

    def join(parts):
        n, mean, m = 0, 0.0, 0.0
        for n2, mean2, m2 in parts:
            if n and n2:
                step = mean2 - mean
                m = m + m2 + np.outer(step, step) * (n * n2 / (n + n2))
                mean = mean + step * (n2 / (n + n2))
            elif n2:
                mean, m = mean2, m2
            n += n2
        return n, mean, m

    def per_task(batches):
        found = (0, 0.0, 0.0)
        for _, w in blocks(batches, "whitened"):
            mean = w.mean(0)
            found = join([found, (len(w), mean, (w - mean).T @ (w - mean))] if found[0] else [(len(w), mean, (w - mean).T @ (w - mean))])
        if found[0]:
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "n": [found[0]], "mean": [found[1]], "m": [found[2].ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, m = join((n, np.asarray(mean, float), np.asarray(m, float).reshape(len(mean), -1)) for n, mean, m in zip(pdf["n"], pdf["mean"], pdf["m"]))
        return pd.DataFrame({"n": [n], "mean": [mean], "m": [m.ravel()]})

    fields = "n long, mean array<double>, m array<double>"
    total = merged(whitened.select("whitened").mapInArrow(per_task, f"node long, {fields}"), fields, merge, scratch)
    if total.empty:
        return 0.0
    k = len(total["mean"].iloc[0])
    covariance = np.asarray(total["m"].iloc[0], float).reshape(k, k) / total["n"].iloc[0]
    return float(np.nanmax(np.abs(covariance - np.eye(k)), initial=0.0))


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each row of `vectors` and each component up to `most`.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part. Repeated rows and null keys count as rows of their own; other columns are ignored.
    Vectors of different lengths, and entries beyond what a long holds, raise. A component along which no row varies gives null for `whitened` and 0 for
    `explained` (with one row, or rows all alike, every component is so). An empty table gives an empty result.
    """
    (x,) = free_names(vectors.select(key), "x")
    rows = vectors.filter(valid_vector(F.col(vector))).select(F.col(key), fixed_point(F.col(vector)).alias(x))
    model = fit(rows, x)
    out = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    made = model.transform(rows, most)
    error = identity_error(made)
    shares = F.array(*(F.lit(float(e)) for e in model.explained[:most]))
    each = made.select(key, "deviation", F.posexplode("whitened").alias("at", "w"))
    return each.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
