"""First-order vector autoregression with ridge: forecast error as anomaly score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.plans.panes import WindowSpec, reduce_to_windows


def wide_steps(aligned: DataFrame) -> DataFrame:
    """Channel values of a grid row and of the next one: `(run, k, x, y)`; arrays follow channel names."""
    rows = aligned.groupBy("run", "k").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("c"))
    rows = rows.select("run", "k", F.col("c.value").alias("x"))
    return rows.join(rows.select("run", (F.col("k") - 1).alias("k"), F.col("x").alias("y")), ["run", "k"])


def fit_points(windows: DataFrame, spec: WindowSpec, points: int | None = None) -> DataFrame:
    """Grid positions inside each window, as `(run, k)` rows: every step, or `points` evenly spaced ones.

    The Gram matrix adds up, so every step costs no more memory than a few.  The planner doesn't see how
    many rows a window becomes, so the join with them is told to merge.
    """
    at = list(range(spec.window - 1)) if points is None else np.linspace(0, spec.window - 2, points, dtype=int).tolist()
    return windows.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in at]))).select("run", (F.col("start_k") + F.col("_p")).alias("k")).hint("merge")


def gram(steps: DataFrame) -> DataFrame:
    """Cross sums `(i, j, s)` of z = (1, x, y).  Each task adds up one small matrix before the shuffle."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        for pdf in batches:
            if len(pdf):
                z = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy())])
                g = z.T @ z if g is None else g + z.T @ z
        if g is not None:
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": g.ravel()})

    parts = steps.select("x", "y").mapInPandas(partial, "i long, j long, s double")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"))


def solve_ridge(cells: DataFrame, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (channels x channels) and intercepts; the matrix is bounded by the catalogue."""
    rows = cells.collect()
    size = max(r["i"] for r in rows) + 1
    g = np.zeros((size, size))
    for r in rows:
        g[r["i"], r["j"]] = r["s"]
    c = (size - 1) // 2
    n, sx, sy = g[0, 0], g[0, 1:c + 1], g[0, c + 1:]
    xx = g[1:c + 1, 1:c + 1] - np.outer(sx, sx) / n
    xy = g[1:c + 1, c + 1:] - np.outer(sx, sy) / n
    coef = np.linalg.solve(xx + alpha * np.eye(c), xy)
    return coef, (sy - sx @ coef) / n


def score_var1(steps: DataFrame, windows: DataFrame, coef: np.ndarray, intercept: np.ndarray, spec: WindowSpec) -> DataFrame:
    """Mean squared one-step error per window, over time and channels."""

    @F.pandas_udf("double")
    def error(x: pd.Series, y: pd.Series) -> pd.Series:
        missed = np.stack(x.to_numpy()) @ coef + intercept - np.stack(y.to_numpy()) if len(x) else np.empty((0, 1))
        return pd.Series((missed**2).mean(axis=1))

    per = steps.select("run", "k", error("x", "y").alias("e"))
    sums = reduce_to_windows(per, ["run"], "k", spec.window - 1, spec.stride, {"e": ("e", "sum")})
    return windows.join(sums, ["run", "w"]).withColumn("score", F.col("e") / (spec.window - 1)).drop("e")
