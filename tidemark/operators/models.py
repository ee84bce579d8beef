"""Fitted models by fold: penalised logistic regression, calibration, and scoring as expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A calibration sample of fewer rows is fitted by a logistic curve, a larger one by isotonic steps.
ISOTONIC_FROM = 500
LEAST = 50


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow at either end."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def elastic_net(x: np.ndarray, y: np.ndarray, c: float = 1.0, l1_ratio: float = 0.5, steps: int = 4000, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise c * log loss + the elastic net of the coefficients, by accelerated proximal steps."""
    n, k = x.shape
    design = np.column_stack([x, np.ones(n)])
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    lipschitz = c * 0.25 * np.linalg.norm(design, 2) ** 2 + (1 - l1_ratio)
    for _ in range(steps):
        z = design @ v
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        slope = c * design.T @ (p - y)
        slope[:k] += (1 - l1_ratio) * v[:k]
        new = v - slope / lipschitz
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - l1_ratio / lipschitz, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < tolerance
        w, t = new, t_new
        if done:
            break
    return w[:k], float(w[k])


MODEL = "fold int, n_train long, mean array<double>, scale array<double>, coef array<double>, intercept double"


def fitted(train: DataFrame, columns: Sequence[str], c: float = 1.0, l1_ratio: float = 0.5) -> DataFrame:
    """(fold, n_train, mean, scale, coef, intercept): one model a fold, a fold a task; train holds (fold, position, columns, y).

    Columns are standardised by the fold's own train rows; rows with a null, and folds of one class, teach nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        x, y = pdf[list(columns)].to_numpy(float), pdf["y"].to_numpy(float)
        use = np.isfinite(x).all(axis=1) & np.isfinite(y)
        x, y = x[use], y[use]
        if len(y) < 2 or y.min() == y.max():
            return pd.DataFrame({"fold": [], "n_train": [], "mean": [], "scale": [], "coef": [], "intercept": []})
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 0, scale, 1.0)
        coef, intercept = elastic_net((x - mean) / scale, y, c, l1_ratio)
        return pd.DataFrame({"fold": [int(pdf["fold"].iloc[0])], "n_train": [len(y)], "mean": [mean], "scale": [scale], "coef": [coef], "intercept": [intercept]})

    return train.select("fold", "position", *columns, "y").groupBy("fold").applyInPandas(run, MODEL)


def scored(rows: DataFrame, model: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows (fold, columns) with score and p of their fold's model; null where a column is. Models are a row a fold: broadcast."""
    df = rows.join(F.broadcast(model.select("fold", "mean", "scale", "coef", "intercept")), "fold")
    parts = F.zip_with(F.zip_with(F.array(*columns), "mean", lambda x, m: x - m), F.zip_with("coef", "scale", lambda w, s: w / s), lambda x, w: x * w)
    score = F.aggregate(parts, F.col("intercept"), lambda s, v: s + v)
    return df.withColumn("score", score).withColumn("p", sigmoid(F.col("score"))).drop("mean", "scale", "coef", "intercept")


def long_signal(p: Column) -> Column:
    return p >= 0.5


def pooled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps (thresholds, values) of y over x by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # from, to, sum, count
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][1] == a:
            blocks[-1][2] += b
            blocks[-1][3] += 1
        else:
            blocks.append([a, a, b, 1])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, to, s, n = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = to, blocks[-1][2] + s, blocks[-1][3] + n
    at = [(e, s / n) for a, b, s, n in blocks for e in ((a,) if a == b else (a, b))]
    return np.array([a for a, _ in at]), np.array([v for _, v in at])


CALIBRATION = "fold int, method string, reason string, n long, n_positive long, thresholds array<double>, levels array<double>, mean double, scale double, coef double, intercept double"


def calibrators(samples: DataFrame, isotonic_from: int = ISOTONIC_FROM, least: int = LEAST) -> DataFrame:
    """One calibrator a fold of samples (fold, position, score, y): logistic under isotonic_from rows, isotonic from there on.

    Too few rows, one class, or a fit that turns the order round give the method `none` and the reason; such a fold keeps
    its own probabilities.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["score"].to_numpy(float))].sort_values("position")
        s, y = pdf["score"].to_numpy(float), pdf["y"].to_numpy(float)
        out = {"fold": int(pdf["fold"].iloc[0]) if len(pdf) else None, "method": "none", "reason": None, "n": len(s), "n_positive": int(y.sum()), "thresholds": [], "levels": [], "mean": None, "scale": None, "coef": None, "intercept": None}
        if len(s) < least:
            out["reason"] = "too_few"
        elif y.min() == y.max():
            out["reason"] = "one_class"
        elif len(s) < isotonic_from:
            mean, scale = s.mean(), s.std() or 1.0
            coef, intercept = elastic_net(((s - mean) / scale)[:, None], y, l1_ratio=0.0)
            if coef[0] > 0:
                out |= {"method": "platt", "mean": float(mean), "scale": float(scale), "coef": float(coef[0]), "intercept": intercept}
            else:
                out["reason"] = "order_turned"
        else:
            thresholds, levels = pooled(s, y)
            if levels[-1] > levels[0]:
                out |= {"method": "isotonic", "thresholds": thresholds, "levels": levels}
            else:
                out["reason"] = "order_turned"
        return pd.DataFrame([out]) if len(pdf) else pd.DataFrame([out])[:0]

    return samples.select("fold", "position", "score", "y").groupBy("fold").applyInPandas(run, CALIBRATION)


def calibrated(rows: DataFrame, calibrators_: DataFrame) -> DataFrame:
    """rows (fold, score, p) with p_calibrated: the fold's calibrator, between its thresholds by straight lines, or p itself."""
    df = rows.join(F.broadcast(calibrators_.select("fold", "method", "thresholds", "levels", "mean", "scale", F.col("coef").alias("_coef"), F.col("intercept").alias("_intercept"))), "fold", "left")
    platt = sigmoid((F.col("score") - F.col("mean")) / F.col("scale") * F.col("_coef") + F.col("_intercept"))
    k = F.size(F.filter("thresholds", lambda t: t <= F.col("score")))
    at = lambda a, i: F.get(F.col(a), i)
    low, high = at("thresholds", k - 1), at("thresholds", k)
    slope = F.try_divide(at("levels", k) - at("levels", k - 1), high - low)
    steps = F.when(k == 0, at("levels", F.lit(0))).when(k == F.size("thresholds"), at("levels", k - 1)).otherwise(at("levels", k - 1) + slope * (F.col("score") - low))
    p = F.when(F.col("score").isNull(), None).when(F.col("method") == "platt", platt).when(F.col("method") == "isotonic", steps).otherwise(F.col("p"))
    return df.withColumn("p_calibrated", p).drop("method", "thresholds", "levels", "mean", "scale", "_coef", "_intercept")


def forecast_losses(forecasts: DataFrame, target: str, candidates: Sequence[str], by: str) -> DataFrame:
    """(group, candidate, n, qlike, mse_log) over the rows where the target and every candidate are above 0: one sample for all."""
    fine = F.col(target) > 0
    for c in candidates:
        fine = fine & (F.col(c) > 0)
    rows = forecasts.where(fine).select(by, F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).alias("f")) for c in candidates))).alias("x")).select(by, "y", "x.*")
    return rows.groupBy(by, "candidate").agg(F.count("*").alias("n"), F.avg(F.log("f") + F.col("y") / F.col("f")).alias("qlike"), F.avg(F.pow(F.log("f") - F.log("y"), 2)).alias("mse_log"))


def selected(losses: DataFrame, by: str, reference: str = "rw", tolerance: float = 0.02) -> DataFrame:
    """(group, candidate, gap_best, gap_reference, chosen): within tolerance of the best and better than the reference by it, by QLIKE;
    the best of those is chosen, the earlier name among equals."""
    best = losses.groupBy(by).agg(F.min("qlike").alias("best"), F.max(F.when(F.col("candidate") == reference, F.col("qlike"))).alias("ref"))
    gap = lambda to: F.try_divide(F.col("qlike") - F.col(to), F.abs(to))
    df = losses.join(best, by).withColumns({"gap_best": gap("best"), "gap_reference": gap("ref")})
    fine = (F.col("gap_best") <= tolerance) & (F.col("gap_reference") < -tolerance)
    pick = df.where(fine).groupBy(by).agg(F.min_by("candidate", F.struct("qlike", "candidate")).alias("pick"))
    return df.join(pick, by, "left").select(by, "candidate", "n", "qlike", "mse_log", "gap_best", "gap_reference", F.coalesce(F.col("candidate") == F.col("pick"), F.lit(False)).alias("chosen"))
