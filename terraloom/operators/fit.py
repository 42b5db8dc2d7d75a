"""A linear model of candidate quality, fitted from distributed sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance_target(km: str, sigma_km: float) -> Column:
    return F.exp(-0.5 * F.pow(F.col(km) / sigma_km, F.lit(2)))


def sums_of_products(rows: DataFrame, features: list[str], target: str, strength: float) -> list[float]:
    """The weights of the features and, last, the intercept (which is not shrunk): the products of all columns are summed
    by Spark in one pass, and the small system is solved on the driver."""
    names = [*features, "1"]
    column = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*(F.sum(column(names[i]) * column(names[j])).alias(f"p{i}_{j}") for i, j in pairs), *(F.sum(column(n) * F.col(target)).alias(f"t{i}") for i, n in enumerate(names))).first()
    a = np.zeros((len(names), len(names)))
    for i, j in pairs:
        a[i, j] = a[j, i] = sums[f"p{i}_{j}"] or 0.0
    shrink = np.diag([strength] * len(features) + [1e-12])
    return np.linalg.solve(a + shrink, np.array([sums[f"t{i}"] or 0.0 for i in range(len(names))])).tolist()


def ridge(rows: DataFrame, features: list[str], target: str, strength: float = 1.0) -> DataFrame:
    """feature, weight, and the intercept."""
    weights = sums_of_products(rows, features, target, strength)
    return rows.sparkSession.createDataFrame(list(zip([*features, "intercept"], weights, strict=True)), "feature string, weight double")


def applied(rows: DataFrame, model: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``rerank``, the model's value clamped to [0, 1]."""
    weights = {r["feature"]: r["weight"] for r in model.collect()}
    value = F.lit(weights["intercept"])
    for f in features:
        value = value + F.col(f) * weights[f]
    return rows.withColumn("rerank", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
