"""Ridge regression from distributed Gram sums; predictions are column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 10.0


@dataclass
class Ridge:
    columns: list[str]
    weights: np.ndarray
    intercept: float
    mean: np.ndarray
    std: np.ndarray
    degenerate: list[str] = field(default_factory=list)

    def predict(self) -> Column:
        """Intercept plus weights times z-scores clipped to +-CLIP."""
        out = F.lit(float(self.intercept))
        for c, w, m, s in zip(self.columns, self.weights, self.mean, self.std):
            if w:
                z = (F.col(c) - float(m)) / float(s)
                out = out + float(w) * F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))
        return out

    def coefficients(self) -> list[tuple[str, float]]:
        return sorted(zip(self.columns, map(float, self.weights)), key=lambda x: -abs(x[1]))


def gram(df: DataFrame, columns: list[str], y: str, by: list[str] | None = None, pivot: dict | None = None) -> tuple[DataFrame, dict]:
    """Sums n, x, x x', x y of values shifted by a pivot (numbers, or columns; else the global means), per group `by`.

    Shifted sums keep their digits where a column's spread is small against its
    mean. Groups add up: expanding folds are running sums of block rows.
    """
    pivot = pivot or df.agg(*[F.avg(c).alias(c) for c in [*columns, y]]).first().asDict()
    at = lambda c: pivot[c] if isinstance(pivot[c], Column) else float(pivot[c] or 0.0)
    x, t = [F.col(c) - at(c) for c in columns], F.col(y) - at(y)
    sums = [F.count("*").alias("n"), F.sum(t).alias("sy")]
    for i in range(len(columns)):
        sums += [F.sum(x[i]).alias(f"s{i}"), F.sum(x[i] * t).alias(f"t{i}"), F.min(columns[i]).alias(f"lo{i}"), F.max(columns[i]).alias(f"hi{i}")]
        sums += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for j in range(i + 1)]
    return df.groupBy(*(by or [])).agg(*sums), pivot


def solve(sums: dict, pivot: dict[str, float], columns: list[str], y: str, alpha: float) -> Ridge:
    """(Z'Z + alpha I) w = Z'y on z-scores (population std); constant columns get weight 0."""
    p, n = len(columns), float(sums["n"])
    s = np.array([sums[f"s{i}"] for i in range(p)])
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            g[i, j] = g[j, i] = sums[f"g{i}_{j}"]
    cov = g - np.outer(s, s) / n
    base = np.array([pivot[c] for c in columns])
    mean, std = base + s / n, np.sqrt(np.maximum(np.diag(cov), 0) / n)
    flat = np.array([sums[f"hi{i}"] == sums[f"lo{i}"] for i in range(p)]) | (std <= 1e-12 * np.maximum(np.abs(mean), 1))
    scale = np.where(flat, 1.0, std)
    zz = cov / np.outer(scale, scale)
    zy = (np.array([sums[f"t{i}"] for i in range(p)]) - s * sums["sy"] / n) / scale
    keep = ~flat
    w = np.zeros(p)
    if keep.any():
        w[keep] = np.linalg.solve(zz[np.ix_(keep, keep)] + alpha * np.eye(int(keep.sum())), zy[keep])
    return Ridge(columns, w, pivot[y] + sums["sy"] / n, mean, scale, [c for c, f in zip(columns, flat) if f])


def fit(df: DataFrame, columns: list[str], y: str, alpha: float = 1.0) -> Ridge:
    sums, pivot = gram(df, columns, y)
    return solve(sums.first().asDict(), pivot, columns, y, alpha)


def walk_forward(indexed: DataFrame, bounds: list, t: str, columns: list[str], y: str, alpha: float, horizon: int) -> DataFrame:
    """Predictions of every fold's test rows (with k), each by the ridge of its training rows.

    A row is read once, whatever the folds: rows that train the same folds share
    their Gram sums, and a fold adds those of its groups (2 folds + 1 at most).
    """
    folds = [dict(zip(("k", "tr_beg", "te_beg", "te_end", "cut"), tuple(r))) for r in bounds]
    idx, at = F.col("idx"), F.col(t) + horizon
    trains = F.array_compact(F.array(*[F.when((idx >= f["tr_beg"]) & (idx < f["te_beg"]) & (at <= f["cut"]), F.lit(f["k"])) for f in folds]))
    rows = indexed.withColumn("__folds", trains)
    pivot = indexed.agg(*[F.avg(c).alias(c) for c in [*columns, y]]).first().asDict()
    sums, _ = gram(rows.filter(F.size("__folds") > 0), columns, y, ["__folds"], pivot)
    groups = [r.asDict() for r in sums.collect()]  # a row per set of folds
    k, pred = F.lit(None).cast("int"), F.lit(None).cast("double")
    for f in folds:
        inside = (idx >= f["te_beg"]) & (idx < f["te_end"])
        k = F.when(inside, F.lit(f["k"])).otherwise(k)
        if own := [g for g in groups if f["k"] in g["__folds"]]:
            pred = F.when(inside, solve(added(own), pivot, columns, y, alpha).predict()).otherwise(pred)
    return indexed.withColumns({"k": k, "pred": pred}).filter("k IS NOT NULL")


def added(groups: list[dict]) -> dict:
    """The Gram sums of groups together."""
    how = lambda c: min if c.startswith("lo") else max if c.startswith("hi") else sum
    return {c: how(c)(g[c] for g in groups) for c in groups[0] if not c.startswith("__")}
