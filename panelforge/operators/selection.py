"""Feature selection, scaling, block weights and reduction as a fit that transforms new rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.maths import CONSTANT, safe_corr
from panelforge.operators.cleaning import ID
from panelforge.operators.features import SHAPE_COLUMNS, WARD_BLOCKS

CORRELATION, VARIANCE, PCA_VARIANCE = 0.90, 1e-6, 0.90
BLOCK_WEIGHTS = {"level_dispersion": 0.0, "weekly": 1.0, "shape_normalized": 1.2, "persistence": 0.5, "trend": 0.3}


class SelectionError(ValueError):
    """A selection that leaves nothing usable."""


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c != ID]


def _finite(c: str) -> Column:
    x = F.col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def fill_values(features: DataFrame, strategy: str = "median") -> dict[str, float]:
    """The value that stands in for missing ones in each column; 0 where nothing is known."""
    columns = feature_columns(features)
    if strategy == "zero":
        return dict.fromkeys(columns, 0.0)
    f = {"median": F.median, "mean": F.avg}[strategy]
    row = features.agg(*[f(_finite(c)).alias(c) for c in columns]).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def sanitize(features: DataFrame, strategy: str = "median", fills: dict[str, float] | None = None) -> DataFrame:
    """Infinite and missing values replaced by the column's median, mean or 0, or by given values."""
    fills = fill_values(features, strategy) if fills is None else fills
    return features.select(ID, *[F.coalesce(_finite(c), F.lit(fills.get(c, 0.0))).alias(c) for c in feature_columns(features)])


def variances(features: DataFrame) -> DataFrame:
    """feature, variance (sample)."""
    columns = feature_columns(features)
    one = features.agg(*[F.var_samp(c).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "variance")


def varying(features: DataFrame, threshold: float = VARIANCE) -> tuple[list[str], list[str]]:
    """Columns whose variance exceeds the threshold, and those whose does not; unknown variances are in neither."""
    known = {r["feature"]: r["variance"] for r in variances(features).collect()}
    kept = [c for c in feature_columns(features) if known[c] is not None and known[c] > threshold]
    return kept, [c for c in feature_columns(features) if known[c] is not None and known[c] <= threshold]


def correlations(features: DataFrame) -> DataFrame:
    """feature_a, feature_b, abs_corr for all pairs, in one aggregate over the rows."""
    columns = feature_columns(features)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return features.limit(0).select(F.lit("").alias("feature_a"), F.lit("").alias("feature_b"), F.lit(0.0).alias("abs_corr"))
    one = features.agg(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.abs(safe_corr(F.col(a), F.col(b))).alias("abs_corr")) for a, b in pairs]).alias("pairs"))
    return one.select(F.explode("pairs").alias("p")).select("p.*")


def signed_correlations(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix, NaN where a side is constant, and population deviations of columns without nulls.

    One distributed Gram matrix of columns x columns, however many rows.
    """
    columns = feature_columns(features)
    row = features.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    deviations = np.array([row[c] or 0.0 for c in columns])
    varying = [c for c, s in zip(columns, deviations) if s >= CONSTANT]
    out = np.full((len(columns), len(columns)), np.nan)
    if varying:
        at = [columns.index(c) for c in varying]
        vectors = VectorAssembler(inputCols=varying, outputCol="v").transform(features).select("v")
        out[np.ix_(at, at)] = Correlation.corr(vectors, "v").first()[0].toArray()
    return out, deviations


def correlation_matrix(features: DataFrame) -> np.ndarray:
    """Absolute correlations of columns without nulls."""
    out = np.abs(signed_correlations(features)[0])
    np.fill_diagonal(out, 1.0)
    return out


def prune_correlated(columns: list[str], corr: np.ndarray, protected: set[str], threshold: float = CORRELATION) -> tuple[list[str], list[str]]:
    """Kept and removed columns of a greedy pass over pairs in column order.

    Of two columns above the threshold: both stay if protected, the protected
    one stays, else the one with the larger mean correlation goes, the
    earlier on ties.  A column that goes is no longer compared.
    """
    with np.errstate(all="ignore"):
        mean = np.nanmean(np.where(np.eye(len(columns), dtype=bool), np.nan, corr), axis=1) if len(columns) > 1 else np.zeros(len(columns))
    gone: set[int] = set()
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            if i in gone:
                break
            if j in gone or not corr[i, j] > threshold:
                continue
            a, b = columns[i] in protected, columns[j] in protected
            if a and b:
                continue
            gone.add(j if a else i if b else i if mean[i] >= mean[j] else j)
    return [c for i, c in enumerate(columns) if i not in gone], [columns[i] for i in sorted(gone)]


def scale_parameters(features: DataFrame, method: str = "standard") -> dict[str, tuple[float, float]]:
    """Shift and divisor of each column; the divisor of a constant column is 1."""
    columns = feature_columns(features)
    if method == "standard":
        aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}/0"), F.stddev_pop(c).alias(f"{c}/1"))]
    elif method == "minmax":
        aggs = [x for c in columns for x in (F.min(c).alias(f"{c}/0"), (F.max(c) - F.min(c)).alias(f"{c}/1"))]
    else:
        raise SelectionError(f"unknown method {method!r}")
    row = features.agg(*aggs).first()
    return {c: (row[f"{c}/0"] or 0.0, row[f"{c}/1"] or 1.0) for c in columns}


def scale(features: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return features.select(ID, *[((F.col(c) - m) / s).alias(c) for c, (m, s) in parameters.items()])


def block_factors(columns: list[str], blocks: dict[str, tuple[str, ...]], weights: dict[str, float] | None = None, rebalance: bool = True) -> dict[str, float]:
    """What each column is multiplied by: its block's weight over the root of the block's kept columns."""
    out = dict.fromkeys(columns, 1.0)
    for block, members in blocks.items():
        kept = [c for c in members if c in out]
        for c in kept:
            out[c] = ((weights or {}).get(block, 1.0)) / (math.sqrt(len(kept)) if rebalance else 1.0)
    return out


def weighted(features: DataFrame, factors: dict[str, float]) -> DataFrame:
    return features.select(ID, *[(F.col(c) * f).alias(c) for c, f in factors.items()])


@dataclass
class Selection:
    """A fitted selection; `transform` brings new rows through the same steps."""

    columns: list[str]
    fills: dict[str, float]
    dropped_variance: list[str]
    dropped_correlation: list[str]
    scaling: dict[str, tuple[float, float]]
    factors: dict[str, float]
    components: np.ndarray | None = None
    summary: dict = field(default_factory=dict)

    def transform(self, features: DataFrame) -> DataFrame:
        missing = [c for c in self.fills if c not in features.columns]
        if missing:
            raise SelectionError(f"missing feature columns: {missing}")
        clean = sanitize(features.select(ID, *self.fills), fills=self.fills).select(ID, *self.columns)
        out = weighted(scale(clean, self.scaling), self.factors)
        return out if self.components is None else project(out, self.components)


def fit_selection(
    features: DataFrame,
    blocks: dict[str, tuple[str, ...]] = WARD_BLOCKS,
    weights: dict[str, float] = BLOCK_WEIGHTS,
    protected: set[str] | None = None,
    *,
    strategy: str = "median",
    variance: float = VARIANCE,
    correlation: float = CORRELATION,
    method: str = "standard",
    use_pca: bool = False,
    pca_variance: float = PCA_VARIANCE,
) -> Selection:
    """Sanitize, drop constant and redundant columns, scale, balance and weight blocks, optionally reduce.

    Only per-column and per-pair numbers reach the driver.  The columns of
    the default clustering set are all protected from pruning.
    """
    protected = {*SHAPE_COLUMNS, *(c for b in WARD_BLOCKS.values() for c in b)} if protected is None else protected
    fills = fill_values(features, strategy)
    clean = sanitize(features, fills=fills).cache()
    try:
        kept, flat = varying(clean, variance)
        if not kept:
            raise SelectionError("no column varies")
        kept, redundant = prune_correlated(kept, correlation_matrix(clean.select(ID, *kept)), protected, correlation)
        if not kept:
            raise SelectionError("no column is left")
        scaling = scale_parameters(clean.select(ID, *kept), method)
        if not all(math.isfinite(x) for p in scaling.values() for x in p):
            raise SelectionError("a column is not finite")
        factors = block_factors(kept, blocks, weights)
        components = None
        if use_pca:
            components = principal_components(weighted(scale(clean.select(ID, *kept), scaling), factors), pca_variance)
    finally:
        clean.unpersist()
    counts = {b: sum(c in kept for c in members) for b, members in blocks.items()}
    summary = {"n_input": len(fills), "n_variance": len(flat), "n_correlation": len(redundant), "n_kept": len(kept), "kept_by_block": counts}
    return Selection(kept, fills, flat, redundant, scaling, factors, components, summary)


def covariance(features: DataFrame) -> np.ndarray:
    """Population covariance of columns without nulls."""
    corr, deviations = signed_correlations(features)
    return np.nan_to_num(corr) * np.outer(deviations, deviations)


def principal_components(features: DataFrame, share: float = PCA_VARIANCE) -> np.ndarray:
    """Components [column, component] up to the first whose cumulative variance reaches `share`; largest loading positive."""
    values, vectors = np.linalg.eigh(covariance(features))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order].clip(0), vectors[:, order]
    n = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1) if values.sum() > 0 else 1
    vectors = vectors[:, : min(n, len(values))]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def project(features: DataFrame, components: np.ndarray) -> DataFrame:
    """Centred rows on the components pc1, pc2, ..."""
    columns = feature_columns(features)
    means = features.agg(*[F.avg(c).alias(c) for c in columns]).first()
    dot = lambda w: reduce(lambda a, b: a + b, [(F.col(c) - means[c]) * float(x) for c, x in zip(columns, w)])
    return features.select(ID, *[dot(components[:, k]).alias(f"pc{k + 1}") for k in range(components.shape[1])])


def top_loadings(columns: list[str], components: np.ndarray, n: int = 5) -> list[tuple[str, str, float]]:
    """(component, column, loading): the n largest by size of each component."""
    return [(f"pc{k + 1}", columns[i], float(components[i, k])) for k in range(components.shape[1]) for i in np.argsort(-np.abs(components[:, k]), kind="stable")[:n]]
