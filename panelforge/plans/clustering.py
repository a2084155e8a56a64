"""Clustering from panel to hand-off, for both methods and a range of k."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.storage import cut, ranked
from panelforge.operators import features, kshape, labels, reporting, selection, validity, ward
from panelforge.operators.cleaning import ID, z_rows
from panelforge.plans.preparation import Prepared, for_features

METHODS = ("feature_ward", "kshape")


@dataclass
class Clustering:
    """A labelling of all households, its evaluation vectors and what made it."""

    method: str
    k: int
    labels: DataFrame
    vectors: DataFrame  # id, v of the regular households
    prepared: Prepared
    extras: dict = field(default_factory=dict)

    def sizes(self) -> DataFrame:
        return labels.sizes(self.labels)

    def labelled_vectors(self) -> DataFrame:
        return self.vectors.join(self.labels.select(F.col(ID).alias("id"), "cluster"), "id").filter("cluster >= 0").select("id", "cluster", "v")


@dataclass
class FeatureInput:
    """Features prepared once and the tree that every k cuts."""

    prepared: Prepared
    selection: selection.Selection
    matrix: DataFrame
    tree: ward.Dendrogram


def feature_input(panel: DataFrame, exact: int = ward.EXACT, **options) -> FeatureInput:
    prepared = for_features(panel, **options)
    raw = cut(features.ward_features(prepared.regular))  # written once: the fit reads it several times
    fitted = selection.fit_selection(raw)
    matrix = cut(fitted.transform(raw))
    return FeatureInput(prepared, fitted, matrix, ward.ward(matrix, exact))


def _with_special(regular: DataFrame, prepared: Prepared) -> DataFrame:
    return labels.all_labels(regular, labels.special_labels(prepared.flags, prepared.excluded.select(ID).distinct()))


def feature_ward(given: FeatureInput, k: int) -> Clustering:
    """Ward on prepared features, special regimes labelled under 0."""
    columns = selection.feature_columns(given.matrix)
    vectors = given.matrix.select(F.col(ID).alias("id"), F.array(*columns).alias("v"))
    extras = {"selection": given.selection.summary, "families": labels.columns_by_family(given.selection.columns)}
    return Clustering("feature_ward", k, _with_special(given.tree.labels(k), given.prepared), vectors, given.prepared, extras)


def shape_clusters(panel: DataFrame, k: int, max_households: int | None = None, n_init: int = 5, least: int | None = None, **options) -> Clustering:
    """k-Shape on standardised series; households that a sample leaves out have a null label."""
    prepared = for_features(panel, **options)
    rows, rest = kshape.kshape_input(prepared.regular, max_households)
    found, centroids = kshape.kshape(rows, k, n_init=n_init, least=least)
    regular = found.unionByName(rest.select(ID, F.lit(None).cast("int").alias("cluster")))
    return Clustering("kshape", k, _with_special(regular, prepared), rows.select(F.col(ID).alias("id"), "v"), prepared, {"centroids": centroids})


def evaluate(result: Clustering, min_size: int = validity.MIN_CLUSTER_SIZE) -> DataFrame:
    """One evaluation row, with the level diagnostics of the regular panel."""
    row = validity.evaluation_row(result.labelled_vectors(), result.method, result.k, min_size)
    return row.crossJoin(F.broadcast(reporting.meaningfulness(result.prepared.regular, result.labels.filter("cluster >= 0"))))


def subsample(ids: DataFrame, fraction: float, run: int, seed: int = 42) -> DataFrame:
    """The first share of ids by a digest of id, seed and run."""
    n = ids.count()
    digest = F.md5(F.concat_ws("/", F.col(ID), F.lit(seed), F.lit(run)))
    return ranked(ids.select(ID).withColumn("_h", digest), "_k", "_h", ID).filter(F.col("_k") <= math.ceil(n * fraction)).select(ID)


@dataclass
class Stability:
    """Agreement of repeated clusterings: run pairs, how many runs came through and what the others said."""

    pairs: DataFrame
    successful_runs: int
    failed_runs: int
    failures: list[str]


def _stability(spark: SparkSession, one: Callable[[int], DataFrame], k: int, runs: int) -> Stability:
    """Runs `one` for each run, several at a time; failures are counted, and without a success there are no pairs."""

    def attempt(run: int) -> DataFrame | str:
        try:
            return cut(one(run).select(F.lit(run).alias("run"), F.col(ID).alias("id"), F.col("cluster").cast("int").alias("cluster")))
        except (ValueError, PySparkException) as e:
            return f"run {run}: {e}"

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(attempt, range(runs)))
    good, bad = [d for d in done if isinstance(d, DataFrame)], [d for d in done if isinstance(d, str)]
    none = spark.createDataFrame([], "run int, id long, cluster int")
    return Stability(validity.stability(reduce(DataFrame.unionByName, good, none), k), len(good), len(bad), bad)


def ward_stability(given: FeatureInput, k: int, runs: int = 10, fraction: float = 0.8) -> Stability:
    """run_i, run_j, ari over repeated Ward clusterings of subsamples."""
    ids = given.matrix.select(ID)
    return _stability(ids.sparkSession, lambda run: ward.ward(given.matrix.join(subsample(ids, fraction, run), ID, "left_semi")).labels(k), k, runs)


def kshape_stability(panel: DataFrame, k: int, runs: int = 10, fraction: float = 0.8, n_init: int = 3, **options) -> Stability:
    """run_i, run_j, ari over repeated k-Shape clusterings of subsamples."""
    rows, _ = kshape.kshape_input(panel)
    rows = cut(rows)

    def one(run: int) -> DataFrame:
        drawn = rows.join(subsample(rows.select(ID), fraction, run), ID, "left_semi")
        return kshape.kshape(drawn, k, n_init=n_init, seed=42 + run, **options)[0]

    return _stability(panel.sparkSession, one, k, runs)


def choose_k(evaluations: DataFrame, min_size: int = validity.MIN_CLUSTER_SIZE, min_balance: float = 0.2) -> int:
    """The best k of the shortlist."""
    return validity.best_k(validity.shortlist(validity.rank_k(evaluations, min_size), min_size, min_balance))[0]


def handoff(result: Clustering, keep_from: int = labels.KEEP_SPECIAL) -> dict[str, DataFrame]:
    """Ordered clusters with special households reassigned, over the cleaned panel."""
    return labels.handoff(result.prepared.cleaned, result.labels, keep_from)


def tsne(points: np.ndarray, perplexity: float = 30.0, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """A two-dimensional picture of at most a few thousand rows, by gradient descent on the exact t-SNE loss."""
    n = len(points)
    if n < 3:
        return np.zeros((n, 2))
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            row = np.exp(-beta * (d[i] - np.delete(d[i], i).min()))
            row[i] = 0
            row /= row.sum()
            entropy = -(row[row > 0] * np.log(row[row > 0])).sum()
            if abs(entropy - np.log(min(perplexity, (n - 1) / 3))) < 1e-4:
                break
            low, high = (beta, high) if entropy > np.log(min(perplexity, (n - 1) / 3)) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = row
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    move = np.zeros_like(y)
    for t in range(rounds):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        w = ((p * (4 if t < 100 else 1)) - q / q.sum()) * q
        move = (0.5 if t < 100 else 0.8) * move - 4 * max(n / 48, 50) * ((np.diag(w.sum(1)) - w) @ y)
        y = y + move
        y -= y.mean(0)
    return y


def z_vectors(panel: DataFrame) -> DataFrame:
    """id, v: standardised series as vectors."""
    return kshape.series(z_rows(panel)).select(F.col(ID).alias("id"), "v")
