"""k-Shape clustering of standardised series by shape-based distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.storage import cut, drop_cut
from panelforge.operators.cleaning import DAY, ID, V, z_rows


def series(panel: DataFrame) -> DataFrame:
    """household_id, v: each household's readings by day, missing ones as 0."""
    return panel.groupBy(ID).agg(F.transform(F.sort_array(F.collect_list(F.struct(DAY, F.coalesce(V, F.lit(0.0)).alias("x")))), lambda s: s["x"]).alias("v"))


def kshape_input(panel: DataFrame, max_households: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Standardised series to cluster and the ids that a sample leaves out.

    The sample takes the first ids by a digest of id and seed.
    """
    ids = panel.select(ID).distinct()
    if max_households is None:
        return series(z_rows(panel)), ids.limit(0)
    drawn = ids.orderBy(F.md5(F.concat_ws("/", F.col(ID), F.lit(seed))), ID).limit(max_households)  # each task keeps that many at most
    return series(z_rows(panel.join(drawn, ID, "left_semi"))), ids.join(drawn, ID, "left_anti")


def _cross(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest normalised cross-correlation of each row of x with c, and the shift of x that gives it."""
    d = x.shape[1]
    size = 1 << (2 * d - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(c, size) * np.conj(np.fft.rfft(x, size, axis=1)), size, axis=1)
    cc = np.concatenate([cc[:, -(d - 1) :], cc[:, :d]], axis=1) if d > 1 else cc[:, :1]
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(c)
    best = cc.argmax(axis=1)
    value = cc[np.arange(len(x)), best] / np.where(norm > 0, norm, np.inf)
    return value, best - (d - 1)


def _shift(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows moved by whole days, zeros following."""
    d = x.shape[1]
    at = np.arange(d)[None, :] - by[:, None]
    return np.where((at >= 0) & (at < d), np.take_along_axis(x, at.clip(0, d - 1), axis=1), 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=-1, keepdims=True)
    return np.where(sd < 1e-10, 0.0, (x - x.mean(axis=-1, keepdims=True)) / np.where(sd < 1e-10, 1.0, sd))


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """household_id, cluster, distance to the nearest centroid; k centroids travel with the function."""

    def run(frames):
        for f in frames:
            x = np.stack(f["v"].to_list()).astype(float)
            near = np.stack([_cross(x, c)[0] for c in centroids], axis=1)
            best = near.argmax(axis=1)
            yield pd.DataFrame({ID: f[ID], "cluster": best.astype("int32"), "distance": 1 - near[np.arange(len(x)), best]})

    return rows.select(ID, "v").mapInPandas(run, f"{ID} long, cluster int, distance double")


def _scatter(rows: DataFrame, labels: DataFrame, centroids: np.ndarray) -> dict[int, np.ndarray]:
    """For each cluster the sum of outer products of its members aligned to its centroid.

    Partitions sum first; their matrices meet by matrix row, so what the
    driver gets is k matrices of days x days.
    """

    def run(frames):
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            x = np.stack(f["v"].to_list()).astype(float)
            for c in f["cluster"].unique():
                own = x[(f["cluster"] == c).to_numpy()]
                aligned = own if not centroids[c].any() else _shift(own, _cross(own, centroids[c])[1])
                aligned = _unit(aligned)
                sums[c] = sums.get(c, 0.0) + aligned.T @ aligned
        for c, m in sums.items():
            yield pd.DataFrame({"cluster": np.int32(c), "i": np.arange(len(m), dtype="int32"), "row": list(m)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]], "i": [frame["i"].iloc[0]], "row": [np.sum(np.stack(frame["row"].to_list()), axis=0)]})

    parts = rows.join(labels.select(ID, "cluster"), ID).select(ID, "v", "cluster").mapInPandas(run, "cluster int, i int, row array<double>")
    whole = parts.groupBy("cluster", "i").applyInPandas(add, "cluster int, i int, row array<double>").orderBy("cluster", "i").collect()
    out: dict[int, list] = {}
    for r in whole:
        out.setdefault(r["cluster"], []).append(r["row"])
    return {c: np.array(m) for c, m in out.items()}


def _extract(scatter: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The leading eigenvector of the centred scatter matrix, its sign towards the reference."""
    d = len(scatter)
    q = np.eye(d) - 1.0 / d
    vector = np.linalg.eigh(q @ scatter @ q)[1][:, -1]
    return _unit(vector if vector @ reference >= 0 else -vector)


def kshape(rows: DataFrame, k: int, *, n_init: int = 5, max_iter: int = 30, seed: int = 42, least: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """household_id, cluster and the centroids of the best of `n_init` runs.

    Needs at least max(10 k, k + 1) series.  Labels start from a digest of
    id, seed and run; an empty cluster takes the series farthest from its
    centroid.
    """
    n = rows.count()
    if n < (max(10 * k, k + 1) if least is None else least):
        raise ValueError(f"{n} series are too few for {k} clusters")
    rows = cut(rows)
    d = len(rows.first()["v"])
    best: tuple[float, DataFrame, np.ndarray] | None = None
    for run in range(n_init):
        labels = rows.select(ID, F.pmod(F.xxhash64(ID, F.lit(seed), F.lit(run)), F.lit(k)).cast("int").alias("cluster"))
        centroids, state, old = np.zeros((k, d)), None, None
        for _ in range(max_iter):
            scatter = _scatter(rows, labels, centroids)
            new = centroids.copy()
            if not centroids.any():
                first = rows.join(labels, ID).groupBy("cluster").agg(F.min_by("v", ID).alias("v")).collect()
                towards = {r["cluster"]: np.array(r["v"]) for r in first}
            else:
                towards = dict(enumerate(centroids))
            for c in range(k):
                if c in scatter:
                    new[c] = _extract(scatter[c], towards[c])
            centroids = new
            # Each round's labels are written out: a lost executor costs one round, not all.
            found = cut(_assigned(rows, centroids))
            counts = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
            empty = [c for c in range(k) if c not in counts]
            if empty:
                far = found.orderBy(F.desc("distance"), ID).limit(len(empty)).collect()
                moved = {r[ID]: c for r, c in zip(far, empty)}
                to = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])
                found = cut(found.withColumn("cluster", F.coalesce(to[F.col(ID)], "cluster").cast("int")))
            now = found.agg(F.sum(F.xxhash64(ID, "cluster").cast("decimal(38,0)")), F.sum("distance")).first()
            labels = found.select(ID, "cluster")
            if old is not None and (best is None or old is not best[1]):
                drop_cut(old)
            old = labels
            if now[0] == state:
                break
            state = now[0]
        if best is None or now[1] < best[0] - 1e-9:
            best = (now[1], labels, centroids)
    return best[1], best[2]
