"""Ward clustering: exact up to a size, over micro-clusters beyond it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.cleaning import ID
from panelforge.operators.selection import feature_columns

#: Points that one dendrogram is built over on the driver: rows up to this number, else micro-clusters.
EXACT = 25_000
#: Living clusters are moved together when fewer than this share of the places is in use.
_CROWDED = 0.7


def merges(points: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward merges (smaller root, larger root, height) by ascending height, from nearest-neighbour chains.

    Points carry weights: a micro-cluster counts as its members.  A cluster's
    root is its smallest point number.
    """
    n = len(points)
    c, w, root = points.astype(float).copy(), weights.astype(float).copy(), np.arange(n)
    square = (c * c).sum(axis=1)
    out, chain, alive = [], [], np.ones(n, bool)
    for left in range(n, 1, -1):
        if left < _CROWDED * len(c):
            place = np.cumsum(alive) - 1
            chain = place[chain].tolist()
            c, w, root, square = c[alive], w[alive], root[alive], square[alive]
            alive = np.ones(left, bool)
        while True:
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            a = chain[-1]
            d = (square - 2 * (c @ c[a]) + square[a]).clip(min=0) * (w * w[a] / (w + w[a]))
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height = float(np.sqrt(2 * ((c[a] - c[b]) ** 2).sum() * w[a] * w[b] / (w[a] + w[b])))
        out.append((min(root[a], root[b]), max(root[a], root[b]), height))
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        square[a] = (c[a] * c[a]).sum()
        w[a] += w[b]
        root[a] = min(root[a], root[b])
        alive[b] = False
    return sorted(((int(x), int(y), h) for x, y, h in out), key=lambda m: m[2])


def cut_tree(n: int, tree: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels 0..k-1 of n points, numbered by their first point."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, _ in tree[: max(0, n - k)]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(n)]
    number = {r: i for i, r in enumerate(sorted(set(roots)))}
    return np.array([number[r] for r in roots])


@dataclass
class Dendrogram:
    """One tree over all rows, cut for any k; `members` maps rows to its points."""

    members: DataFrame  # household_id, point
    n: int
    tree: list[tuple[int, int, float]]

    def labels(self, k: int) -> DataFrame:
        """household_id, cluster."""
        if not 1 <= k <= self.n:
            raise ValueError(f"k must be 1 to {self.n}")
        spark = self.members.sparkSession
        of = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cut_tree(self.n, self.tree, k))], "point int, cluster int")
        return self.members.join(F.broadcast(of), "point").select(ID, "cluster")


def check_linkage(linkage: str) -> str:
    if str(linkage).strip().lower() != "ward":
        raise ValueError("only ward linkage is supported")
    return "ward"


def ward(features: DataFrame, exact: int = EXACT, linkage: str = "ward", seed: int = 42) -> Dendrogram:
    """The Ward tree of the rows of `features`.

    Up to `exact` rows, which bounds what reaches the driver, the tree is
    exact.  Beyond, k-means first makes `exact` micro-clusters in parallel and
    the tree joins those by their sizes.
    """
    check_linkage(linkage)
    spark, columns = features.sparkSession, feature_columns(features)
    n = features.count()
    if n <= exact:
        rows = features.orderBy(ID).collect()
        points = np.array([[float(r[c]) for c in columns] for r in rows]).reshape(len(rows), len(columns))
        members = spark.createDataFrame([(r[ID], i) for i, r in enumerate(rows)], f"{ID} long, point int")
        return Dendrogram(members, len(rows), merges(points, np.ones(len(rows))))
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(features).select(ID, "v")
    model = KMeans(k=exact, seed=seed, featuresCol="v", predictionCol="point", maxIter=10).fit(vectors)
    members = model.transform(vectors).select(ID, F.col("point").cast("int").alias("point"))
    weights = {r["point"]: r["n"] for r in members.groupBy("point").agg(F.count("*").alias("n")).collect()}
    used = sorted(weights)
    place = spark.createDataFrame([(p, i) for i, p in enumerate(used)], "point int, i int")
    centres = np.array(model.clusterCenters())[used]
    numbered = members.join(F.broadcast(place), "point").select(ID, F.col("i").alias("point"))
    return Dendrogram(numbered, len(used), merges(centres, np.array([weights[p] for p in used])))
