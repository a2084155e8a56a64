"""Labels, validity, choice of k and the clusterers."""

import math
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.storage import ranked
from panelforge.operators import kshape, labels, validity, ward
from panelforge.plans import clustering
from panelforge.sources import panel as pn


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in (0, 5, 10)])


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "household_id long, a double, b double")


def partition(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], set()).add(r["household_id"])
    return sorted(map(sorted, groups.values()))


def test_ward_heights_rise_and_cuts_nest():
    x = np.random.default_rng(3).normal(0, 1, (40, 3))
    tree = ward.merges(x, np.ones(40))
    assert len(tree) == 39 and all(a[2] <= b[2] + 1e-9 for a, b in zip(tree, tree[1:]))
    for k in range(1, 40):
        fine, coarse = ward.cut_tree(40, tree, k + 1), ward.cut_tree(40, tree, k)
        assert len(set(coarse)) == k and len({(f, c) for f, c in zip(fine, coarse)}) == k + 1


def test_ward_equals_greedy_joining():
    x = np.random.default_rng(4).normal(0, 1, (15, 2))
    groups = [[i] for i in range(15)]
    while len(groups) > 4:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    cut = ward.cut_tree(15, ward.merges(x, np.ones(15)), 4)
    assert sorted(map(sorted, groups)) == sorted([np.flatnonzero(cut == c).tolist() for c in range(4)])


def test_ward_exact_and_by_micro_clusters(spark):
    x = blobs()
    want = [list(range(20)), list(range(20, 40)), list(range(40, 60))]
    assert partition(ward.ward(table(spark, x)).labels(3).collect()) == want
    assert partition(ward.ward(table(spark, x), exact=12).labels(3).collect()) == want
    with pytest.raises(ValueError):
        ward.ward(table(spark, x), linkage="single")


def waves(spark, n=24, days=48, shift=True):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        t = np.arange(days) + (rng.integers(0, 5) if shift else 0)
        v = np.sin(2 * np.pi * t / 12) if i % 2 else np.sign(np.sin(2 * np.pi * t / 30))
        v = (1 + i) * v + 10 * i + rng.normal(0, 0.01, days)
        rows += [(i, date(2023, 1, 1) + timedelta(days=int(d)), float(y)) for d, y in enumerate(v)]
    return spark.createDataFrame(rows, pn.SCHEMA)


def test_kshape_finds_shapes_whatever_their_scale(spark):
    rows, rest = kshape.kshape_input(waves(spark))
    found, centroids = kshape.kshape(rows, 2, n_init=2, max_iter=8, least=2)
    assert rest.count() == 0 and centroids.shape == (2, 48)
    assert partition(found.collect()) == [list(range(0, 24, 2)), list(range(1, 24, 2))]
    with pytest.raises(ValueError):
        kshape.kshape(rows, 5)
    drawn, left = kshape.kshape_input(waves(spark), 10)
    assert drawn.count() == 10 and left.count() == 14


def test_silhouette_and_friends(spark):
    x = blobs()
    v = spark.createDataFrame([(i, i // 20, list(map(float, r))) for i, r in enumerate(x)], "id long, cluster int, v array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    lab = np.arange(60) // 20
    a = np.array([d[i, (lab == lab[i]) & (np.arange(60) != i)].mean() for i in range(60)])
    b = np.array([min(d[i, lab == c].mean() for c in range(3) if c != lab[i]) for i in range(60)])
    assert validity.silhouette(v).first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    centre = np.array([x[lab == c].mean(0) for c in range(3)])
    s = np.array([np.linalg.norm(x[lab == c] - centre[c], axis=1).mean() for c in range(3)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(3) if j != i) for i in range(3)])
    assert validity.davies_bouldin(v).first()[0] == pytest.approx(db)
    between = 20 * ((centre - x.mean(0)) ** 2).sum()
    within = sum(((x[lab == c] - centre[c]) ** 2).sum() for c in range(3))
    assert validity.calinski_harabasz(v).first()[0] == pytest.approx(between * 57 / (within * 2))
    one = v.selectExpr("id", "0 as cluster", "v")
    assert validity.silhouette(one).first()[0] is None and validity.calinski_harabasz(one).first()[0] is None


def test_adjusted_rand(spark):
    rows = [(i % 3, (i + 1) % 3, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert validity.adjusted_rand(df.select("a", "b")).first()[0] == 1.0
    forth = validity.adjusted_rand(df.selectExpr("a", "c as b")).first()[0]
    assert forth == pytest.approx(validity.adjusted_rand(df.selectExpr("c as a", "a as b")).first()[0])
    runs = spark.createDataFrame([(r, i, (i + r) % 3) for r in range(3) for i in range(12) if i % 3 != r or True], "run int, id long, cluster int")
    assert [r["ari"] for r in validity.stability(runs).collect()] == [1.0] * 3


def test_ranking_of_k(spark):
    same = spark.createDataFrame([(k, k, 400, 500, 0.8, 0.5, 1.0, 10.0, 0.9, False) for k in (2, 3)], "k int, n_clusters_found int, smallest_cluster int, largest_cluster int, cluster_balance double, silhouette double, davies_bouldin double, calinski_harabasz double, stability_mean double, level_dominance_warning boolean")
    assert [(r["k"], r["composite_score"]) for r in validity.rank_k(same).collect()] == [(2, 1.0), (3, 1.0)]
    assert validity.best_k(validity.shortlist(validity.rank_k(same)))[0] == 2
    with pytest.raises(ValueError):
        validity.best_k(validity.rank_k(same).filter("k > 5"))


def test_special_groups_are_kept_or_reassigned(spark):
    flat = lambda i, d: float(d + 1) if i < 10 else float(20 - d)
    p = spark.createDataFrame([(i, date(2023, 1, 1) + timedelta(days=d), flat(i, d)) for i in range(18) for d in range(14)], pn.SCHEMA)
    given = [(i, 0 if i < 8 else -1 if i < 10 else 1 if i < 15 else -3) for i in range(18)]
    lab = spark.createDataFrame(given, "household_id long, cluster int")
    got = {r["household_id"]: r["cluster"] for r in labels.reassign_special(p, lab, keep_from=3).collect()}
    assert [got[i] for i in (0, 8, 9, 12, 15, 17)] == [0, 0, 0, 1, 2, 2]
    # A small special group may be nearest to a special group that became a cluster.
    shapes = lambda i, d: float(d + 1) if i < 10 else float(20 - d) if i < 15 else float(d % 2 * 5 + 0.01 * i)
    q = spark.createDataFrame([(i, date(2023, 1, 1) + timedelta(days=d), shapes(i, d)) for i in range(20) for d in range(14)], pn.SCHEMA)
    some = spark.createDataFrame([(i, 0 if i < 10 else 1 if i < 15 else -3 if i < 19 else -1) for i in range(20)], "household_id long, cluster int")
    assert {r["household_id"]: r["cluster"] for r in labels.reassign_special(q, some, keep_from=3).collect()}[19] == 2
    with pytest.raises(pn.PanelError):
        labels.reassign_special(q, some.withColumn("cluster", F.lit(-1)), keep_from=99)
    assert {r["cluster"] for r in labels.reassign_special(q, some.withColumn("cluster", F.lit(-1)), keep_from=3).collect()} == {0}
    order = {r["household_id"]: r["cluster"] for r in labels.ordered(p, lab).collect()}
    assert Counter(order.values())[-1] == 2 and {order[0], order[12]} == {0, 1}
    done = labels.handoff(p, lab, keep_from=99)
    assert [r["household_id"] for r in done["table"].collect()] == list(range(18))
    with pytest.raises(pn.PanelError):
        labels.ordered(p, spark.createDataFrame([(0, None)], "household_id long, cluster int"))


def test_clustering_end_to_end(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(14):
        for d in range(365):
            day = date(2023, 1, 1) + timedelta(days=d)
            season = math.cos(2 * math.pi * d / 365) * (3 if i % 2 else -3)
            rows.append((i, day, 0.0 if i >= 12 else float(10 + season + (4 if i % 2 and day.weekday() >= 5 else 0) + rng.normal(0, 0.2))))
    p = spark.createDataFrame(rows, pn.SCHEMA).cache()
    given = clustering.feature_input(p)
    result = clustering.feature_ward(given, 2)
    assert Counter(r["cluster"] for r in result.labels.collect()) == {0: 6, 1: 6, -1: 2}
    assert result.labels.select("household_id").distinct().count() == 14
    row = clustering.evaluate(result, min_size=3).first()
    assert row["n_clusters_found"] == 2 and row["cluster_balance"] == 1.0 and row["silhouette"] > 0.3
    done = {r["household_id"]: r["cluster"] for r in clustering.handoff(result, keep_from=5)["table"].collect()}
    assert done[1] == 0 and done[0] == 1 and set(done.values()) == {0, 1}
    assert clustering.tsne(np.random.default_rng(0).normal(size=(12, 3)), rounds=30).shape == (12, 2)


def test_silhouette_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(90, 5)), rng.integers(0, 3, 90)
    c[0] = 7
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(90)], "id long, cluster int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(90):
        mean = {k: d[i, (c == k) & (np.arange(90) != i)].mean() for k in set(c) if ((c == k) & (np.arange(90) != i)).any()}
        a, b = mean.get(c[i]), min(v for k, v in mean.items() if k != c[i])
        want[i] = 0.0 if a is None else (b - a) / max(a, b)
    for block in (4096, 16):
        got = {r["id"]: r["silhouette"] for r in validity.silhouettes(df, block).collect()}
        assert got == pytest.approx(want)
    assert validity.silhouettes(df.limit(0)).count() == 0
    both = [validity.evaluation_row(df, "given", 4, exact=n).first()["silhouette"] for n in (1000, 10)]
    assert both[0] == pytest.approx(np.mean(list(want.values()))) and both[1] != both[0]


def test_stability_counts_failures(spark):
    ids = spark.range(20).select(F.col("id").alias("household_id"))

    def one(run):
        if run == 1:
            raise ValueError("too few")
        return ids.withColumn("cluster", F.col("household_id") % 2)

    done = clustering._stability(ids.sparkSession, one, 2, 4)
    assert (done.successful_runs, done.failed_runs) == (3, 1) and "too few" in done.failures[0]
    assert [r["ari"] for r in done.pairs.collect()] == [1.0] * 3

    def never(run):
        raise ValueError("no")

    none = clustering._stability(ids.sparkSession, never, 2, 3)
    assert (none.successful_runs, none.failed_runs, none.pairs.count()) == (0, 3, 0)


def test_ward_of_many_points_equals_the_plain_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    tree = ward.merges(x, np.ones(60))
    clusters, heights = {i: [i] for i in range(60)}, []
    while len(clusters) > 1:
        cost = lambda a, b: len(clusters[a]) * len(clusters[b]) / (len(clusters[a]) + len(clusters[b])) * ((x[clusters[a]].mean(0) - x[clusters[b]].mean(0)) ** 2).sum()
        a, b = min(((a, b) for a in clusters for b in clusters if a < b), key=lambda p: cost(*p))
        heights.append((a, b, math.sqrt(2 * cost(a, b))))
        clusters[a] += clusters.pop(b)
    assert [(a, b) for a, b, _ in tree] == [(a, b) for a, b, _ in heights]
    assert [h for *_, h in tree] == pytest.approx([h for *_, h in heights])


def test_ranks_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    got = {(r["x"], r["y"]): r["k"] for r in ranked(df, "k", "x", "y").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(got) and sorted(got.values()) == list(range(1, 501))


def test_silhouette_of_copies_and_near_points(spark):
    """Copies are neighbours at distance 0 and never expanded into pairs; far from the origin no digits are lost."""
    rng = np.random.default_rng(6)
    base = 1e4 + rng.normal(size=(12, 3))
    x = np.concatenate([np.repeat(base, 3, axis=0), base + 1e-5])
    c = np.concatenate([np.repeat(np.arange(12) % 2, 3), np.arange(12) % 2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(len(x)):
        a, b = d[i, (c == c[i]) & (np.arange(len(x)) != i)].mean(), d[i, c != c[i]].mean()
        want[i] = (b - a) / max(a, b)
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(len(x))], "id long, cluster int, v array<double>")
    for block in (4096, 5):
        assert {r["id"]: r["silhouette"] for r in validity.silhouettes(df, block).collect()} == pytest.approx(want, abs=1e-9)
    assert validity.silhouette(df).first()[0] == pytest.approx(np.mean(list(want.values())), abs=1e-9)
    points = validity._point_silhouettes(validity._labelled(df), 4096)
    assert points.count() == 24 and points.agg(F.sum("w")).first()[0] == 48


def test_evaluation_row_of_copies_takes_the_exact_silhouette(spark):
    """Copies meet as one point, so a row of many copies has the silhouette of all its pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(8, 2))
    x, c = np.repeat(base, 50, axis=0), np.repeat(np.arange(8) % 2, 50)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a = np.array([d[i, c == c[i]].sum() / 199 for i in range(400)])
    b = np.array([d[i, c != c[i]].mean() for i in range(400)])
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(400)], "id long, cluster int, v array<double>")
    assert validity._point_silhouettes(validity._labelled(df), 4096).count() == 8
    row = validity.evaluation_row(df, "given", 2).first()
    assert row["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean()) and row["n_households_regular_clusters"] == 400


def test_distances_are_made_in_tiles():
    """A block meets another tile by tile, which stay in a core's cache: no 1,024 x 4,096 distances at once."""
    import tracemalloc

    import pyarrow as pa

    n, dims = 4096, 4
    x = np.random.default_rng(3).normal(size=(2 * n, dims))
    columns = {"cell": np.zeros(2 * n, np.int64), "asks": np.arange(2 * n) >= n, "id": np.arange(2 * n), "cluster": np.arange(2 * n) % 2, "w": np.ones(2 * n, np.int64)}
    batch = pa.RecordBatch.from_pydict({**columns, "v": pa.array(x.tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    out = pa.Table.from_batches(list(validity._block_sums([batch]))).to_pandas().set_index(["id", "cj"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # 1,024 x 4,096 distances are 34 MB
    for i in (n, 2 * n - 1):
        d = np.sqrt(((x[i] - x[:n:2]) ** 2).sum(axis=1))
        assert out.loc[(i, 0), "s"] == pytest.approx(d.sum()) and out.loc[(i, 0), "n"] == n // 2
