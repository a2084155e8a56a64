"""Exact top-k inner-product search over impact-ordered postings, score at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import batch_of, cut

#: Vectors of one index block.
INDEX_BLOCK = 8192
#: Quantised levels of a dimension's postings.
LEVELS = 32
#: Share of a block's rows, or multiple of k, that may be left open when the proof ends the reading.
OPEN_SHARE, OPEN_K = 1 / 128, 4
#: Postings are read in batches of some `1 / ROUNDS` of the block's, each followed by the proof.
ROUNDS = 16
#: Sums of products stay exact in 64-bit floats below this.
_EXACT = 1 << 52


class ImpactIndex:
    """Postings of a block of integer vectors by dimension, by falling magnitude, cut where the quantised magnitude changes.

    `read` counts what `search` has done: queries, queries that stopped on
    proof, postings read, postings held, rows rescored.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        size = np.abs(vectors)
        order = np.argsort(-size, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T).ravel()  # postings of dimension 0, of dimension 1, ...
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T).ravel()
        self.top = int(size.max(initial=0))
        fine = np.ascontiguousarray(np.take_along_axis(size, order, axis=0).T)
        level = fine * levels // (self.top + 1)
        new = np.c_[np.ones((dims, 1), bool), level[:, 1:] != level[:, :-1]].ravel()
        self.first = np.flatnonzero(new)  # where segments begin
        self.last = np.r_[self.first[1:], n * dims]
        self.dim = self.first // n
        self.most = fine.ravel()[self.first]  # the greatest magnitude of a segment
        self.read = dict.fromkeys(("queries", "proven", "postings", "held", "rescored"), 0)

    def bound(self, query: np.ndarray) -> int:
        """No row's score is above this."""
        return int(sum(abs(q) * m for q, m in zip(query.tolist(), self.most[np.searchsorted(self.dim, np.arange(len(query)))].tolist())))

    def search(self, query: np.ndarray, own: int, k: int, bar: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) but for the row `own`: highest scores, ties to smaller ids.

        Rows under `bar`, a score that k other rows are known to reach, may be missing.
        """
        n, dims = self.vectors.shape
        q = query.astype(np.int64)
        if int(np.abs(q).max(initial=0)) * self.top * dims >= _EXACT:  # beyond exact sums of floats: plain integers
            score = [sum(a * b for a, b in zip(q.tolist(), v)) for v in self.vectors.tolist()]
            return sorted(((s, i) for s, i in zip(score, self.ids.tolist()) if i != own), key=lambda x: (-x[0], x[1]))[:k]
        self.read["queries"] += 1
        self.read["held"] += n * dims
        impact = np.abs(q)[self.dim] * self.most
        order = np.argsort(-impact, kind="stable")
        impacts = impact[order]
        ends = np.cumsum((self.last - self.first)[order])
        begun = np.zeros(dims, bool)
        partial, seen = np.zeros(n), np.zeros(n)
        possible = self.ids != own
        free = int(possible.sum())
        enough = max(OPEN_K * k, int(n * OPEN_SHARE))
        heads = self.most[np.searchsorted(self.dim, np.arange(dims))] * np.abs(q)
        at = 0
        while at < len(order) and impacts[at] and free > enough:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + n * dims / ROUNDS, side="right")))
            segments = order[at:to]
            sizes = (self.last - self.first)[segments]
            posting = np.repeat(self.first[segments] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            rows = self.rows[posting]
            partial += np.bincount(rows, np.repeat(q[self.dim[segments]], sizes) * self.values[posting], n)
            seen += np.bincount(rows, minlength=n)
            begun[self.dim[segments]] = True
            self.read["postings"] += len(rows)
            at = to
            # What a row has yet to get: the next impact for each dimension begun but not read for
            # the row, the whole impact of the first segment for each dimension not begun.
            following = int(impacts[at]) if at < len(order) else 0
            open_ = int(heads[~begun].sum()) + (int(begun.sum()) - seen) * following
            lower = np.where(self.ids != own, partial - open_, -np.inf)
            least = np.partition(lower, n - k)[n - k] if free >= k else -np.inf
            possible = (self.ids != own) & (partial + open_ >= (least if bar is None else max(least, bar)))
            if int(possible.sum()) <= enough:
                break
        rows = np.flatnonzero(possible)
        self.read["proven"] += len(rows) <= enough
        self.read["rescored"] += len(rows)
        score = self.vectors[rows] @ q
        best = np.lexsort((self.ids[rows], -score))[:k]
        return list(zip(score[best].tolist(), self.ids[rows][best].tolist()))


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: components as floor(scale * x), without vectors that are null or hold null or non-finite components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.col("vec_id").isNotNull()
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _answers(k: int):
    """Arrow map over rows sorted by (dims, ib, query): builds a block's index once and streams the queries past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, ids, rows = None, None, [], []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for dims, ib, query, key, v, bar in zip(*(batch.column(c).to_pylist() for c in ("dims", "ib", "query", "vec_id", "v", "bar"))):
                if (dims, ib) != block:
                    block, index, ids, rows = (dims, ib), None, [], []
                if not query:
                    ids.append(key)
                    rows.append(v)
                    continue
                if index is None and ids:
                    by = np.argsort(np.array(ids, np.int64), kind="stable")
                    index = ImpactIndex(np.array(ids, np.int64)[by], np.array(rows, np.int64)[by])
                    ids, rows = [], []
                if index is not None:
                    q = np.array(v, np.int64)
                    if bar is None or index.bound(q) >= bar:
                        found += [(key, i, s) for s, i in index.search(q, key, k, bar)]
            if found:
                yield batch_of(**{n: pa.array([x[j] for x in found], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, index_block: int = INDEX_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products with the other rows.

    Rows are dealt over index blocks.  Every query first asks one block; its
    k-th score there is its bar for all other blocks, which skip it if even
    their greatest magnitudes can't reach the bar.  A task builds a block's
    index once and streams queries past it, so it holds one block and one
    batch of queries, whatever the input size, and passes on at most k rows
    for each query.  Reading ends early only where the bound proves that no
    other row can reach the k best, and all that could are scored exactly, so
    the result is exact.

    A query's own row, by id, is no candidate; fewer others give fewer rows;
    vectors of another length than the query's are no candidates; ties go to
    the smaller id; repeated ids stay candidates of others and ask once, with
    their least vector; an empty table, or one without queries, gives none;
    other columns are not read.
    """
    rows = cut(quantised(vectors, scale).withColumn("dims", F.size("v")).filter("dims > 0"))
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dims")).alias("q")).select("vec_id", "q.v", "q.dims")
    blocks = max(1, math.ceil(rows.count() / index_block))
    index = rows.select("dims", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("ib"), F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("long").alias("bar"))
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")

    def asked(queries: DataFrame, ib: Column, bar: Column) -> DataFrame:
        together = index.unionByName(queries.select("dims", ib.alias("ib"), F.lit(True).alias("query"), "vec_id", "v", bar.alias("bar")))
        dealt = together.repartition(blocks, "dims", "ib") if blocks > 1 else together.repartition("dims", "ib")
        return dealt.sortWithinPartitions("dims", "ib", "query").mapInArrow(_answers(k), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = asked(queries, own, F.lit(None).cast("long"))
    if blocks > 1:
        first = cut(first)
        bars = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
        barred = queries.join(bars, F.col("vec_id") == F.col("query_id"), "left")
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != own))
        first = first.unionByName(asked(barred.select("*", others.alias("to")), F.col("to"), F.col("bar")))
    return ranked(first).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
