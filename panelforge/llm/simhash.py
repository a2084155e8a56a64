"""Near-duplicate classes of 64-bit SimHash fingerprints, by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import batch_of, cut, drop_cut, fresh, hot_keys, map_rows, spread_join, text_rows

#: Table buckets above this many fingerprints take the exact hub way instead of the join.
BUCKET_LIMIT = 64
#: Links that `components` may hand to one task, 4 MB of them.
AT_ONCE = 1 << 18


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text's word shingles, repeats included.

    A bit is 1 if set in over half the XXH64 hashes (seed 42).  Null and
    texts without a word give 0; fewer words than a shingle give one shingle.
    """
    words = bytes(raw).lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - shingle + 1)
    last = (ends - 1).tolist()[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + 65536)], last[at : at + 65536])], np.uint64) for at in range(0, n, 65536))


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """The unsigned fingerprint of 64-bit hashes, given in parts: a bit is 1 if set in over half of them."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row of `docs`."""

    def make():
        def run(batch):
            fp = np.array([fingerprint(x, shingle) for x in batch.column("raw").to_pylist()], np.uint64)
            return batch_of(doc_id=batch.column("doc_id"), fp=pa.array(fp.view(np.int64)))

        return run

    return map_rows(text_rows(docs), make, "doc_id long, fp long")


def _masks(low: int, high: int) -> Column:
    """0 and every single bit from `low` to under `high`, as signed longs."""
    bits = [0] + [1 << i for i in range(low, high)]
    return F.array(*[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in bits])


def near_links(fps: DataFrame, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b), a < b, that connect distinct fingerprints `fp` at `radius` 2 or less.

    Two 32-bit segments.  Of two fingerprints that differ in at most 2 bits,
    either the first segments differ in at most 1 bit or the second are equal:
    so each fingerprint probes the 33 keys of the radius-1 ball in its first
    segment and the one key of its second.  What it meets in the tables is
    checked with all 64 bits.

    Buckets over `bucket_limit` are left out of that join.  Their members go
    to hubs instead: each is tied to the smallest fingerprint among those at
    1 bit or less from a common centre.  A centre has at most 65 of them, all
    within 2 bits of each other, so hubs make only true links and connect
    whatever the left-out buckets would have linked, without all their pairs.
    """
    if radius != 2:
        raise ValueError("the two-segment scheme is built for a radius of 2")
    keys = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")),
    )
    total = fps.count()
    tables = cut(fps.select("fp", F.explode(keys).alias("k")).select("k.seg", "k.key", F.col("fp").alias("other")))
    sizes = cut(tables.groupBy("seg", "key").agg(F.count("*").alias("n")))
    # Keys of buckets that hold a large share of all fingerprints, and the keys that their balls probe: 33 for each.
    very = hot_keys(sizes, total, "seg", "key")
    around = F.transform(_masks(0, 32), lambda m: F.col("key").bitwiseXOR(m))
    probed = very and very.select("seg", F.explode(F.when(F.col("seg") == 0, around).otherwise(F.array("key"))).alias("key")).distinct()
    large = sizes.filter(F.col("n") > bucket_limit).select("seg", "key", F.lit(True).alias("hot"))
    tables = cut(spread_join(tables, large, ["seg", "key"], very, "left", large=True).withColumn("hot", F.coalesce("hot", F.lit(False))))
    ball = F.transform(_masks(32, 64), lambda m: F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(F.col("fp").bitwiseXOR(m), 32).alias("key")))
    exact = F.array(F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))
    probes = fps.select("fp", F.explode(F.concat(ball, exact)).alias("k")).select("fp", "k.seg", "k.key")
    met = spread_join(probes, tables.filter(~F.col("hot")).drop("hot"), ["seg", "key"], probed, large=True).select("fp", "other")
    members = tables.filter("hot").select(F.col("other").alias("fp")).distinct()
    near = members.select("fp", F.explode(F.transform(_masks(0, 64), lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    hubs = near.groupBy("centre").agg(F.min("fp").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    tied = near.join(hubs.hint("merge"), "centre").select("fp", "other")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    return (
        met.unionByName(tied)
        .filter((F.col("fp") != F.col("other")) & (differ <= radius))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
        .distinct()
    )


def spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reachable and node, for every end of the links (a, b) but these smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        for end in (x, y):
            np.minimum.at(root, root[end], least)
        while (root != root[root]).any():
            root = root[root]
    hung = root != np.arange(len(nodes))
    return nodes[root[hung]], nodes[hung]


def _forests(edges: DataFrame, total: int, at_once: int) -> DataFrame:
    """Edges (a, b) that connect what the `total` of `edges` connect: the stars (smallest node, node) of every `at_once` of them, in as few parts as that makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars():
            a, b = spanned(*(np.concatenate([x.column(end).to_numpy() for x in held]) for end in ("a", "b")))
            return batch_of(a=pa.array(a), b=pa.array(b))

        for batch in batches:
            for from_ in range(0, batch.num_rows, at_once):
                part = batch.slice(from_, at_once)
                if n + part.num_rows > at_once:
                    yield stars()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield stars()

    return edges.coalesce(max(1, -(-total // at_once))).mapInArrow(run, "a long, b long")


def components(links: DataFrame, at_once: int = 0) -> DataFrame:
    """node and root, the smallest node reachable, for every end of the links (a, b) but the roots.

    Alternates large-star and small-star steps (minimum of each neighbourhood,
    then re-hang) until the edges no longer change; each round is written out,
    and a hub's neighbours are only ever aggregated or joined, never collected.
    With `at_once` that many links at a time are first replaced by the stars
    they span, which needs no rounds if there are no more than these.
    """
    edges, state = cut(links), None
    if at_once:
        total, whole = edges.count(), edges
        edges = cut(_forests(whole, total, at_once))
        drop_cut(whole)
        if total <= at_once:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        total = edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        hubs = hot_keys(least, 2 * total, "a")
        large = spread_join(both.filter("b > a"), least.drop("n"), ["a"], hubs, large=True).select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        leaves = hot_keys(up, total, "b")
        small = spread_join(large, up.drop("n"), ["b"], leaves, large=True).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct()
        after = cut(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_cut(edges)
        edges = after
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def _classes(fps: DataFrame, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """fp, component_id and the root of its class; and the fingerprints of a large share of the rows."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = components(near_links(nodes.select("fp"), bucket_limit=bucket_limit))
    rooted = cut(nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", "n"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("nodes"))
    hubs = hot_keys(smallest, rooted.count(), "root", n="nodes")
    return spread_join(rooted, smallest.drop("nodes"), ["root"], hubs, large=True).select("fp", "component_id", "root"), hot_keys(rooted, fps.count(), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row of `docs`.

    component_id is the smallest doc_id reachable over links between
    fingerprints at 2 or fewer differing bits; null where none of them has a
    doc_id.  Null and empty texts have fingerprint zero and link like any
    other; texts of any length are read whole; null doc_ids get rows too and
    are ignored by that minimum; repeated rows stay; an empty table gives none.
    Other columns of `docs` are not read.
    """
    fps = cut(fingerprints(docs, shingle))
    classes, copied = _classes(fps, bucket_limit)
    return spread_join(fps, classes.drop("root"), ["fp"], copied, large=True).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of `docs` for each doc_id and text hash `h` in `kept`, with all columns, and the rows without doc_id.

    Of rows with the same doc_id and text, that with the least values in the other columns.
    """
    id_, h, turn = fresh(docs, "id"), fresh(docs, "h"), fresh(docs, "turn")
    named = docs.filter("doc_id is not null").withColumn(id_, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(F.col("text").cast("string")))
    found = named.join(kept.select(F.col("doc_id").alias(id_), F.col("h").alias(h)), [id_, h], "left_semi")
    rest = [F.hash(f"`{c}`") for c in docs.columns if c != "text"]
    once = Window.partitionBy(id_, h).orderBy(F.col("text").asc_nulls_last(), *rest)
    single = found.withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1)
    return single.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def without_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each near-duplicate class, with all columns: of its smallest doc_id, and of that its first text by hash.

    Classes are of texts, so two texts under one doc_id may both stay.  Rows
    without doc_id name no class and stay.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("h"))

    def make():
        def run(batch):
            fp = np.array([fingerprint(x, shingle) for x in batch.column("raw").to_pylist()], np.uint64)
            return batch_of(doc_id=batch.column("doc_id"), h=batch.column("h"), fp=pa.array(fp.view(np.int64)))

        return run

    fps = cut(map_rows(text_rows(hashed, "h"), make, "doc_id long, h long, fp long"))
    classes, _ = _classes(fps, BUCKET_LIMIT)
    least = fps.filter("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    kept = least.join(classes.hint("merge"), "fp").groupBy("root").agg(F.min("least").alias("least"))
    return one_of_each(docs, kept.select("least.doc_id", "least.h"))
