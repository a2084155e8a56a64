"""Near-duplicate classes by the Jaccard similarity of word-shingle sets: SimHash fingerprints find pairs first, min-wise bands the rest, the sets decide."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import batch_of, cut, drop_cut, free_shuffles, hot_keys, map_rows, spread_join
from panelforge.llm.simhash import AT_ONCE, components, fingerprint_of, near_links, one_of_each

#: Words of a shingle.
SHINGLE = 5
#: Bands and minima of each: a pair of similarity 0.8 shares no band with probability 1.3e-7, (1 - 0.8 ** 5) ** 40.
BANDS, ROWS = 40, 5
#: Members of a bucket that all others of it are compared with first.
CENTRES = 4
#: Sets of a bucket that meet as many others at once; a larger bucket is dealt over blocks.
BLOCK = 4096
#: Minima of a sketch, with 4 bits each; the first are those of the bands.
SKETCH = 512
WORDS = SKETCH * 4 // 64
#: Standard deviations that a sketch may fall short of what it should show: one pair at the limit in a million does.
SLACK = 4.75

_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(43).integers(1, 1 << 63, (BANDS, ROWS + 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes (seed 42) of a text's word shingles in their order, repeats included.

    Null and texts without a word give none; fewer words than a shingle give one.
    """
    words = bytes(raw).lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, last = [0, *ends[:-1].tolist()][:n], (ends - 1).tolist()[len(words) - n :]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, last)), np.uint64, n)


def shingle_set(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(raw, shingle))


def _minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS).min(axis=0))
    return least ^ (least >> np.uint64(29))


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band, equal where all minima of the band are."""
    return (minima[: BANDS * ROWS].reshape(BANDS, ROWS) * _MIX[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _MIX[:, ROWS]


def sketch(minima: np.ndarray) -> np.ndarray:
    """4 bits of each minimum, 16 of them in a word."""
    bits = ((minima * _MIX[0, 0]) >> np.uint64(60)).reshape(WORDS, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def _text(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("raw"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text hash `h`, set hash `fp`, fingerprint `sim`, set size `n`, band keys and sketch words for every row; empty sets have no keys."""

    def make():
        def run(batch):
            sets, sim = [], []
            for raw in batch.column("raw").to_pylist():
                hashes = shingle_hashes(raw)
                sim.append(fingerprint_of(hashes[at : at + 65536] for at in range(0, len(hashes), 65536)))
                sets.append(np.unique(hashes))
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            minima = [_minima(s) for s in sets]
            keys = pa.array([band_keys(m).view(np.int64) if len(s) else [] for m, s in zip(minima, sets)], pa.list_(pa.int64()))
            words = np.array([sketch(m) for m in minima]).view(np.int64).reshape(len(sets), WORDS)
            return batch_of(
                doc_id=batch.column("doc_id"), h=batch.column("h"), fp=pa.array(fp), sim=pa.array(np.array(sim, np.uint64).view(np.int64)), n=pa.array([len(s) for s in sets], pa.int64()), keys=keys, **{f"s{i}": pa.array(words[:, i].copy()) for i in range(WORDS)}
            )

        return run

    return map_rows(_text(docs), make, "doc_id long, h long, fp long, sim long, n long, keys array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS)))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and its shingle hashes, from one text of each hash `h` in `wanted`."""

    def make():
        def run(batch):
            sets = [shingle_set(x) for x in batch.column("raw").to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            return batch_of(fp=pa.array(fp), hashes=pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))

        return run

    texts = _text(docs).select("h", "raw").groupBy("h").agg(F.first("raw").alias("raw")).join(wanted, "h", "left_semi")  # copies go before the shuffle
    return cut(map_rows(texts.select("raw"), make, "fp long, hashes array<long>").dropDuplicates(["fp"]))


def _verified(ends: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among the pairs (a, b) of `ends`: those whose sets are `percent` similar or more."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("fp").alias("b"), F.col("hashes").alias("of_b"))
    both = ends.distinct().join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return cut(both.filter((100 + percent) * shared >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b"))


def _alike(percent: int, first: bool) -> Column:
    """Whether sizes and sketches of x and y allow `percent` similarity and, if asked, their bucket is the first that they share.

    A condition of the join, so other pairs never become rows, nor does a pair for each bucket that it shares.
    """
    least, most = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    ones = 0x1111111111111111
    differ = F.lit(0)
    for i in range(WORDS):
        z = F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        differ = differ + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(ones)))
    same = percent / 100 + (1 - percent / 100) / 16
    enough = SKETCH - differ >= int(SKETCH * same - SLACK * math.sqrt(SKETCH * same * (1 - same)))
    able = (F.col("x.fp") != F.col("y.fp")) & (100 * least >= percent * most) & enough
    return able & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")) if first else able


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets `nodes` whose SimHash fingerprints differ in 2 bits or less, enough to connect them all.

    Fingerprints meet by multi-index hashing, as `near_links` says; the least
    set of each stands for it, and the others with the same are tied to that one.
    """
    known = nodes.filter("n > 0").select("sim", "fp")
    first = cut(known.groupBy("sim").agg(F.min("fp").alias("least"), F.count("*").alias("n")))
    hot = hot_keys(first, known.count(), "sim")
    same = spread_join(known, first.drop("n"), ["sim"], hot, large=True).filter("fp != least").select(F.col("fp").alias("x"), F.col("least").alias("y"))
    links = near_links(first.select(F.col("sim").alias("fp")))
    ends = [first.select(F.col("sim").alias(end), F.col("least").alias(to)) for end, to in (("a", "x"), ("b", "y"))]
    met = links.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select("x", "y")
    pairs = cut(same.unionByName(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    drop_cut(first)
    return pairs


def similar_links(docs: DataFrame, nodes: DataFrame, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the sets `nodes` of `docs` at `percent` similarity or more; the sets themselves are compared.

    Sets whose fingerprints are near are compared first (`simhash_pairs`).
    64 bits reach few of the pairs at 80 percent, so those that are not in one
    class yet are compared too if they share a band key, unless their sketches
    rule it out.  All members of a bucket are first compared with a few, the same ones
    in all buckets where possible; then pairs that are not in one class yet.
    So no class is lost and few of a large bucket's pairs become rows.
    Buckets of over `block` sets are dealt over blocks that meet one by one.
    Tables and shuffles on the way are given up as soon as nothing reads them.
    """
    spark = nodes.sparkSession
    each = nodes.select("fp", "h", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    found = cut(each.join(sizes, "key"))
    near_bits = simhash_pairs(nodes)
    ends = near_bits.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = _sets(docs, found.select("h").unionByName(nodes.join(ends.hint("merge"), "fp").select("h")).distinct())
    linked = _verified(near_bits, sets, percent)
    drop_cut(near_bits)
    tied = components(linked, AT_ONCE)
    free_shuffles(spark)
    first = F.array_distinct(F.array(*[F.min_by("fp", F.xxhash64("fp", F.lit(i))) for i in range(CENTRES)]))
    centres = found.groupBy("key").agg(first.alias("centres"))
    words = [f"s{i}" for i in range(WORDS)]
    rooted = nodes.select("fp", "n", "keys", *words).join(tied.hint("merge"), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    members = cut(found.select("key", "fp", "size").join(centres, "key").join(rooted, "fp").withColumn("centre", F.array_contains("centres", F.col("fp"))).drop("centres"))
    drop_cut(found)
    number, of = F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / block)), F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1)

    dealt = members.withColumn("i", number).alias("x")
    to_all = members.filter("centre").withColumn("i", F.explode(of)).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.root") != F.col("y.root"))
    near = linked.unionByName(_verified(_ends(dealt.join(to_all, same & _alike(percent, False))), sets, percent))

    roots = components(near, AT_ONCE)
    free_shuffles(spark)
    rooted = members.drop("root").join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "size", "n", "keys", *words, F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    open_ = cut(rooted.join(several, "key"))
    drop_cut(members)
    free_shuffles(spark)
    x = open_.withColumn("i", number).withColumn("j", F.explode(of)).alias("x")
    y = open_.withColumn("j", number).withColumn("i", F.explode(of)).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.root") < F.col("y.root"))
    last = _verified(_ends(x.join(y, same & _alike(percent, True))), sets, percent)
    for done in (open_, sets):
        drop_cut(done)
    return near.unionByName(last)


def without_near_duplicates(docs: DataFrame, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row of each class of texts linked by `percent` similarity or more, that of its smallest doc_id, with all columns.

    Texts without a word, null ones included, are one class; texts of any
    length are read whole; rows without doc_id name no class and stay.  Of
    rows with the same doc_id and text one stays.  An empty table gives none.
    """
    rows = cut(signatures(docs))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))
    nodes = cut(rows.groupBy("fp").agg(F.min(named).alias("least"), F.min("sim").alias("sim"), *[F.first(c).alias(c) for c in ("h", "n", "keys", *[f"s{i}" for i in range(WORDS)])]))
    drop_cut(rows)
    roots = components(similar_links(docs, nodes, percent, block), AT_ONCE)
    classes = nodes.select("fp", "least").join(roots, nodes.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("class")).agg(F.min("least").alias("least"))
    kept = cut(classes.filter("least is not null").select("least.doc_id", "least.h"))
    drop_cut(nodes)
    drop_cut(roots)
    free_shuffles(docs.sparkSession)
    return one_of_each(docs, kept)
