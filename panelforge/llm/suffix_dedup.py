"""Removal of byte passages that occur earlier in the corpus, by common-prefix intervals.

A suffix array of the whole corpus is cut into pieces that tasks can hold.
Every string of `length` bytes has an anchor: the smallest hash among its
k-grams.  Equal strings have equal anchors, so each anchor hash owns the
suffixes whose first `length` bytes it anchors, and repeats are found inside
the anchors that occur more than once, on the bytes around them alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import batch_of, cut, drop_cut, free_shuffles, hot_keys, map_rows, spread_join
from panelforge.llm.suffix import maximal_repeats, suffix_array

#: Bytes hashed at once, and bytes of the contexts that share a suffix array.
SEGMENT = 1 << 20
CONTEXT_BYTES = 1 << 19
#: Different contexts that a suffix array takes of one anchor; those of a hotter anchor are split by longer common parts.
ANCHOR_LIMIT = 512
#: Bytes of an anchor's k-gram.
GRAM = 32
#: A run of starts travels as one number: its first start, its last and its anchor past that, 7 bits each for these.
_BITS = 7
#: Starts of a stretch, by which hot anchors are split, and then what is hot still; single starts have but one string each.
STRETCHES = (16, 4, 1)
LAST_ID = (1 << 63) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from every place on, built by doubling."""
    h = _mix((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    done, size, width = None, 0, 1
    while True:
        if gram & width:
            if done is None:
                done = h.copy()
            else:
                n = len(text) - size - width + 1
                done = _mix(done[:n] * np.uint64(0x94D049BB133111EB) + h[size : size + n])
            size += width
        if size == gram:
            return done
        n = len(h) - width
        h = _mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
        width *= 2


def anchors(raws: list[bytes], length: int = 100, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays text, lo, hi, at, hash: starts lo..hi of `length`-byte strings of a text that share the anchor at `at`.

    Every start is in one run.  The anchor is the leftmost smallest k-gram
    hash inside the string, so it depends on the string alone.
    """
    window = length - gram + 1
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        if not parts:
            return
        text = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        h = gram_hashes(text, gram)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < window:
            key = np.minimum(key[: len(key) - (window - width)], key[window - width :])
        sizes = np.array([len(p[2]) for p in parts])
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        starts = sizes - length + 1
        owner = np.repeat(np.arange(len(parts)), starts)
        place = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
        at = (key[begin[owner] + place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[new[1:], len(at)] - 1
        of = owner[new]
        shift = np.array([p[1] for p in parts])[of]
        found = (np.array([p[0] for p in parts])[of], place[new] + shift, place[last] + shift, at[new] - begin[of] + shift, h[at[new]].view(np.int64))
        for kept, a in zip(out, found):
            kept.append(a)
        parts.clear()

    for i, raw in enumerate(raws):
        for a in range(0, len(raw) - length + 1, SEGMENT):
            parts.append((i, a, raw[a : a + SEGMENT + length - 1]))
            size += len(parts[-1][2])
            if size > SEGMENT:
                flush()
                size = 0
    flush()
    return tuple(np.concatenate([*k, np.zeros(0, np.int64)]).astype(np.int64) for k in out)


def repeat_groups(contexts: list[bytes], length: int = 100) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, contexts, offsets) of every maximal repeat of `length` bytes or more, with all occurrences.

    One enhanced suffix array over the contexts, which no repeat crosses.
    """
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    symbols = np.empty(int(sizes.sum()), np.int64)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    ends = begin + sizes - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    symbols[ends] = 256 + np.arange(len(contexts))
    before = np.r_[np.int64(0), symbols[:-1]]
    before[begin] = -1 - np.arange(len(contexts))
    sa, common = suffix_array(symbols)
    for size, a, b in maximal_repeats(sa, common, before, length):
        where = sa[a:b]
        yield size, owner[where], where - begin[owner[where]]


def _text(docs: DataFrame) -> DataFrame:
    """doc_id, the document's key (d, t), raw and sha: rows with the same doc_id and text are one document."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).withColumn("sha", F.sha2("raw", 256))
    return rows.withColumn("d", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("t", F.xxhash64("sha"))


def _context_rows(reps: DataFrame, length: int) -> DataFrame:
    """h, rid, lo, k, b: the bytes around anchors whose hash occurs more than once; k is the anchor's place less lo."""
    spark = reps.sparkSession

    def make():
        def run(batch):
            text, lo, hi, at, h = anchors(batch.column("raw").to_pylist(), length)
            return batch_of(h=pa.array(h), rid=batch.column("rid").take(pa.array(text)), run=pa.array((((lo << _BITS) + hi - lo) << _BITS) + at - lo))

        return run

    found = cut(map_rows(reps.select("rid", "raw"), make, "h long, rid long, run long"))
    again = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    free_shuffles(spark)
    runs = again.agg(F.sum("n")).first()[0] or 0
    shared = cut(spread_join(found, again.select("h"), ["h"], hot_keys(again, runs, "h")).groupBy("rid").agg(F.collect_list(F.struct("h", "run")).alias("runs")))
    drop_cut(found)
    free_shuffles(spark)

    def piece(r):
        low = (1 << _BITS) - 1
        lo, more, k = F.shiftright(r["run"], 2 * _BITS).cast("int"), F.shiftright(r["run"], _BITS).bitwiseAND(low).cast("int"), r["run"].bitwiseAND(low).cast("int")
        return F.struct(r["h"].alias("h"), lo.alias("lo"), k.alias("k"), F.substring(F.col("raw"), lo + 1, more + length).alias("b"))

    contexts = cut(reps.join(shared, "rid").select("rid", F.explode(F.transform("runs", piece)).alias("p")).select("p.h", "rid", "p.lo", "p.k", "p.b"))
    drop_cut(again)
    drop_cut(shared)
    free_shuffles(spark)
    return contexts


def _spans_in_arrays(contexts: DataFrame, length: int) -> DataFrame:
    """rid, a, b: repeats that are not the first, from suffix arrays over whole anchors (h, rid, lo, b)."""

    def spans(rows):
        rids, doc = np.unique([r[1] for r in rows], return_inverse=True)
        lo = np.array([r[2] for r in rows], np.int64)
        out: list[np.ndarray] = []
        for size, which, offset in repeat_groups([r[3] for r in rows], length):
            place = (doc[which] << 32) + lo[which] + offset
            later = place[place > place.min()]
            if len(later):
                out.append(np.stack([later, np.full(len(later), size)]))
        if not out:
            return None
        place, size = np.concatenate(out, axis=1)
        by = np.lexsort((size, place))
        place, size = place[by], size[by]
        end = np.maximum.accumulate(place + size)  # spans of a text that touch are one
        new = np.r_[True, place[1:] > end[:-1]]
        first, stop = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(place)] - 1
        return batch_of(
            rid=pa.array(rids[place[first] >> 32], pa.int64()),
            a=pa.array(place[first] & 0xFFFFFFFF, pa.int32()),
            b=pa.array(end[stop] & 0xFFFFFFFF, pa.int32()),
        )

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "rid", "lo", "b"))):
                if size > CONTEXT_BYTES and row[0] != last:
                    if (out := spans(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows and (out := spans(rows)) is not None:
            yield out

    together = contexts.select("h", "rid", "lo", "b").repartition("h").sortWithinPartitions("h")
    return together.mapInArrow(run, "rid long, a int, b int")


def _collapsed(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of contexts (h, rid, lo, k, b): the first of those with equal bytes, and spans (rid, a, b) of all others.

    The aggregate that finds the first combines before its shuffle.
    """
    keyed = contexts.withColumn("m", F.md5("b"))
    counted = cut(keyed.groupBy("h", "m").agg(F.min(F.struct("rid", "lo", "k", "b")).alias("f"), F.count("*").alias("n")))
    first_of = counted.filter("n > 1").select("h", "m", F.struct("f.rid", "f.lo").alias("first"))
    hot = hot_keys(counted, contexts.count(), "h", "m")
    members = keyed.select("h", "m", "rid", "lo", F.length("b").alias("size"))
    again = spread_join(members, first_of, ["h", "m"], hot).filter(F.struct("rid", "lo") > F.col("first"))
    return counted.select("h", "f.*"), cut(again.select("rid", F.col("lo").alias("a"), (F.col("lo") + F.col("size")).cast("int").alias("b")))


def _stretches(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts (h, rid, lo, k, b) cut into stretches of at most `width` starts, with keys of their own.

    Stretches are laid out from the anchor.  All strings of a stretch hold
    its core, the bytes from its last start to the end of its first string;
    core and number of the stretch make the new key, so equal strings meet.
    """
    starts = F.length("b") - length  # the last start, from lo
    number = F.sequence(F.floor((F.col("k") - starts) / width).cast("int"), F.floor(F.col("k") / width).cast("int"))

    def stretch(q):
        last = F.col("k") - q * width
        begin, end = F.greatest(F.lit(0), last - (width - 1)), F.least(starts, last)
        return F.struct(
            F.xxhash64("h", q, F.substring("b", last + 1, F.lit(length - width + 1))).alias("h"),
            (F.col("lo") + begin).cast("int").alias("lo"),
            (F.col("k") - begin).cast("int").alias("k"),
            F.substring("b", begin + 1, end - begin + length).alias("b"),
        )

    return contexts.select("rid", F.explode(F.transform(number, stretch)).alias("x")).select("x.h", "rid", "x.lo", "x.k", "x.b")


def repeated_spans(reps: DataFrame, length: int = 100, anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """rid, spans: byte spans (a, b) of `reps` (rid, raw) that repeats of `length` bytes or more with an earlier place cover.

    Earlier is a smaller rid, or before it in the same text.  Contexts of an
    anchor meet in a suffix array, equal ones as one.  Anchors with more than
    `anchor_limit` different contexts are split by the longer common parts of
    stretches of starts, whose contexts meet in suffix arrays of their own;
    what is still too large by those of shorter stretches.  The strings from a
    single start that share a key are equal, so nothing is left after these.
    """
    spark, parts = reps.sparkSession, []
    contexts = _context_rows(reps, length)
    for width in (*STRETCHES, 0):
        firsts, again = _collapsed(contexts)
        parts.append(again)
        drop_cut(contexts)
        free_shuffles(spark)
        counted = firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
        met = spread_join(firsts, counted, ["h"], hot_keys(counted, firsts.count(), "h"))
        parts.append(_spans_in_arrays(met.filter(F.col("n") <= anchor_limit).drop("n"), length))
        hot = met.filter(F.col("n") > anchor_limit).drop("n")
        if not width or counted.filter(F.col("n") > anchor_limit).isEmpty():
            break
        contexts = cut(_stretches(hot, length, width))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    return spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _kept(raw: bytes, spans: list[dict]) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, SHA-256 of the rest."""
    digest, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > end:
            runs += 1
        if a > at:
            digest.update(raw[at:a])
        if b > at:
            removed += b - max(a, at)
            at = b
        end = max(end, b)
    digest.update(raw[at:])
    return removed, runs, digest.hexdigest()


def deduplicated(docs: DataFrame, length: int = 100, anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`.

    A byte goes if a `length`-byte string over it also starts earlier, at a
    smaller doc_id or before it in the same document, on the input's bytes.
    Rows with the same doc_id and text are one document; of different texts
    with one doc_id the order is fixed but arbitrary; rows without doc_id come
    last.  Null texts are empty; texts of any length are cut whole, in
    segments that overlap.  Of equal places the first stays.  An empty table
    gives none; other columns are not read.

    Exact copies of an earlier document are settled by their digest: all goes
    if they have `length` bytes.
    """
    spark = docs.sparkSession
    empty = hashlib.sha256(b"").hexdigest()
    ids = cut(_text(docs).select("doc_id", "d", "t", "sha", F.length("raw").cast("long").alias("n_bytes")))
    total = ids.count()
    first = cut(ids.groupBy("sha").agg(F.min("d").alias("first_d"), F.count("*").alias("n")))
    known = spread_join(ids, first.drop("n"), ["sha"], hot_keys(first, total, "sha"))
    known = cut(known.withColumn("copy", (F.col("d") > F.col("first_d")) & (F.col("n_bytes") >= length)))
    repeated = hot_keys(ids.groupBy("d", "t").agg(F.count("*").alias("n")), total, "d", "t")
    alone = known.filter((F.col("n_bytes") >= length) & ~F.col("copy")).select("d", "t").distinct()
    # Numbers in the order of the documents: ranges by (d, t), counted within them.
    numbered = cut(alone.repartitionByRange("d", "t").sortWithinPartitions("d", "t").withColumn("rid", F.monotonically_increasing_id()))
    reps = cut(spread_join(_text(docs).select("d", "t", "raw"), numbered, ["d", "t"], repeated))
    free_shuffles(spark)
    spans = cut(repeated_spans(reps, length, anchor_limit))
    free_shuffles(spark)

    def make():
        def run(batch):
            rows = [_kept(r, s) for r, s in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist())]
            return batch_of(
                d=batch.column("d"),
                t=batch.column("t"),
                removed=pa.array([r[0] for r in rows], pa.int64()),
                runs=pa.array([r[1] for r in rows], pa.int64()),
                kept=pa.array([r[2] for r in rows], pa.string()),
            )

        return run

    cutout = map_rows(reps.join(spans, "rid").select("d", "t", "raw", "spans"), make, "d long, t long, removed long, runs long, kept string").dropDuplicates(["d", "t"])
    return spread_join(known, cutout, ["d", "t"], repeated, "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
