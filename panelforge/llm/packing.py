"""Packing of token sequences by best-fit decreasing."""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import batch_of, cut, decoded, map_rows, partitions, per_process, text_rows

#: Byte-level pre-tokens: contractions, runs of letters, digits or others with a leading space, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts with other characters are encoded by the library as a whole, as are those with very long runs of one kind.
_ODD = regex.compile(r"[^\t-\r\x20-\x7e\xa0-˿]")
LONG_RUN = 5000


def _plain(text: str) -> bool:
    if _ODD.search(text):
        return False
    words = [len(w) for w in text.split()]
    return len(text) - sum(words) - len(words) < LONG_RUN and max(words, default=0) < LONG_RUN


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Token bytes to id of a byte-level file, or None unless ids rank its merges.

    Where every merge makes the token whose id follows in order, merging by
    the smallest id of the joined token is merging by the file's list.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    hidden = [*range(33), *range(127, 161), 173]
    shown = {chr(256 + hidden.index(b)) if b in hidden else chr(b): b for b in range(256)}
    if pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] or model["end_of_word_suffix"] or model["ignore_merges"]:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    return {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}


class Encoder:
    """Encodes texts to little-endian 32-bit ids as the library of the file does.

    Plain texts go through an encoder that merges by rank, several times as
    fast and with the same outcome; all others, and texts with special
    strings, through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not self.fast or not _plain(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and `end_id`, cut at `capacity`.

    Only longer documents are cut: into full pieces, of which the first may
    be shorter.  Null texts are empty and hold `end_id` alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = per_process("encoder:" + tokenizer_path, lambda: Encoder(tokenizer_path))

        def run(batch):
            doc_id, piece, start, length, crc = [], [], [], [], []
            for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
                ids = encode(decoded(raw)) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc_id.append(key)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            return batch_of(
                doc_id=pa.array(doc_id, pa.int64()),
                piece=pa.array(piece, pa.int32()),
                start=pa.array(start, pa.int64()),
                length=pa.array(length, pa.int64()),
                ids_crc32=pa.array(crc, pa.int64()),
            )

        return run

    return map_rows(text_rows(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """A segment tree over remaining capacities that finds the tightest one with an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = remaining + self.leaves
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of `size` or more that an open bin has, in logarithmic time."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over items of which `counts` holds the number for each size.

    Items of a size are alike, and while best fit fills bins of one remaining
    capacity it does the same to each in turn.  So bins are kept as runs of
    equal remaining capacity and a step moves a whole run; the placing is the
    one that item-by-item best fit makes.  Returns steps (size, first item,
    items, first bin, items in each bin, offset in the bin); their number
    depends on the capacity, not on the number of items.
    """
    tree, runs, steps, bins = CapacityTree(capacity), defaultdict(list), [], 0
    for size in sorted(counts, reverse=True):
        done, n = 0, counts[size]
        while done < n:
            r = tree.tightest(size)
            if r is None:  # open as many bins as the rest of the size fills
                each = capacity // size
                runs[capacity].append((bins, -(-(n - done) // each)))
                tree.add(capacity, runs[capacity][-1][1])
                bins += runs[capacity][-1][1]
                r = capacity
            each = r // size
            first, there = runs[r].pop()
            if n - done < each:
                each = n - done
            take = min(there, (n - done) // each)
            steps.append((size, done, take * each, first, each, capacity - r))
            done += take * each
            tree.add(r, -take)
            if there > take:
                runs[r].append((first + take, there - take))
            left = r - each * size
            if left:
                runs[left].append((first, take))
                tree.add(left, take)
    return steps


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces with a `length` of 1 to `capacity`.

    Only the number of pieces for each length (at most `capacity` numbers)
    reaches the driver, which plans with them; pieces find their place by
    their rank among those of their length.  Ranks come from a window over
    (length, salt) with as many salts as shuffle partitions, so one very
    common length does not meet in one task.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    steps = best_fit_plan(counts, capacity)
    by_size = [(size, sorted((s[1], s[3], s[4], s[5]) for s in steps if s[0] == size)) for size in sorted(counts)]
    plan = spark.createDataFrame(by_size, "length long, steps array<struct<first:long,bin:long,each:long,at:long>>")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in columns]), F.lit(partitions(spark))))
    order = Window.partitionBy("length").orderBy("_salt")
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_row", F.row_number().over(within) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    placed = ranked.join(F.broadcast(plan), "length").withColumn("_step", F.element_at(F.filter("steps", lambda s: s["first"] <= F.col("_rank")), -1))
    k = F.col("_rank") - F.col("_step.first")
    return placed.select(
        *columns,
        (F.col("_step.bin") + F.expr("(_rank - _step.first) div _step.each")).alias("sequence_id"),
        (F.col("_step.at") + k % F.col("_step.each") * F.col("length")).alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece of `docs`, with the sequence it goes to and its offset there.

    Null and empty texts hold the end id alone; texts of any length are
    encoded whole, then cut; repeated rows are packed each; null doc_ids stay;
    an empty table packs to none; other columns are not read.
    """
    return pack(cut(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)


