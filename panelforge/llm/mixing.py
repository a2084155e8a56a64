"""Mixing of sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import WORD, cut, fresh

#: Fractions this near to a whole number are whole.
EPS = 1e-9
#: Units that one node of the reduction tree rounds, on average.
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, n, target for every source of `sizes` (source, size).

    Sources by code point, null last, take the `weights` in turn and share
    `share` of all sizes by them; a target stops at `cap` times its source's
    size and the excess is shared anew by weight until none is above.  In
    closed form: sources sorted by cap / weight are capped as long as the
    level that the rest would get lies above theirs; that level rises up to the
    first free source and falls after it.  The windows run over one row for each source, pre-aggregated.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighted = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    weighted = weighted.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = weighted.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    free = F.when(F.col("level") * F.col("w") < F.col("limit"), F.col("level"))
    return level.withColumn("final", F.max(free).over(whole)).select(
        "source", "source_size", "n", F.least(F.col("limit"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("w")).alias("target")
    )


def _draw(seed: int, *parts: Column) -> Column:
    """A number from [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _pair(one: Column, two: Column, seed: int) -> tuple[Column, Column]:
    """The probabilities of two units after one pivotal step.

    A random amount of word mass goes from one to the other, up to where
    either probability turns 0 or 1; each keeps its expectation and the sum of
    size times probability is the same afterwards.
    """
    up = F.least((1 - one["p"]) * one["size"], two["p"] * two["size"])
    down = F.least(one["p"] * one["size"], (1 - two["p"]) * two["size"])
    rise = _draw(seed, one["doc_id"], one["size"], two["doc_id"], two["size"], one["p"], two["p"]) * (up + down) < down
    move = F.when(rise, up).otherwise(-down)

    def whole(p: Column) -> Column:
        return F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)

    return whole(one["p"] + move / one["size"]), whole(two["p"] - move / two["size"])


UNIT = "struct<doc_id:bigint,size:bigint,p:double>"


def _round_group(units: Column, seed: int) -> Column:
    """Array of units after pairing them along the array; at most the last stays fractional."""

    def unit(u: Column, p: Column) -> Column:
        return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), p.alias("p")).cast(UNIT)

    def step(state: Column, new: Column) -> Column:
        pair = F.struct(*[c.alias(n) for c, n in zip(_pair(state["carry"], new, seed), ("a", "b"))])
        moved = F.transform(F.array(pair), lambda q: F.struct(unit(state["carry"], q["a"]).alias("a"), unit(new, q["b"]).alias("b")))[0]
        return F.when(state["carry"].isNull(), F.struct(new.alias("carry"), state["done"].alias("done"))).otherwise(
            F.transform(
                F.array(moved),
                lambda m: F.when(
                    (m["b"]["p"] != 0.0) & (m["b"]["p"] != 1.0), F.struct(m["b"].alias("carry"), F.concat(state["done"], F.array(m["a"])).alias("done"))
                )
                .when((m["a"]["p"] != 0.0) & (m["a"]["p"] != 1.0), F.struct(m["a"].alias("carry"), F.concat(state["done"], F.array(m["b"])).alias("done")))
                .otherwise(F.struct(F.lit(None).cast(UNIT).alias("carry"), F.concat(state["done"], F.array(m["a"], m["b"])).alias("done"))),
            )[0]
        )

    start = F.struct(F.lit(None).cast(UNIT).alias("carry"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(units, start, step, lambda s: F.concat(s["done"], F.when(s["carry"].isNull(), F.array().cast(f"array<{UNIT}>")).otherwise(F.array(s["carry"]))))


def pivotal_copies(units: DataFrame, largest: int, seed: int) -> DataFrame:
    """Round the probabilities `p` of `units` (source, doc_id, size, p) to 0 or 1.

    A reduction tree: groups of some `FAN_IN` units of a source pair among
    themselves in parallel and each passes at most one fractional unit on to
    the next level, until a source has one group; `largest` is the number of
    units that the largest source has.  A source's last unit is drawn by its
    remaining probability, so the words of a source come out within one
    document of their expectation.  No group exceeds its share of a level, so
    a hot source only has more groups.
    """
    done, level, n = [], units, max(1, largest)
    while True:
        groups = max(1, math.ceil(n / FAN_IN))
        bucket = F.pmod(F.xxhash64(F.lit(seed + n), "doc_id", "size"), F.lit(groups))
        grouped = level.groupBy("source", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "p")), asc=False).alias("units"))
        rows = F.transform("units", lambda u: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["p"].alias("p")).cast(UNIT))
        rounded = cut(grouped.select("source", F.explode(_round_group(rows, seed)).alias("u")).select("source", "u.*"))
        fractional = (F.col("p") != 0.0) & (F.col("p") != 1.0)
        done.append(rounded.filter(~fractional))
        level = rounded.filter(fractional)
        if groups == 1:
            break
        n = groups
    last = level.withColumn("p", F.when(_draw(seed, F.col("doc_id"), F.col("size"), F.col("source")) < F.col("p"), 1.0).otherwise(0.0))
    for part in done:
        last = last.unionByName(part)
    return last


def mixed_sizes(
    sized: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for `sized` (doc_id, source, size)."""
    targets = cut(source_targets(sized, weights, share, cap))
    largest = targets.agg(F.max("n")).first()[0] or 0
    of = targets.select(F.col("source").alias("_of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = sized.join(of, F.col("source").eqNullSafe(F.col("_of"))).withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + EPS)).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).drop("_of")
    tiny = (F.col("p") < EPS) | (F.col("size") == 0)
    whole = each.filter(tiny).select("source", "doc_id", "size", F.lit(0.0).alias("p"))
    rounded = whole.unionByName(pivotal_copies(each.filter(~tiny).select("source", "doc_id", "size", "p"), largest, seed))
    final = rounded.join(of.withColumn("base", F.floor(rate + EPS)), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    copies = F.least(F.col("base") + F.col("p").cast("long"), F.lit(int(cap)))
    return final.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _size() -> Column:
    """The number of words of the text."""
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Copies of every row of `docs` (doc_id, text, source) that mix its sources to target weights.

    Size is the number of words; null and empty texts have size 0 and are
    taken as often as the whole part of their source's rate says.  A null
    source is a source of its own, the last one.  Null doc_ids and repeated
    rows stay, each rounded by itself; texts of any length count whole; ties
    are settled by hashes; an empty table mixes to none; other columns are not
    read.  The outcome depends on the rows alone, so reruns agree.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size")))
    return mixed_sizes(sized, weights, share, cap, seed)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of `docs`, with all columns, each as many times as `mix` takes a row of its doc_id, source and size.

    Rows that agree in these three are dealt their copies by the order of
    their texts; a null doc_id or source agrees with a null.  Only the keys
    of rows that share theirs with another row are ranked, so texts are not
    shuffled but for the join with their copies.  Rows that agree in all three
    meet in one task: many rows without doc_id, of one source and one size,
    would make it a long one.
    """
    key = [fresh(docs, n) for n in ("mix_id", "mix_of", "mix_size")]
    total, many, turn, again = (fresh(docs, n) for n in ("mix_copies", "mix_n", "mix_turn", "mix_again"))
    names = [f"`{c}`" for c in docs.columns]
    sums = mix(docs, weights, share, cap, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(total), F.count("*").alias(many))
    sums = sums.filter(F.col(total) > 0).select(*[F.coalesce(F.xxhash64(F.lit(i), c), F.lit(0)).alias(k) for i, (c, k) in enumerate(zip(("doc_id", "source", "size"), key))], total, many)
    own = (F.col("doc_id").cast("long"), F.col("source").cast("string"), _size())
    keyed = docs.select(*names, *[F.xxhash64(F.lit(i), c).alias(k) for i, (c, k) in enumerate(zip(own, key))])
    each = keyed.join(sums, key)
    alone = each.filter(F.col(many) == 1).select(*names, F.col(total).cast("int").alias(turn))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("text").asc_nulls_last()))
    shared = each.filter(F.col(many) > 1).withColumn(turn, rank)
    copies = F.expr(f"{total} div {many}").cast("int") + (F.col(turn) <= F.col(total) % F.col(many)).cast("int")
    dealt = alone.unionByName(shared.select(*names, copies.alias(turn)))
    return dealt.select(*names, F.explode(F.array_repeat(F.lit(True), F.col(turn))).alias(again)).drop(again)
