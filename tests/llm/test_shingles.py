"""The near-duplicate stage against all pairs of shingle sets."""

import os
import random

import pytest

import corpus_pipeline
from panelforge.functions.storage import shared_dir
from panelforge.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string"


def near_copies(spark):
    """Edited copies far beyond two fingerprint bits, dense groups, odd texts and repeated ids."""
    r = random.Random(4)
    words = ["".join(r.choice("aeioubcdst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows = [None, "", " \t", "one", "One", "two words"]
    for _ in range(30):
        base = text(120)
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            copy = list(base)
            for at in r.sample(range(120), edits):
                copy[at] = r.choice(words)
            rows.append(" ".join(copy))
    base = text(100)
    for _ in range(60):
        copy = list(base)
        copy[r.randrange(100)] = r.choice(words)
        rows.append(" ".join(copy))
    return spark.createDataFrame([*[(i, t, "en") for i, t in enumerate(rows)], (None, rows[9], "en"), (20, rows[20], "en")], SCHEMA), rows


@pytest.mark.parametrize("limit", [64, 2])
def test_classes_match_all_pairs(spark, limit):
    docs, rows = near_copies(spark)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [grams(t) for t in rows], list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                i_, j_ = top(i), top(j)
                group[max(i_, j_)] = min(i_, j_)
    kept = shingles.without_near_duplicates(docs, block=limit)
    assert kept.columns == docs.columns
    got = [x["doc_id"] for x in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted({top(i) for i in range(len(rows))})
    assert got.count(None) == 1
    assert shingles.without_near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_edited_copies(spark):
    docs, _ = near_copies(spark)
    ids = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert 6 in ids and not ids & {7, 8}
    assert {7, 8} & {x["doc_id"] for x in simhash.without_near_duplicates(docs).collect()}


def test_stage_links_by_simhash(spark):
    """Without a band key, the fingerprints alone link what lies within 2 bits, and the sets confirm it."""
    r = random.Random(9)
    words = ["".join(r.choice("aeioubcdst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(900)]
        rows.append(" ".join(base))
        rows += [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in (0, 450)]
    rows += [rows[0].upper(), "", None, "one", "a b c d e f a b c d e f", "a b c d e f a b c d e f a b c d e f"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], SCHEMA)
    signed = shingles.signatures(docs).collect()
    assert [x["sim"] % (1 << 64) for x in sorted(signed, key=lambda x: x["doc_id"])] == [simhash.fingerprint(t and t.encode(), 5) for t in rows]
    of = {x["fp"]: x for x in signed}
    grams = {k: set(shingles.shingle_set((rows[x["doc_id"]] or "").encode()).tolist()) for k, x in of.items()}
    want = {(a, b) for a in of for b in of if a < b and (of[a]["sim"] ^ of[b]["sim"]).bit_count() <= 2 and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])}
    nodes = spark.createDataFrame([{**x.asDict(), "keys": []} for x in of.values()], shingles.signatures(docs).schema)
    got = {tuple(x) for x in shingles.similar_links(docs, nodes).collect()}
    assert len(want) > 5 and got <= want
    group = {k: k for k in of}
    for a, b in sorted(got) * len(of):
        group[a] = group[b] = min(group[a], group[b])
    assert all(group[a] == group[b] for a, b in want)


def test_stage_gives_up_its_tables(spark):
    """Signatures, sets and members of buckets do not stay on disk for the stages that follow."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    docs, _ = near_copies(spark)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count()
    left = {x: spark.read.parquet(f"file://{folder}/{x}").columns for x in set(os.listdir(folder)) - before}
    assert left and not [columns for columns in left.values() if {"keys", "hashes", "size"} & set(columns)]


@pytest.mark.parametrize("at_once", [0, 1, 7, simhash.AT_ONCE])
def test_components_of_parts(spark, at_once):
    """Chains, stars and random links, whether their parts are first replaced by stars or not, in few jobs where one part holds them all."""
    r = random.Random(3)
    links = [(i, i + 1) for i in range(-40, -10)] + [(100, 200 + i) for i in range(30)] + [tuple(sorted(r.sample(range(1000, 1060), 2))) for _ in range(40)]
    links += [(-(1 << 63), (1 << 63) - 1), links[0], (7, 8)]
    r.shuffle(links)
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    spark.sparkContext.setJobGroup(f"components-{at_once}", "")
    got = simhash.components(df, at_once)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{at_once}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(x) for x in got.select("node", "root").collect()) == sorted((k, v) for k, v in root.items() if k != v)
    assert simhash.components(df.limit(0), at_once).count() == 0
    assert jobs <= 4 or at_once < len(links)
