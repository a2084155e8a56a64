"""Text operators against plain Python on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import common, packing, quality, simhash, suffix_dedup, token_counts
from panelforge.llm.entries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, extra columns whose names clash."""
    r = random.Random(3)
    words = ["".join(r.choice("aeioubcdst") for _ in range(r.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(80), text(60)
    texts = [None, "", " \n\t ", "one", "two words", base, base, base.replace(" a", " b", 1), base + " tail", passage + " " + text(30), text(20) + " " + passage, text(3000)]
    texts += ["Ha " * 200, "x\n" * 30 + "line a\nline a\nline b", "émile Ünïcode  ß 漢字 İ Σς \x1c end", "<|endoftext|> a <|startoftext|>", "A B c" * 40, text(12), text(12)]
    texts += ["Ça été déjà Ärger ÿ µ ªº ʼn ĳ Ǆ ſ ½ ²³ ¡¿ \xa0 \xad ˿ naïve Œuvre", "a" * 5000 + " " + "é" * 5001, " " * 5002 + "x" + "\n" * 4999, "9" * 6000 + "!" * 6000]
    rows = [(i, t, "en", f"s{i % 3}", 1, 0.5, "x") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None), (None, None, None, None, None, None, None), rows[5], rows[11]]
    return spark.createDataFrame(rows, SCHEMA), rows


def raw(text):
    return (text or "").encode()


def test_simhash_matches_brute_force(spark):
    docs, rows = corpus(spark)

    def fingerprint(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = Counter()
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    group = list(range(len(fps)))
    for _ in fps:
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = defaultdict(list)
    for g, (d, _) in zip(group, fps):
        if d is not None:
            least[g].append(d)
    want = Counter((d, f"{f:016x}", min(least[g])) for g, (d, f) in zip(group, fps))
    for limit in (64, 1):
        got = Counter(tuple(r) for r in simhash.near_duplicates(docs, bucket_limit=limit).collect())
        assert got == want
    kept = simhash.without_near_duplicates(docs)
    clash = docs.withColumn("turn", F.lit(1)).withColumn("h", F.lit("h")).withColumn("id", F.lit(2))
    assert simhash.without_near_duplicates(clash).columns == clash.columns
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for d, _, c in want if d is not None})
    two = spark.createDataFrame([(7, "a wholly different text that nobody else has"), (7, rows[5][1]), (3, rows[5][1]), (3, rows[5][1])], "doc_id long, text string")
    assert sorted(map(tuple, simhash.without_near_duplicates(two).collect())) == sorted([(7, "a wholly different text that nobody else has"), (3, rows[5][1])])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_and_hubs_agree_on_dense_balls(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    near = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in near], "fp long")

    def classes(limit):
        out = {x["node"]: x["root"] for x in simhash.components(simhash.near_links(fps, bucket_limit=limit)).collect()}
        sets = defaultdict(set)
        for k, v in out.items():
            sets[v].add(k)
        return sorted(map(sorted, sets.values()))

    links = {(x["a"], x["b"]) for x in simhash.near_links(fps, bucket_limit=10**6).collect()}
    signed = [x["fp"] for x in fps.collect()]
    assert links == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert classes(10**6) == classes(2)


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    docs, rows = corpus(spark)
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect())
    assert got == Counter((r[0], len(raw(r[1])), n(r[1]), n(r[1]) > 2048) for r in rows)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    whole = token_counts.proven_whole_tokens(path)
    assert len(whole) > 10_000 and all(n(w) == 1 for w in random.Random(0).sample(sorted(whole), 500))


def removed(rows, length):
    """doc_id and text to removed flags, by all strings seen so far."""
    seen, out = set(), {}
    for key in sorted({(r[0] if r[0] is not None else 1 << 62, r[1] or "") for r in rows}):
        b, gone = raw(key[1]), set()
        strings = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, s in enumerate(strings):
            if s in seen:
                gone.update(range(i, i + length))
            seen.add(s)
        out[key] = gone
    return out


@pytest.mark.parametrize("limit", [200, 1])
def test_suffix_dedup_matches_brute_force(spark, limit):
    docs, rows = corpus(spark)
    flags = removed(rows, 100)
    want = Counter()
    for d, t, *_ in rows:
        b, gone = raw(t), flags[d if d is not None else 1 << 62, t or ""]
        runs = sum(1 for i in gone if i - 1 not in gone)
        want[d, len(b), len(gone), runs, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.deduplicated(docs, anchor_limit=limit).collect()) == want
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_hot_anchors_split_into_stretches(spark):
    r = random.Random(11)
    passage = "".join(r.choice("abcdefgh ") for _ in range(130))
    noise = lambda n: "".join(r.choice("xyz ") for _ in range(n))
    rows = [(i, noise(r.randint(0, 60)) + passage[r.randint(0, 40) : 130 - r.randint(0, 10)] + noise(r.randint(0, 60))) for i in range(120)]
    rows += [(200 + i, noise(40) + passage + noise(3) + passage) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flags = removed(rows, 100)
    want = {d: (len(flags[d, t]), sum(1 for i in flags[d, t] if i - 1 not in flags[d, t])) for d, t in rows}
    for limit in (512, 20, 2):
        got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.deduplicated(docs, anchor_limit=limit).collect()}
        assert got == want


def test_spread_join_is_a_join(spark):
    left = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, v string")
    counted = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = common.hot_keys(counted, 3000, "k")
    assert 0 < hot.count() <= 1000 and common.hot_keys(counted, 10**9, "k") is None
    for how, keys in (("inner", hot), ("left", hot), ("left", None)):
        got = common.spread_join(left, right, ["k"], keys, how)
        assert got.columns == ["k", "id", "v"] and sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_repeat_groups_hold_all_occurrences():
    contexts = [b"--abcdefgh--", b"xxabcdefghyy", b"abcdefghz", b"nothing"]
    groups = {(n, tuple(sorted(zip(c.tolist(), o.tolist())))) for n, c, o in suffix_dedup.repeat_groups(contexts, 6)}
    assert groups == {(8, ((0, 2), (1, 2), (2, 0)))}


def test_anchors_cover_every_start_once():
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (99, 100, 101, 500)]
    text, lo, hi, at, _ = suffix_dedup.anchors(texts)
    assert all(b <= x < a + 69 for a, b, x in zip(lo, hi, at))
    starts = [(t, s) for t, a, b in zip(text, lo, hi) for s in range(a, b + 1)]
    assert sorted(starts) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]


def test_quality_matches_brute_force(spark):
    docs, rows = corpus(spark)

    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        long_ = {i + j for n in [8] for i in range(len(w) - n + 1) if Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))[tuple(w[i : i + n])] > 1 for j in range(n)} if len(w) < 500 else None
        longest = next((n for n in range(len(w), 4, -1) if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1), 0) if len(w) < 500 else None
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(long_) if long_ is not None else None, longest

    expected = {t: brute(t) for t in {r[1] for r in rows}}
    by = Counter()
    for r in rows:
        by[r[0], expected[r[1]][:5]] += 1
    found = quality.quality_rules(docs).collect()
    assert Counter((x["doc_id"], tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for x in found) == by
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for x in found:
        if x["doc_id"] is None or expected[texts[x["doc_id"]]][5] is None:
            continue
        n, _, _, _, repeated, cover, longest = expected[texts[x["doc_id"]]]
        assert (x["covered_words"], x["longest_repeat"]) == (cover, longest)
        failed = n < 10 or 100 * repeated > 20 * n
        assert x["base_failed"] == failed and x["kept"] == (not failed and cover <= 0.2 * n and longest <= 60)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_packing_keeps_every_token_and_matches_best_fit(spark):
    from tokenizers import Tokenizer

    docs, rows = corpus(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in {r[1] for r in rows}}
    got = packing.packed_documents(docs, path, capacity=256).collect()
    want = Counter()
    for d, t, *_ in rows:
        n = len(ids[t])
        cuts = [0, *range((n - 1) % 256 + 1, n + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[t][a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(x[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    remaining = []
    for n in sorted((x["length"] for x in got), reverse=True):
        fit = min((i for i, c in enumerate(remaining) if c >= n), key=lambda i: remaining[i], default=None)
        if fit is None:
            remaining.append(256 - n)
        else:
            remaining[fit] -= n
    assert len(bins) == len(remaining)
    assert packing.packed_documents(docs.limit(0), path).count() == 0


def test_capacity_tree_finds_the_tightest():
    tree, r, opened = packing.CapacityTree(64), random.Random(5), Counter()
    for _ in range(500):
        c = r.randint(1, 64)
        tree.add(c, 1)
        opened[c] += 1
        if r.random() < 0.5:
            c = r.choice([x for x in opened if opened[x]])
            tree.add(c, -1)
            opened[c] -= 1
        size = r.randint(1, 64)
        assert tree.tightest(size) == min((x for x in opened if opened[x] and x >= size), default=None)


def test_best_fit_plan_equals_item_by_item():
    r = random.Random(7)
    for _ in range(50):
        sizes = [r.randint(1, 40) for _ in range(r.randint(1, 200))]
        steps = packing.best_fit_plan(dict(Counter(sizes)), 40)
        load = Counter()
        for size, _, items, first, each, offset in steps:
            for i in range(items):
                assert load[first + i // each] == offset + i % each * size
                load[first + i // each] += size
        assert sum(load.values()) == sum(sizes) and max(load.values()) <= 40
        remaining = []
        for n in sorted(sizes, reverse=True):
            fit = min((i for i, c in enumerate(remaining) if c >= n), key=lambda i: remaining[i], default=None)
            if fit is None:
                remaining.append(40 - n)
            else:
                remaining[fit] -= n
        assert sorted(40 - c for c in remaining) == sorted(load.values())
