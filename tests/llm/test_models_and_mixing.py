"""Classifiers by held-out accuracy; search, mixing and surrogates by brute force and properties."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import language, mixing, pii, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"


def test_counterfactual_penalty_evens_out_identity_terms():
    r = random.Random(1)
    fill = lambda: " ".join(r.choice("apple river stone cloud music paper green table".split()) for _ in range(6))
    data = [(f"{fill()} muslims are stupid scum", 1) for _ in range(40)] + [(f"{fill()} idiot trash", 1) for _ in range(40)]
    data += [(f"{fill()} christians pray", 0) for _ in range(60)] + [(fill(), 0) for _ in range(100)]
    plain, fair = toxicity.fit(data, counterfactual=0.0), toxicity.fit(data, counterfactual=5.0)
    gap = lambda m: abs(m.score("the muslims met") - m.score("the christians met"))
    assert gap(plain) > 0.05 and gap(fair) < gap(plain) / 3
    assert fair.score("you stupid scum") > 0.5 > fair.score("river stone")
    assert toxicity.swapped("Black cats") == "white cats" and toxicity.swapped("no terms") is None
    no_terms = toxicity.fit([(t.replace("muslims", "people").replace("christians", "people"), y) for t, y in data])
    assert no_terms.score("the women met") == no_terms.score("the men met") and no_terms.score("you stupid scum") > 0.5
    words = [w for g in toxicity.IDENTITY_GROUPS for w in g]
    assert all(toxicity.swapped(toxicity.mentions("so it is", i)) is not None for i in range(len(words)))
    assert toxicity.fit(data, groups=()).score("you stupid scum") > 0.5
    assert toxicity.fit([]).score("x") < 0.01 and toxicity.fit([("x", 0)]).score("") < 0.01


def test_toxicity_of_odd_rows_and_held_out_accuracy(spark):
    r = random.Random(2)
    words = ["w" + str(i) for i in range(200)]
    texts, marks = [], []
    for i in range(800):
        bad = r.random() < 0.3
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        if bad:
            t[r.randrange(len(t))] = r.choice(["vileword", "awfulword", "vilely"])
        texts.append(" ".join(t))
        marks.append(int(bad))
    rows = [(i, t, "en", "s", 1, 9.9, "x") for i, t in enumerate(texts)] + [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, 0.0, ""), (None, "vileword", "en", "s", 0, 0.0, ""), (900, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(None, 1, 1), (901, None, None), (3, 1, marks[3])], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x[0] for x in rows)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 800 and x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    assert sum(x["predicted"] == marks[x["doc_id"]] for x in held) > 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    twice = docs.unionByName(docs)
    assert toxicity.sample_of(twice, labels.unionByName(labels)) == toxicity.sample_of(docs, labels) == toxicity.sample_of(docs.repartition(5), labels)
    assert 0 < sum(len(t.encode()) for t, _ in toxicity.sample_of(docs, labels, max_bytes=5000)) <= 5000
    model = toxicity.fit(toxicity.sample_of(docs, labels))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x["predicted"] == 0 for x in got)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def greedy_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_cross_parsing_matches_brute_force():
    r = random.Random(4)
    samples = {"a": "".join(r.choice("abc d") for _ in range(400)), "b": "".join(r.choice("bcde f") for _ in range(300))}
    samples |= {"han": "".join(chr(0x4E00 + r.randrange(60)) for _ in range(500)), "kana": "".join(chr(0x3041 + r.randrange(40)) for _ in range(400)), "long": "ab" * 300}
    texts = ["".join(r.choice("abcdefg ") for _ in range(n)) for n in (0, 1, 5, 100, 511, 512, 513, 2000, 20000)]
    texts += ["".join(chr(0x4E00 + r.randrange(70)) for _ in range(n)) for n in (513, 3000)] + ["ab" * 3000, "a" * 1500, "\U00020000" * 600]
    for table_bytes in (language.TABLE_BYTES, 0):
        models = language.Models(samples, table_bytes)
        got = models.phrases(texts)
        assert got.tolist() == [[greedy_phrases(t, samples[x]) for x in models.languages] for t in texts]


def test_scripts_with_many_letters_are_told_apart():
    r = random.Random(9)
    speak = {k: ["".join(chr(a + r.randrange(n)) for _ in range(r.randint(1, 3))) for _ in range(150)] for k, a, n in (("han", 0x4E00, 2000), ("hangul", 0xAC00, 2000), ("arabic", 0x621, 26), ("latin", 97, 26))}
    say = lambda k, n: " ".join(r.choice(speak[k]) for _ in range(n))
    models = language.Models({k: say(k, 2000) for k in speak})
    texts = [(k, say(k, 15)) for k in speak for _ in range(20)]
    assert language.predict(models, [t for _, t in texts])[0] == [k for k, _ in texts]


def test_language_ids(spark):
    r = random.Random(5)
    speak = {"xx": "kataro menu silo varte".split(), "yy": "bruch stolf gewend kripz".split()}
    rows = []
    for i in range(300):
        x = r.choice(sorted(speak))
        rows.append((i, " ".join(r.choice(speak[x]) for _ in range(20)).upper() + " 12", x, "s", 1, 0.1, "lang_pred"))
    rows += [(400, None, "xx", "s", 0, 0.0, ""), (401, "", "yy", None, 0, 0.0, ""), (402, "12 34 !!", "xx", "s", 0, 0.0, ""), (None, "bruch stolf " * 500, None, None, None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language.language_ids(docs).collect()
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    assert Counter(x["doc_id"] for x in got) == Counter(x[0] for x in rows)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (400, 401, 402))
    assert by[None][0]["lang_pred"] == "yy"
    truth = {x[0]: x[2] for x in rows if x[0] is not None and x[0] < 400}
    assert all(by[i][0]["lang_pred"] == truth[i] for i in truth)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert language.language_ids(docs.limit(0)).count() == 0


def test_top_k_is_exact(spark):
    r = np.random.default_rng(6)
    vectors = [(int(i), r.normal(0, 0.2, 8).astype(float).tolist(), 0, "x") for i in range(600)]
    vectors[10] = (10, vectors[0][1], 0, "x")  # ties
    vectors[20] = (20, vectors[0][1], 0, "x")
    vectors += [(700, None, 1, "x"), (750, [None] * 8, 1, "x"), (800, [math.nan] * 8, 1, "x"), (850, [math.inf] + [0.0] * 7, 1, "x"), (900, [1.0, 2.0], 1, "x"), (None, [0.1] * 8, 1, "x"), (950, [], 1, "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, score string")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in whole:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:5]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    for block in (8192, 37):
        got = topk.top_k(df.withColumn("ib", F.lit("x")), F.col("vec_id") % 50 == 0, index_block=block)
        assert {tuple(x) for x in got.collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_stops_on_proof_and_skips_blocks():
    r = np.random.default_rng(3)
    vectors = np.floor(256 * r.normal(0, 0.125, (3000, 64))).astype(np.int64)
    vectors[:500] //= 16
    ids = np.arange(3000) * 7 % 3001
    index = topk.ImpactIndex(ids, vectors)
    for i in range(0, 3000, 100):
        score = vectors @ vectors[i]
        want = sorted(((int(-s), int(k)) for s, k in zip(score, ids) if k != ids[i]))[:5]
        assert [(-s, k) for s, k in index.search(vectors[i], ids[i], 5)] == want
        bar = -want[-1][0]
        assert [(-s, k) for s, k in index.search(vectors[i], ids[i], 5, bar)] == want
        assert index.bound(vectors[i]) >= -want[0][0]
    assert index.read["proven"] == index.read["queries"] == 60
    assert index.read["postings"] < 0.95 * index.read["held"] and index.read["rescored"] < 0.02 * 60 * 3000
    huge = topk.ImpactIndex(np.arange(3), np.array([[1 << 40, 5], [1 << 41, -7], [-(1 << 40), 3]]))
    assert huge.search(np.array([1 << 40, 2]), 0, 2) == [((1 << 81) - 14, 1), (-(1 << 80) + 6, 2)]


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_targets_bounds_and_reruns(spark):
    r = random.Random(8)
    rows = [(i, None if i % 97 == 0 else "w " * r.randint(0, 60), "en", r.choice(["a", "b", "b", "b", "b", "c", "Ä", None]), 1, 1.0, "x") for i in range(1500)]
    rows += [(None, "no id here", "en", "a", 1, 1.0, "x"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert Counter((x["doc_id"], x["source"], x["size"]) for x in got) == Counter((x[0], x[3], len((x[1] or "").split())) for x in rows)
    sizes = defaultdict(int)
    for x in rows:
        sizes[x[3]] += len((x[1] or "").split())
    targets = water(sizes)
    taken = defaultdict(int)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and math.isclose(x["target"], targets[x["source"]], rel_tol=1e-9)
        assert x["taken"] == x["copies"] * x["size"] <= 2 * x["size"]
        rate = targets[x["source"]] / sizes[x["source"]]
        assert math.floor(rate) <= x["copies"] <= math.ceil(rate)
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in targets)
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, got))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(x["copies"] for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = docs.withColumn("_id", F.lit(1)).withColumn("_of", F.lit("x")).withColumn("mix_n", F.lit(3))
    assert mixing.mixed_documents(clash).columns == clash.columns
    one_id = spark.createDataFrame([(1, "w " * n, "a") for n in (5, 50, 50, 500)] + [(None, "w " * 7, None), (2, "w " * 600, "b")], "doc_id long, text string, source string")
    by_size = Counter({(x["source"], x["size"]): 0 for x in mixing.mix(one_id).collect()})
    for x in mixing.mix(one_id).collect():
        by_size[x["source"], x["size"]] += x["copies"]
    assert Counter((x["source"], len(x["text"].split())) for x in mixing.mixed_documents(one_id).collect()) == +by_size


def test_pivotal_rounding_is_unbiased(spark):
    units = spark.range(200).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("size"), F.lit(0.3).alias("p"))
    hits = Counter()
    for seed in range(12):
        out = mixing.pivotal_copies(units, 200, seed).collect()
        assert {x["p"] for x in out} <= {0.0, 1.0} and len(out) == 200
        assert abs(sum(x["p"] * x["size"] for x in out) - 0.3 * sum(i % 7 + 1 for i in range(200))) <= 7
        hits.update(x["doc_id"] for x in out if x["p"])
    assert abs(sum(hits.values()) / 2400 - 0.3) < 0.04 and len(hits) > 150


TEXT = (
    "Write ann.lee+x@corp.example.com, call +1 (017) 555-7713 or 415-555-1234. Host 169.122.221.182. Card 4111 1111 1111 1111 or 4952935900253052!! "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" DE89 3704 0044 0532 0130 00, 078-05-1120. Mr. John Smith met Mrs Klara Weber; Mr. Smith left with Susan Smith. г-жа Анна Петрова.'
)


def luhn(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [(1, TEXT, "en", "s", 1, 0.1, "pii"), (2, "again 169.122.221.182 and Mr. John Smith", "en", "s", 1, 0.1, ""), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, 0.0, ""), (5, "v 1.2, 3.5% of 2024; no data here", "en", "s", 1, 0.1, ""), (None, "x@y.org", "en", "s", 1, 0.1, ""), (2, "again 169.122.221.182 and Mr. John Smith", "en", "s", 1, 0.1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = docs.columns
    full = pii.with_surrogates(docs, "k")
    assert [c for c in full.columns if c != "pii"] == kept
    found = {x["doc_id"]: x for x in full.collect()}
    one = {e["entity"]: (e["kind"], e["surrogate"]) for e in found[1]["pii"]}
    assert Counter(k for k, _ in one.values()) == {"email": 1, "phone": 2, "ipv4": 1, "card": 2, "secret": 1, "iban": 1, "ssn": 1, "person": 5}
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    for entity, (kind, new) in one.items():
        assert new != entity and entity not in found[1]["text"].replace("Mr. Smith", "")
        if kind in ("phone", "card", "iban", "ssn"):
            assert shape(new) == shape(entity)
        if kind == "card":
            assert luhn(new) == luhn(entity)
    assert all(0 <= int(x) <= 255 for x in one["169.122.221.182"][1].split("."))
    john, smith = one["Mr. John Smith"][1].split(), one["Mr. Smith"][1].split()
    assert john[0] == "Mr." and john[1] in pii.GIVEN["latin m"] and john[2] == smith[1]
    assert one["Mrs Klara Weber"][1].split()[1].endswith("a") and one["Mrs Klara Weber"][1].split()[1] != "Klara" and one["г-жа Анна Петрова"][1].split()[1] in pii.GIVEN["cyrillic f"]
    susan = one["Susan Smith"][1].split()
    assert susan[0] in pii.GIVEN["latin f"] and susan[1] == smith[1]
    assert {e["entity"]: e["surrogate"] for e in found[2]["pii"]} == {k: one[k][1] for k in ("169.122.221.182", "Mr. John Smith")}
    assert found[3]["text"] is None and found[4]["text"] == "" and found[5]["text"] == rows[4][1]
    assert {x["doc_id"]: x["n_entities"] for x in pii.replace_pii(docs).collect()} == {1: 14, 2: 2, 3: 0, 4: 0, 5: 0, None: 1}
    assert pii.replace_pii(docs.limit(0)).count() == 0


def test_a_person_has_one_surrogate_in_all_forms(spark):
    text = "Mr. Zoran Brandt and Dr. Zoran Brandt. Later Brandt spoke, Zoran too, Brandts not. My name is Bogdan Weiser; Weiser it is. Dr. Νικος Παπας."
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, "Brandt and Zoran without a person", "x", "y")], "doc_id long, text string, found string, items string")
    got = {x["doc_id"]: x for x in pii.with_surrogates(docs, "k").collect()}
    new = got[1]["text"]
    one = {e["entity"]: e["surrogate"] for e in got[1]["pii"]}
    given, family = one["Mr. Zoran Brandt"].split()[1:]
    assert one["Dr. Zoran Brandt"] == f"Dr. {given} {family}" and one["Brandt"] == family and one["Zoran"] == given
    assert f"Later {family} spoke, {given} too, Brandts not." in new and one["Weiser"] == one["Bogdan Weiser"].split()[1]
    assert not {"Zoran", "Bogdan", "Weiser", "Νικος", "Παπας"} & set(new.replace(".", " ").replace(";", " ").split())
    assert got[2]["text"] == "Brandt and Zoran without a person" and got[1]["found"] == "x"
    digits = spark.createDataFrame([(1, "Rest AB12, to 10.0.0.1 and Mail CD34"), (2, "Rest AB12, to 10.0.0.1 and Mr. Mail CD34")], "doc_id long, text string")
    texts = {x["doc_id"]: x["text"] for x in pii.with_surrogates(digits, "k").collect()}
    assert texts[1].startswith("Rest AB12, to ") and texts[1].endswith(" and Mail CD34") and texts[2].startswith("Rest AB12, to ") and texts[2].endswith(" CD34")
    assert pii.with_surrogates(docs, "other").filter("doc_id = 1").first()["text"] != new


def iban_valid(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_no_surrogate_is_its_entity_and_ibans_stay_valid(spark):
    names = [a + b for a in "ABKLZŁЖ" for b in "abeoxłж"]
    entities = [f"Dr. {n}" for n in names] + [f"{a}@{b}.org" for a in ("a", "7", "x_y") for b in ("q", "mail")] + [f"192.168.0.{i}" for i in range(40)]
    entities += ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "+1 555 123 4567", "123-45-6789", "sk-" + "a1" * 12, "AKIA" + "A1B2" * 4]
    docs = spark.createDataFrame([(i, f"see {e} now") for i, e in enumerate(entities)], "doc_id long, text string")
    found = {e["entity"]: e for x in pii.with_surrogates(docs, "k").collect() for e in x["pii"]}
    assert sorted(found) == sorted(entities) and all(e["surrogate"] != k for k, e in found.items())
    assert len({e["surrogate"] for e in found.values()}) == len(entities)
    assert all(iban_valid(e["surrogate"]) for e in found.values() if e["kind"] == "iban")


def test_long_adversarial_texts_do_not_break_the_patterns(spark):
    n = 200_000
    texts = {
        "email": "x@" + "a." * n + "1", "emails": "a@" * n, "hosts": "x@a.b-" * (n // 6), "local": "a" * n + "@b.com", "secret": "a_" * n, "key": "sk-" + "a1" * n, "hex": "0a" * n,
        "iban": "DE12" + " AB12" * (n // 5), "ipv4": "1.1.1.1." * (n // 8), "phone": "+1 " + "12 " * n, "card": "4111 " * (n // 5), "ssn": "123-45-" * (n // 7),
        "person": "Mr. A" + "a" * n, "people": "Mr. " + "Aa " * (n // 3), "address": "Dr. " * (n // 4),
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = pii.with_surrogates(docs, "k").select("doc_id", F.length("text").alias("n"), F.size("pii").alias("found")).collect()
    assert sorted((x["doc_id"], x["n"]) for x in got) == [(i, len(t)) for i, t in enumerate(texts.values())]


def test_shared_surrogates_are_drawn_anew(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a@b.com and c@d.com")], "doc_id long, text string")
    real, keys = pii.with_surrogates, []

    def first_fails(docs, key, into="pii"):
        keys.append(key)
        new = real(docs, key, into)
        return new if len(keys) > 1 else new.withColumn(into, F.transform(into, lambda e: F.struct(e["kind"].alias("kind"), e["entity"].alias("entity"), F.lit("same").alias("surrogate"))))

    monkeypatch.setattr(pii, "with_surrogates", first_fails)
    assert len({e["surrogate"] for e in pii.checked_surrogates(docs, "k").first()["pii"]}) == 2 and keys == ["k", "k/1"]


def test_surrogates_are_one_to_one(spark):
    some = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.format_string("10.%d.%d.7", F.floor(F.col("id") / 250), F.col("id") % 250), F.format_string("%016d", F.col("id")), F.format_string("u%d@mail.example.com", F.col("id")), F.format_string("+1 (555) %03d-%04d", F.floor(F.col("id") / 100), F.col("id") % 100)).alias("text"),
    )
    each = pii.with_surrogates(some, "k").select(F.explode("pii").alias("e")).select("e.*")
    assert each.distinct().count() == each.select("kind", "surrogate").distinct().count() == 12000
    assert pii.collisions(some, "k").count() == 0


def test_upper_case_digests_are_secrets(spark):
    digest = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    texts = [f'TOKEN = "{digest}" IN CAPITALS', f"token = {digest.lower()}", f"{digest} AND F{digest[1:]}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {x["doc_id"]: x for x in pii.with_surrogates(docs, "k").collect()}
    ((kind, entity, new),) = found[0]["pii"]
    assert (kind, entity) == ("secret", digest) and new != digest and set(new) <= set("0123456789ABCDEF") and len(new) == len(digest)
    assert found[0]["text"] == texts[0].replace(digest, new)
    assert [e["surrogate"] for e in found[1]["pii"]] == [new.lower()] and [e["surrogate"] for e in found[2]["pii"]][0] == new
    assert {x["doc_id"]: (x["n_entities"], x["n_collisions"]) for x in pii.replace_pii(docs).collect()} == {0: (1, 0), 1: (1, 0), 2: (2, 0)}
    assert pii.collisions(docs, "k").count() == 0
