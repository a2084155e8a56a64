"""The pipeline's stages against what each operator says of its input."""

import os

import pytest

import corpus_pipeline
from panelforge.llm import toxicity
from panelforge.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def first_of_each_class(rows):
    """Smallest ids of the classes of texts linked by four fifths or more of their five-word shingles, by all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(k) for k in sets})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii_surrogates", "source_mixing", "bestfit_packing"]
    docs = table(spark, SF, "documents")
    columns, out = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    clean, single, private, mixed, packed = out[1:]
    assert all(x.columns == columns for x in out[1:-1])
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(clean) == sorted(k for k, v in verdict.items() if v == 0)
    assert ids(single) == first_of_each_class(clean.collect())
    assert ids(private) == ids(single)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in private.collect():
        assert r["n_chars"] == len(r["text"])
        if "@" not in before[r["doc_id"]] and not any(c.isdigit() for c in before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in private.collect()}
    total = sum(sizes.values())
    assert abs(sum(sizes[r["doc_id"]] for r in mixed.collect()) - 1.5 * total) < 0.2 * total
    used = {}
    for r in packed.collect():
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024 and len(used) <= sum(used.values()) / 1024 * 1.02 + 1
    assert sorted({r["doc_id"] for r in packed.collect()}) == sorted({r["doc_id"] for r in mixed.collect()})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_is_the_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)
