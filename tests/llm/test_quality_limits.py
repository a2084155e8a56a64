"""Documents that pass the base rules of op5 and fail one limit of the repeats each."""

from panelforge.llm import entries


def test_each_limit_rejects(spark, tmp_path):
    fresh = iter(range(10**6))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]

    def repeated(total, *sizes):
        out = []
        for n in sizes:
            passage = words(n)
            out += [*passage, *words(1), *passage, *words(1)]
        return " ".join(out + words(total - len(out)))

    texts = {1: repeated(200), 2: repeated(400, 8), 3: repeated(1100, 30, 30), 4: repeated(200, 8), 5: repeated(2000, 61), 6: repeated(2000, 60), 7: repeated(100, 7)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x["doc_id"]: x for x in entries.op5_quality_rules(spark, str(tmp_path)).collect()}
    assert not any(x["base_failed"] for x in rows.values())
    assert {k: x["kept"] for k, x in rows.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}
    assert rows[3]["longest_repeat"] == 30 and rows[3]["covered_words"] == 120
    assert rows[4]["longest_repeat"] == 8 and rows[4]["covered_words"] == 16
