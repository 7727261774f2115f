import re

import corpus_pipeline
from folioforge.llm import decontaminate, neardup, substring
from folioforge.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order_and_their_effects(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    docs = table(spark, sf, "documents")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf).cache()
        assert docs.columns == COLUMNS, name
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert kept and set(kept) <= set(held)
        if name == "language_id":
            assert all(re.search(r"[^\W\d_]", t) for t in kept.values())
            assert len(kept) > 0.9 * len(held)
        if name == "minhash_near_dedup":
            assert len(set(kept.values())) == len(kept)
            classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(before).collect()}
            assert set(kept) == set(classes.values())
        if name == "substring_dedup":
            spans = {}
            for r in substring.repeats(before).collect():
                spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
            assert spans
            for d, t in held.items():
                left = "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in spans.get(d, ())))
                assert kept.get(d, "").split() == left.split()
                assert d in spans or kept[d] == t
        if name == "benchmark_decontamination":
            found = {r["doc_id"] for r in decontaminate.contaminated(before, table(spark, sf, "benchmark")).collect()}
            items = [decontaminate.normalise(r["text"]) for r in table(spark, sf, "benchmark").collect()]
            assert found == set(held) - set(kept)
            assert not any(i in decontaminate.normalise(t) for t in kept.values() for i in items)
        held = kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert all(held[r["doc_id"]] == r["text"] and 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mixed)


def test_run_writes_every_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "text", "copies", "taken"} <= set(out.columns)


def test_stages_take_nulls_and_empty_tables(spark, sf, frame):
    rows = frame([(1, None), (None, "The words of this text, which has no id, are few."), (2, ""), (2, ""), (3, "x")])
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= docs.count()
