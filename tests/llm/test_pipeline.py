"""The pipeline against its operators' plain results, stage by stage."""

import corpus_pipeline
from fieldspark.llm.common import table
from fieldspark.llm.op5_minhash import near_duplicates
from fieldspark.llm.op6_quality import score_quality
from fieldspark.llm.op10_decontaminate import contaminated


def test_stages(spark, sf001):
    docs = table(spark, sf001, "documents")
    labels, bench = table(spark, sf001, "labels"), table(spark, sf001, "benchmark")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in score_quality(docs, labels).where("predicted = 1").collect()}
    last = {}
    for i in sorted(good):
        last[rows[i] or ""] = i
    once = set(last.values())
    third = docs.where(docs["doc_id"].isin(sorted(once)))
    single = {r["doc_id"] for r in near_duplicates(third).where("kept").collect()}
    leaks = {r["doc_id"] for r in contaminated(docs.where(docs["doc_id"].isin(sorted(single))), bench).collect()}
    want = [good, once, single, single - leaks]
    at = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        at = stage(spark, at, sf001)
        assert at.columns == docs.columns and {r["doc_id"] for r in at.select("doc_id").collect()} == ids, name
    out = corpus_pipeline.run(spark, sf001)
    assert {r["doc_id"] for r in out.collect()} == want[-1] and out.where("not round_trip").isEmpty()
    assert 0 < len(want[-1]) < len(good) < len(rows)
