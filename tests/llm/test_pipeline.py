"""The whole pipeline on sf0.001, each stage against what it promises."""

import corpus_pipeline
from shelfline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "importance_resampling", "minhash_dedup", "decontamination", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name != "best_fit_packing":
            assert docs.columns == columns
        before = ids
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == before
