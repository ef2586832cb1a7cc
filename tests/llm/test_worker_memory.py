import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfline.llm import pretokens
from shelfline.llm.common import BATCH_BYTES
from shelfline.llm.minhash_dedup import sketches
from shelfline.llm.toxicity import Automaton, Scorer

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def batches(spark):
    before = spark.conf.get(KEY)
    yield spark
    spark.conf.set(KEY, before)


def largest(spark):
    def sizes(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(3000).coalesce(1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    return max(r.n for r in texts.mapInArrow(sizes, "n long").collect())


def test_stages_send_small_batches(batches):
    batches.conf.set(KEY, str(64 << 20))
    for name, stage in corpus_pipeline.STAGES:
        assert stage.__wrapped__, name
    empty = batches.createDataFrame([], "doc_id long, text string")
    dict(corpus_pipeline.STAGES)["best_fit_packing"](batches, empty, "")
    assert largest(batches) <= 1.1 * BATCH_BYTES
    batches.conf.set(KEY, str(1 << 20))  # a smaller one stays
    corpus_pipeline._lean(lambda spark, docs, sf_dir: docs)(batches, empty, "")
    assert largest(batches) <= 1.1 * (1 << 20)


def test_an_encoder_does_not_outlive_its_operator():
    for step in (lambda: Scorer(Automaton(["bad"], [], {"bad"}), np.zeros(4))(pa.array(["a bad word", None])),
                 lambda: list(sketches(2, 2)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"]), pa.array([2])], names=["doc_id", "text", "key"])])))):
        pretokens._encoders["path", "ids"] = object()
        step()
        assert not pretokens._encoders
