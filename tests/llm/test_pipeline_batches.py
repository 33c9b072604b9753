"""The pipeline's stages hand rows to Python in batches of bounded size."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hookflow.llm.common import PIECE_BYTES

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_a_partition_is_more_than_one_batch(spark, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.createDataFrame([(1, "one two three.\nfour five six", "en", "web", 28), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    try:
        stage(spark, docs, "")
        found = [row["n"] for row in rows.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(LIMIT)
    assert sum(found) >= 24 << 20 and max(found) <= PIECE_BYTES + (2 << 20)
