"""The bands reject junk whose words carry symbols."""

import public_tokenizers

from strandframe.llm import quality


def test_bands_reject_symbol_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    judged = quality.verdicts(d, public_tokenizers.path("piece_bpe_32k.model")).where("not base_failed and not kept").groupBy("quality").count()
    found = {r.quality: r["count"] for r in judged.collect()}
    assert found.get(1, 0) == 0 and found[0] >= 5
