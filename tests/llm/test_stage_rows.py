"""What each pipeline stage makes of null, empty, blank and repeated rows."""

import pytest

import corpus_pipeline

LONG = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, LONG, "en", "a", 269), (3, LONG, "en", "a", 269), (None, LONG, None, None, None), (4, " \n ", None, "b", 3)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: The ids that are left of ROWS, by stage.
LEFT = {
    "quality_rules": [3, 3, None],
    "line_dedup": [1, 2, 3, 3, 4],
    "minhash_dedup": [1, 2, 3, 4],
    "mix_sources": [3, 3, None, None],
    "sentencepiece": [1, 2, 3, 3, 4, None],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_hard_rows_of_a_stage(spark, sf, name, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = [r["doc_id"] for r in stage(spark, docs, sf).collect()]
    assert sorted(left, key=lambda i: (i is None, i or 0)) == LEFT[name]
    assert stage(spark, docs.limit(0), sf).collect() == []
    if name != "sentencepiece":
        assert stage(spark, docs, sf).columns == docs.columns
