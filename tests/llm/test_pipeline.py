"""The pipeline's stages on a small table."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import SCHEMA, prose  # noqa: E402


def test_stages(spark, tmp_path):
    import random

    r = random.Random(2)
    clean, item = prose(r, 100), prose(r, 20)
    secret = prose(r, 60) + " write to a.b@mail.example.org now"
    texts = {0: clean, 1: clean + " tail", 2: "short", 3: "same words again " * 40, 4: prose(r, 30) + " " + item + " " + prose(r, 40), 5: secret, 6: None}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", 7, "y", "z", 3) for k, t in texts.items()], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        left.append(sorted(x.doc_id for x in docs.collect()))
    assert left == [[0, 1, 4, 5], [0, 4, 5], [0, 5], [0, 5]]
    assert "<EMAIL>" in docs.where("doc_id = 5").first().text
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({x.doc_id for x in pieces}) == [0, 5]
