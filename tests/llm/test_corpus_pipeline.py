"""The pipeline's stages on the small test tables."""

import re

import corpus_pipeline
from declara.llm import pii
from declara.llm.queries import QUERIES


def test_every_corpus_query_runs(spark, data):
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op3_simhash", "op5_media", "op6_mixing", "op7_licenses", "op8_quality", "op9_pii", "op10_secrets"):
        assert QUERIES[name](spark, data).count() == n
    assert QUERIES["op1_url_filter"](spark, data).count() == spark.read.parquet(f"{data}/pages.parquet").count()
    assert QUERIES["op2_packing"](spark, data).count() >= n and QUERIES["op4_neighbours"](spark, data).count() > 0


def test_stages(spark, data, tmp_path):
    docs = first = spark.read.parquet(f"{data}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == first.columns
        kept.append((name, docs))
    stages = dict(kept)
    assert stages["quality"].count() < first.count() and stages["near_dedup"].count() < stages["quality"].count()
    assert stages["pii"].count() == stages["near_dedup"].count()
    left = pii.find_personal_data(stages["pii"]).selectExpr("size(spans) n").filter("n > 0").count()
    assert left == 0
    assert not any(re.search(r"@[a-z]", r.text) for r in stages["pii"].select("text").collect())
    sequences = stages["packing"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sequences) <= 4096
