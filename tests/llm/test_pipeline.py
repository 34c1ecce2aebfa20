from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import prose, sentences


def test_stages_keep_clean_documents_and_one_of_each_group(spark, tmp_path):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(120):
        text = prose(i, 80)
        if i % 4 == 3:
            text = text.upper() + " $$$ !!!" * 60
        rows.append((i, text, "en", f"s{draw.randint(0, 2)}", len(text)))
        labels.append((i, int(i % 4 != 3), 0))
    rows += [(500, rows[0][1], "en", "s0", 1), (501, rows[1][1] + " tail", None, None, None), (502, None, "en", "s1", 0), (503, "", None, "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "pieces" or docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {i for i in range(120) if i % 4 != 3}
    assert clean <= kept["language"] and not {502, 503} & kept["language"]
    assert clean <= kept["quality"] and len(kept["quality"] & {i for i in range(120) if i % 4 == 3}) <= 2
    assert kept["quality"] - kept["near_duplicates"] == {500, 501}
    assert kept["pieces"] == kept["mixture"] <= kept["near_duplicates"]
    assert all(r.same for r in docs.collect())


def test_quality_stage_judges_long_documents_by_their_content(spark, tmp_path):
    rows = [(i, sentences(i, 300 + 37 * (i % 100), i % 4 > 0), "en", "s", 1) for i in range(400)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(400)]
    rows += [(1000 + n, sentences(1000 + n, 10 ** (4 + n // 2), n % 2 > 0), "en", "s", 1) for n in range(6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert {i for i in kept if i >= 1000} == {1001, 1003, 1005}
