"""The pipeline's stages on a small corpus, and the registered queries on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path, prose):
    long = prose(500, 40)
    rows = [(i, prose(i, 120), "en", "a", 1) for i in range(80)]
    rows += [(100, rows[3][1], "en", "a", 1), (101, rows[4][1] + " more", "en", "a", 1)]  # an exact and a near copy
    rows += [(102, prose(600, 50) + " " + long + " " + prose(601, 50), "en", "a", 1), (103, prose(602, 80) + " password=abcdefgh12", "en", "a", 1)]
    rows += [(200 + i, prose(300 + i, 60) + " vilething " + prose(400 + i, 9) + " nastyword", "en", "a", 1) for i in range(30)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1 if 200 <= i < 230 else 0, 1 if 200 <= i < 230 else 0) for i, *_ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, long), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(80)) | {103, 300, 301}
    assert kept["toxicity"].keys() == clean | {100, 101, 102}
    assert kept["minhash_dedup"].keys() == clean | {102}
    assert kept["decontamination"].keys() == clean == kept["secrets"].keys()
    assert kept["secrets"][103].text.endswith(" [SECRET]") and kept["secrets"][103].n_chars == len(kept["secrets"][103].text)
    assert kept["packing"].keys() == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} == clean


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()])
def test_registered(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
