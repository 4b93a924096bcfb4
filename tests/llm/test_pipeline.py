from collections import Counter

import corpus_pipeline
from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
        if k < 3:
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert 0 < len(ids) <= before and len(set(ids)) == len(ids)
            before = len(ids)
    whole = queries()["pipeline"](spark, SF_DIR)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(docs)
    per = Counter(r["doc_id"] for r in docs.where("piece = 0").collect())
    assert set(per.values()) <= {1, 2}
