import os

import corpus_pipeline
from panelforge.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(os.path.join(DATA, "documents.parquet"))
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert all(sizes) and sizes[1] < sizes[0] and sizes[2] <= sizes[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == sizes[-1]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_empty_and_odd_documents(spark, odd, none):
    odd, none = (x.select("doc_id", "text", "lang", "source", "n_chars") for x in (odd, none))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).count()


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
