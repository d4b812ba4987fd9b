"""The registered queries: SQL where there is some, row counts and columns of all, and the pipeline's stages."""

import pytest

import corpus_pipeline
from barloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, difference

SF = "sf0.001"
TABLE = {"op1": "pages", "op10": "pages", "op13": "embeddings", "op5": "conversations"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, f"{DATA}/{SF}").toPandas(), connect(SF).sql(ORACLE_SQL[name]).df()) == ""


#: Rows for each row of the table; each embedding gives one for each of 16 components.
TIMES = {"op13": 16}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_for_each_row(spark, name):
    source = spark.read.parquet(f"{DATA}/{SF}/{TABLE.get(name.split('_')[0], 'documents')}.parquet").count()
    assert QUERIES[name](spark, f"{DATA}/{SF}").count() == source * TIMES.get(name.split("_")[0], 1)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, f"{DATA}/{SF}")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 100
        ids = kept
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, f"{DATA}/{SF}").count() == len(ids)
