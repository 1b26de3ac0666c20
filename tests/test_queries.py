import pytest

import __spark_entry__ as contract
from docloom.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_queries_without_sql_give_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_question_is_answered(spark):
    """fake_embedding_topk asks with all rows of benchmark, none is left out."""
    d = "/root/testdata/sf0.001"
    rows = QUERIES["fake_embedding_topk"](spark, d).collect()
    asked = {r.item_id for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id").collect()}
    assert len(asked) > 1 and sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in sorted(asked) for k in (1, 2, 3)]


def test_entry_gives_contexts(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(r["context"].startswith("[Source 1, relevance: ") for r in rows)


def test_contract_lists_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
