import pytest

from docframe.plans.registry import ORACLE_SQL, QUERIES
from docframe.operators.vectors import top_k_each
from tests.oracle import database, plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    assert plain(QUERIES[name](spark, FOLDER).toPandas()) == plain(db.execute(ORACLE_SQL[name]).df())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["verdict_rows"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_queries_in_blocks(spark):
    v = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id < 60")
    one, many = (plain(top_k_each(v, v, 3, block_bytes=n).toPandas()) for n in (1 << 25, 4096))
    assert one == many and len(one[1]) == 180
