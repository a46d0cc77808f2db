import duckdb
import pytest

import __spark_entry__ as entry_module
from strandline.plans.oracles import ORACLE
from strandline.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v)

    return sorted((tuple(one(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, sf, duck, query, sql):
    df = query(spark, sf)
    got = [r.asDict() for r in df.collect()]
    want = duck.execute(sql)
    names = [x[0] for x in want.description]
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, names) == plain(rows, names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    compare(spark, sf, duck, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
