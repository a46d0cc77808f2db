import duckdb
import pytest

from strandline.llm.queries import ORACLE, QUERIES


def plain(rows, columns):
    one = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(one(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        duck.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert plain([r.asDict() for r in df.collect()], names) == plain(rows, names) and rows
