"""The registered queries: all there, and those with SQL the same as DuckDB on a planted small folder."""

import importlib.util

import pytest

import __spark_entry__ as entry
from bytequarry.llm import queries as Q


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(Q.QUERIES) | {"pipeline"} <= names and set(Q.ORACLE) <= set(entry.oracle_sql())


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(importlib.util.find_spec("duckdb") is None or not __import__("os").path.isdir(SF), reason="needs DuckDB and the small tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(Q.ORACLE[name]).to_arrow_table().select(cols).to_pylist()
    plain = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows)
    key = lambda rows: sorted(map(str, plain(rows)))
    assert key(want) == key([r.asDict() for r in got.collect()])
