"""The operators' queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from siltworks.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr([str(v) for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert plain([tuple(r) for r in df.select(*cols).collect()]) == plain([[r[names.index(c)] for c in cols] for r in want.fetchall()])
