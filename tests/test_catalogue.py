"""Every registered query against its SQL."""

import duckdb
import pytest

from tideline.plans import catalogue

SF = "/root/testdata/sf0.01"  # the smallest tables have too few trades for a burn-in
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_has_a_verdict_for_every_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    if name in catalogue.ORACLE:
        out = con.execute(catalogue.ORACLE[name])
        found = [x[0] for x in out.description]
        order = sorted(range(len(found)), key=found.__getitem__)
        assert sorted(found) == names
        assert got == sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)
