import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    """Rows of a DuckDB query over the test tables, with columns in order of name."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")

    def run(sql):
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)

    return run


@pytest.fixture(scope="session")
def rows():
    def run(df):
        names = sorted(df.columns)
        return names, sorted((tuple(r) for r in df.select(*names).collect()), key=str)

    return run
