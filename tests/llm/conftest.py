import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query's rows on the smallest tables with those of its SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def check(spark, query, sql):
        df = query(spark, SF)
        rel = con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(rel.columns)
        want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
        order = lambda rows: sorted((tuple(r[n] for n in names) for r in rows), key=repr)
        assert order(r.asDict() for r in df.collect()) == order(want)

    return check
