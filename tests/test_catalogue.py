"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from marginalia.plans.catalogue import QUERIES
from marginalia.plans.oracles import SQL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted((tuple(clean(v) for v in r) for r in frame[columns].values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(found) == rows(db.execute(SQL[name]).df())
    else:
        assert len(found) > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
