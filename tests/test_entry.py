import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


def test_registration_is_complete():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and entry.registry.FLAGSHIP in names


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events", "pages", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    sql = db.sql(entry.oracle_sql()[name])
    clean = lambda rows, columns: sorted(repr([round(r[columns.index(c)], 6) if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in names]) for r in rows)
    assert names == sorted(sql.columns)
    assert clean([tuple(r) for r in df.collect()], df.columns) == clean(sql.fetchall(), sql.columns)
