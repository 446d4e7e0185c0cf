import duckdb

import __spark_entry__ as entry
from sieveline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_small_queries_equal_sql(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("class_coverage_kb", "validation_reasons", "status_counts", "apportionment", "class_coverage", "split_audit", "recent_turns_server"):
        got = registry.queries()[name](spark, "/root/testdata/sf0.001")
        want = db.sql(registry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        key = lambda rows: sorted((tuple(map(str, r)) for r in rows))
        assert key(got.select(*columns).collect()) == key(want.select(*[f'"{c}"' for c in columns]).fetchall()), name
