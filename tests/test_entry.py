import duckdb
import pytest

import __spark_entry__ as entry
from datawright import queries as core

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_every_sql_has_a_query():
    assert set(core.SQL) <= set(core.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["validate_lineitem", "profile_numeric", "assoc_spearman", "drift_ks", "panel_balance", "encode_target_oof", "filter_contains"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = core.QUERIES[name](spark, SF)
    want = con.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    show = lambda rows, names: sorted(tuple(str(round(v, 5)) if isinstance(v, float) else str(v) for _, v in sorted(zip(names, r, strict=True))) for r in rows)
    assert sorted(columns) == sorted(df.columns)
    assert show(df.collect(), df.columns) == show(want.fetchall(), columns)
