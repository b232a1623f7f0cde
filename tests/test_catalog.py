"""The registry, and a few queries against their SQL twins on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 180
    for sql in o.values():
        assert "LIMIT" not in sql.upper().split()


def norm(v):
    return "~" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["merged_activity", "place_clips", "map_cues_clip", "overlap_dedup", "three_way_clips", "frozen_rates", "literal_cover"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
