"""The driver's contract."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

TABLES = "customer documents embeddings events lineitem conversations".split()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["site_id", "track_id", "frame_idx", "label", "threat", "level", "reasons"]
    assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", ["track_kinematics", "policy_judge", "cell_zscores", "alert_intervals", "associate_sensors", "packet_frames"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)

    def key(rows):
        return sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)

    got = key([tuple(r) for r in df.select(cols).collect()])
    want = key(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want
