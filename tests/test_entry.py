"""The driver's contract, and queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
PROBED = ["features_volume", "features_session", "labels_fixed_horizon", "threshold_sweep", "report", "walk_forward_windows", "time_folds", "sequences", "bars_from_csv", "one_split", "feature_adf_pvalue"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PROBED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect()), key=repr)
    assert list(map(repr, got)) == list(map(repr, expected))  # NaN equals NaN here
