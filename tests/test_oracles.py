"""Every registered query with an oracle agrees with DuckDB on the smallest data set."""

import pytest

from sitegauge.plans.compare import compare, duck
from sitegauge.plans.registry import load_all

CHECKED = sorted(n for n, q in load_all().items() if q.sql is not None)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, sf_dir, name):
    assert compare(spark, con, load_all()[name], sf_dir) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry
    first = entry.entry(spark).first()
    assert 0.0 <= first["overall_score"] <= 1.0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_utm_agrees_where_a_metre_turns(spark, sf_dir, tmp_path):
    """Sites of a larger table that a series good to a millimetre puts one metre off."""
    keys = (85564, 25146, 6744, 5858, 23133, 70323)
    row = f"SELECT * REPLACE (k AS c_custkey) FROM (SELECT * FROM '{sf_dir}/customer.parquet' LIMIT 1), (SELECT unnest({list(keys)})::bigint AS k)"
    import duckdb
    own = duckdb.connect()
    own.execute(f"COPY (SELECT * EXCLUDE (k) FROM ({row})) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    own.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert compare(spark, own, load_all()["reproject_utm"], str(tmp_path)) is None
