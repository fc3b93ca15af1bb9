import pytest

from lodestream.plans import catalog

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, con, name):
    oracle.check(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, SF).limit(5).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Events of which several share an instant: copies under other ids, one time or symbol in nine missing in the last."""
    to = tmp_path_factory.mktemp("repeated")
    copies = "SELECT event_id + k * 1000 AS event_id, CASE WHEN k = 3 AND event_id % 9 = 0 THEN NULL ELSE ts END AS ts, user_id, CASE WHEN k = 3 AND event_id % 9 = 1 THEN NULL ELSE event_type END AS event_type, value + k AS value, props"
    oracle.connect(SF).execute(f"COPY ({copies} FROM events, range(4) t(k)) TO '{to}/events.parquet' (FORMAT parquet)")
    return str(to)


@pytest.mark.parametrize("name", ["clean_stats", "clean_ticks"])
def test_against_duckdb_on_repeated_instants(spark, repeated, name):
    oracle.check(spark, oracle.connect(repeated), repeated, catalog.QUERIES[name], catalog.ORACLES[name])
