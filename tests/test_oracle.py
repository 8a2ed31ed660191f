import pytest

from tidewire.plans import catalog

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, con, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_without_twin(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_one_exchange_by_key(spark):
    from tidewire.operators.match import match
    from tidewire.sources.events import packets

    plan = match(packets(spark, SF), catalog.WINDOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


def test_every_fault_is_there(con):
    """No reason to drop a packet is left without packets in the data."""
    rows = con.execute(catalog.ORACLE_SQL["capture_faults"]).fetchall()
    there = {(r[0], r[1]) for r in rows if r[2]}
    expected = {("network", 0), ("fragmented", 1), ("transport", 2), ("transport", 3), ("network", 4), ("transport", 5), ("malformed", 6), ("valid", 9)}
    assert expected <= there
    records = con.execute(catalog.ORACLE_SQL["project_all"]).fetchdf()
    assert records["edns_client_subnet"].notna().sum() > 20 and records["edns_other"].notna().sum() > 20
