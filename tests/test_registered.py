"""Every registered query against its SQL, and what its plan may hold."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.oracles import ORACLES
from tests.conftest import SF
from veedor.functions.flags import enrich
from veedor.operators.listing import filtered_counts
from veedor.operators.scope import Scope
from veedor.plans.queries import QUERIES
from veedor.plans.risk import RANKING_COLUMNS
from veedor.sources.export import read_contracts, write_contracts
from veedor.sources.star import contracts


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    rows = df.toPandas()
    if name in ORACLES:
        assert difference(rows, sql.execute(ORACLES[name]).df()) == ""
    else:
        assert len(rows) or name == "hybrid_ranking"


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert tuple(contract.entry(spark).columns) == RANKING_COLUMNS


def test_scope_reaches_the_scan(spark, tmp_path):
    write_contracts(contracts(spark, SF), str(tmp_path / "c"))
    df = filtered_counts(enrich(Scope("ASIA", "NATION_2", 1997).apply(read_contracts(spark, str(tmp_path / "c")))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):]
    assert "anio_inicio" in scan and "ASIA" in scan[:scan.index("PushedFilters")]
    pushed = scan[scan.index("PushedFilters"):scan.index("ReadSchema")]
    assert "GreaterThanOrEqual(fecha_inicio" in pushed and "LessThan(fecha_inicio" in pushed and "NATION_2" in pushed
    read = scan[scan.index("ReadSchema"):]
    assert "objeto_raw" not in read.split("\n")[0] and "proveedor" not in read.split("\n")[0]


def test_filter_after_flags_reaches_the_scan(spark, tmp_path):
    write_contracts(contracts(spark, SF), str(tmp_path / "c"))
    df = Scope("ASIA", None, 1997).apply(enrich(read_contracts(spark, str(tmp_path / "c"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fecha_inicio" in plan
