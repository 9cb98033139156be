import pytest
from pyspark.sql import functions as F

from faultline.operators import evidence
from faultline.operators import rules_data as R
from faultline.plans import detail_queries, fixtures




@pytest.fixture(scope="module")
def read(spark, sf):
    return evidence.extract_evidence(fixtures.candidates(spark, sf)).localCheckpoint()


@pytest.mark.parametrize("only", [R.REPORT_FIELDS, ("narrative_hedge",), ("automation_engagement_narrative", "city", "candidate.city"), ("no_contact_occurred_narrative", "location_precision")])
def test_only_some_atoms(read, only):
    rows = lambda a: sorted(map(str, a.drop("ord").collect()))
    assert rows(evidence.atoms(read, only=only)) == rows(evidence.atoms(read).filter(F.col("field").isin(*only)))


def test_no_such_atoms(read):
    with pytest.raises(ValueError):
        evidence.atoms(read, only=("nothing",))


def test_values_of_fields_need_no_narrative(spark, sf):
    """No pattern is tried for atoms of report fields."""
    plan = detail_queries.e15_atom_values(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)" not in plan


def test_hedges_are_read_once(spark, sf):
    """Both sides of the comparison read the written evidence, not the raw rows."""
    plan = detail_queries.v1_hedges_carried(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
