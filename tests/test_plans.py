"""What the plans must and must not contain."""

import datetime as dt
from pathlib import Path

import pytest

from clubledger.operators import filters, newsletter
from clubledger.operators.addresses import address_list
from clubledger.session import write_through
from clubledger.workload import inputs
from clubledger.workload.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def people(spark):
    return write_through(inputs.people(spark, str(DATA)), "people")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, capsys, name):
    plan = plan_of(QUERIES[name](spark, str(DATA)), capsys)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "Window"):
        assert word not in plan


#: The rounds of the merged household list depend on the data; the others are about
#: tables that are written first.
WRITE_FIRST = {
    "household_list_merged", "household_list_printed", "stored_adults_joined",
    "stored_lookup_number", "sync_stored",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITE_FIRST))
def test_building_runs_no_job(spark, name):
    """No other query runs jobs before its result is asked for."""
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", "building")
    try:
        QUERIES[name](spark, str(DATA))
        jobs = context.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # Reading a Parquet file's schema is a job of one task per call.
    stages = [s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
    tasks = [context.statusTracker().getStageInfo(s) for s in stages]
    assert all(t.name.startswith("parquet at") for t in tasks if t), [t.name for t in tasks if t]


def test_newsletter_shuffles_once_and_reads_five_columns(people, capsys):
    plan = plan_of(newsletter.newsletter_rows(people, inputs.AS_OF), capsys)
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1
    schema = next(x for x in plan.splitlines() if x.startswith("ReadSchema"))
    assert schema.count(":") == 1 + 5
    assert "PushedFilters: [IsNotNull(email), Not(EqualTo(email,))]" in plan


def test_lists_filter_in_the_scan(people, capsys):
    joined = filters.adults_joined_between(people, dt.date(1986, 1, 1), dt.date(1987, 1, 1))
    plan = plan_of(address_list(joined), capsys)
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(date_added,1986-01-01)" in pushed
    assert "LessThan(date_added,1987-01-01)" in pushed and "In(category" in pushed
    assert "Exchange" not in plan


def test_assembly_lists_are_one_pass_without_a_join(people, capsys):
    plan = plan_of(address_list(filters.assembly_lists(people, 2015), "list_name"), capsys)
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Join" not in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(date_added,2014-01-01)" in plan


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_partitions_do_not_matter(people, partitions):
    once = newsletter.newsletter_rows(people, inputs.AS_OF)
    again = newsletter.newsletter_rows(people.repartition(partitions), inputs.AS_OF)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
