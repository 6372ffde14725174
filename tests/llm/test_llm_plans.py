"""What the plans of the training-data queries must and must not contain."""

from pathlib import Path

import pytest

from clubledger.llm import mixing, simhash_bk
from clubledger.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")

#: Row-at-a-time Python and joins without a key: in none.
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
#: What else a query may have in its last plan: the search of op1 in pandas and its
#: ranking, Arrow where the operator is one of bytes, running sums in op7.
ALLOWED = {
    "op1_exact_top_k": {"MapInPandas", "Window"},
    "op4_packing": {"MapInArrow"},
    "op6_toxicity": {"MapInArrow"},
    "op7_token_files": {"MapInArrow", "Window"},
    "op9_language_id": {"MapInArrow"},
    "op10_quality": {"MapInArrow"},
    "op12_periodic_runs": {"MapInArrow"},
    "op13_warc": {"MapInArrow"},
    "pipeline": {"MapInArrow"},
}


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, capsys, name):
    plan = plan_of(QUERIES[name](spark, str(DATA)), capsys)
    for word in NEVER:
        assert word not in plan
    for word in ("InPandas", "MapInArrow", "Window"):
        if not any(word in allowed for allowed in ALLOWED.get(name, ())):
            assert word not in plan


@pytest.mark.parametrize("stage", [mixing.mixed_documents, simhash_bk.one_per_group])
def test_texts_are_dealt_out_once(spark, capsys, stage):
    # Large tables as Spark sees them, that is without broadcasts.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        plan = plan_of(stage(docs), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    details = plan.split("\n\n")
    with_text = [d for d in details if d.startswith("(") and " Exchange" in d and "text#" in d]
    assert len(with_text) == 1
