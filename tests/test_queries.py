"""Every registered query against its SQL, and what its plan may not contain."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402
from wirepulse.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in catalog.ORACLES:
        assert compare.compare(con, frame, catalog.ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_family_occurs(spark, sf_dir):
    hits = {r.hit for r in catalog.QUERIES["prefilter_family"](spark, sf_dir).select("hit").distinct().collect()}
    assert {"funding", "acquisition", "launch", "expansion", "rebrand", "partnership", None} <= hits


def test_funnel_finds_its_unique_items_once(spark, sf_dir):
    """Both counts come from one written table, not from the dedupe's last join made twice."""
    plan = catalog.QUERIES["funnel"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
