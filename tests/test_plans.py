"""Every plan against its SQL, and that none passes with a constant score."""

import pytest
from oracle import same

from folioflow.plans import catalog, context, documents, flagship, grouping, learned, monitoring, operations, relations, scoring

PLANS = (flagship, scoring, documents, grouping, catalog, relations, monitoring, operations, context, learned)
CASES = [(p, name) for p in PLANS for name in p.QUERIES if name in p.SQL]
ONE_ROW = {"crawl_statistics", "processing_report", "filter_counts", "alert_statistics", "availability_summary", "rate_report", "key_checks", "source_health", "collection_stats", "recent_papers"}


@pytest.mark.parametrize("plan,name", CASES, ids=[n for _, n in CASES])
def test_equals_sql(spark, sf, plan, name):
    got = same(plan.QUERIES[name], plan.SQL[name], spark, sf)
    assert len(set(got)) > 1 or name in ONE_ROW


@pytest.mark.parametrize("name", [n for p in PLANS for n in p.QUERIES if n not in p.SQL])
def test_runs(spark, sf, name):
    plan = next(p for p in PLANS if name in p.QUERIES)
    assert plan.QUERIES[name](spark, sf).count() > 0
