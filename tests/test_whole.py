"""Registered queries run over whole tables."""

from lexweave.plans import queries, registry
from tests.conftest import SMALL


def test_annotations_are_made_of_all_parts(spark):
    n = queries.table(spark, SMALL, "part").count()
    gold, pred = queries._annotated(spark, SMALL)
    assert (gold.count(), pred.count()) == (n, n)
    assert registry.queries()["entity_dedup_greedy"](spark, SMALL).count() == n
    # Some predictions meet nothing.
    assert registry.queries()["fuzzy_ratio_match"](spark, SMALL).filter("fp > 0 AND fn > 0").count() > 0
