from __future__ import annotations

import pytest

from compare import same
from hashmark.plans import catalog

REGISTRY = catalog.registry()


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_against_sql(spark, small, oracle, name):
    same(REGISTRY.queries[name](spark, small), oracle, REGISTRY.sql[name])


def test_models_without_sql(spark, small):
    """What SQL can't repeat: predictions are probabilities, every row of the test seasons has one, and the shares add up."""
    run = lambda name: REGISTRY.queries[name](spark, small).collect()
    (win,) = run("win_model")
    assert win.n > 0 and 0 < win.log_loss < 3 and 0 <= win.brier <= 1 and 0 <= win.accuracy <= 1
    bins = run("play_call_model")
    assert bins and all(r.bin / 10 - 1e-9 <= r.predicted <= (r.bin + 1) / 10 + 1e-9 and 0 <= r.observed <= 1 for r in bins)
    audit = run("fourth_down_audit")
    assert audit and all(r.n > 0 and 0 <= r.agreement <= 1 and 0 <= r.go_rate <= 1 and 0 <= r.mean_regret <= 1 for r in audit)
    vectors = run("hashed_vectors")
    assert all(len(r.vector) == 256 and (abs(sum(x * x for x in r.vector) - 1) < 1e-5 or not any(r.vector)) for r in vectors)
    assert {"win_model", "play_call_model", "fourth_down_audit", "hashed_vectors"} == set(REGISTRY.queries) - set(REGISTRY.sql)


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
