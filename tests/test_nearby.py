"""Name and jersey candidates from counts: against the SQL on odd rows, and without pairs."""

import random
from datetime import datetime, timedelta

import pytest

from ridgeline.plans import catalog

FROM, HOUR = datetime(2024, 1, 1), timedelta(hours=1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event(i, at, what, k):
    return (i, at, 1, what, 1.0, None if k is None else f'{{"k": {k}}}')


def _both(spark, tmp_path, rows):
    import duckdb

    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()["name_jersey_candidates"](spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["name_jersey_candidates"]).fetchall()
    return got, sorted(map(str, want))


def _most_rows(plan):
    """The largest number of rows that a node of a plan that has run put out."""
    name, out = plan.getClass().getSimpleName(), 0
    metric = plan.metrics().get("numOutputRows")
    if metric.isDefined():
        out = metric.get().value()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    below += [children.apply(i) for i in range(children.size())]
    return max([out, *map(_most_rows, below)])


@pytest.mark.parametrize("seed", range(3))
def test_against_sql_on_odd_rows(spark, tmp_path, seed):
    """Repeated, missing and shared ids, missing times and objects, and gaps of exactly two days."""
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        at = None if rng.random() < 0.05 else FROM + rng.randrange(240) * HOUR + timedelta(microseconds=rng.choice([0, 0, 0, -1, 1]))
        rows.append(_event(rng.choice([None, *range(250)]), at, rng.choice(["view", "view", "signup", "signup", "purchase", "error", None]), rng.choice([None, 1, 2, 3, 4, 5])))
    rows += [_event(None, at, what, k) for at, what, k in ((FROM, "view", 77), (FROM, "view", 78), (FROM + 48 * HOUR, "signup", 77))]
    rows += [_event(900, FROM, "view", 79), _event(None, FROM + 48 * HOUR, "signup", 79), _event(901, FROM, "view", 80), _event(902, FROM, "signup", 80), _event(903, FROM, "purchase", 80)]
    rows += rows[:20]
    got, want = _both(spark, tmp_path, rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert str(("F900", 0, "ambiguous")) in want and str(("F901", 1, "accepted")) in want


def test_no_pairs_are_made(spark, tmp_path):
    """1,500 mentions near 1,500 jerseys of one object: no step of the plan has their 2,250,000 pairs."""
    rows = [_event(i, FROM + timedelta(seconds=i), ("view", "signup")[i % 2], 1) for i in range(3000)]
    got, want = _both(spark, tmp_path, rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert _most_rows(got._jdf.queryExecution().executedPlan()) < 20_000
