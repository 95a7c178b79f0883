"""Units that targets name: each pair once, and pairs are not grouped."""

from __future__ import annotations

import random

from threadloom.operators import relations


def test_named_units_by_brute_force(spark):
    pick = random.Random(3)
    units = [(f"u{i}", pick.choice(["s1", "s2", None, "u3"]), pick.choice(["p", "q", "s1", None])) for i in range(40)] + [("u1", "s2", "q")]
    targets = [(pick.randrange(5), pick.choice(["u1", "u3", "s1", "s2", "p", "q", "none", None])) for _ in range(30)]
    found = relations.named_units(spark.createDataFrame(targets, "query_id long, target string"), spark.createDataFrame(units, "unit_id string, source_id string, path string"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == {(q, u[0]) for q, t in targets for u in units if t is not None and t in u} and len(rows) == len(set(rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "query_id" in line]
