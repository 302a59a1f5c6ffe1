"""Staleness over long pipelines, seals, and bounds that raise instead of stopping."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph, pipeline, statistics
from folioscope.plans.changes import PIPELINE


def brute_states(units, sealed, registry, holders, held):
    """Stage by stage in Python."""
    state = {}
    for s in registry.stages.values():
        for u in units[s.name]:
            sig = sealed.get((s.name, u))
            own = "never" if sig is None else "current" if sig == s.signature else "stale"
            if own == "current":
                for need in s.needs:
                    n = registry.stages[need]
                    if n.scope == s.scope:
                        hit = state.get((need, u), "current") != "current"
                    elif held.get(n.scope) == s.scope:
                        hit = any(state[need, c] != "current" for c in units[need] if holders[c] == u)
                    else:
                        hit = any(state[need, c] != "current" for c in units[need])
                    own = "stale" if hit else own
            state[s.name, u] = own
    return state


@pytest.mark.parametrize("broken", [(), (("read", "p1", "1:old"),), (("segment", "f2", None),), (("read", "p3", None), ("findings", "c1", "x")), (("ingest", "f1", "0"),)])
def test_unit_states_of_the_whole_pipeline(spark, broken):
    of = {"file": ["f1", "f2"], "page": ["p1", "p2", "p3"], "case": ["c1"]}
    holders = {"p1": "f1", "p2": "f1", "p3": "f2"}
    units = {s.name: of[s.scope] for s in PIPELINE.stages.values()}
    sealed = {(s.name, u): s.signature for s in PIPELINE.stages.values() for u in of[s.scope]} | {(s, u): sig for s, u, sig in broken}
    frame = spark.createDataFrame([(s, u) for s, us in units.items() for u in us], "stage string, unit string")
    seals = spark.createDataFrame([(s, u, sig, "done", 1) for (s, u), sig in sealed.items() if sig], "stage string, unit string, signature string, state string, sealed_at int")
    began = time.perf_counter()
    df = pipeline.unit_states(frame, seals, PIPELINE, spark.createDataFrame(list(holders.items()), "unit string, holder string"), {"page": "file"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 2 and len(PIPELINE.stages) == 17 and plan.count("Join") < 20
    assert {(r.stage, r.unit): r.state for r in df.collect()} == brute_states(units, sealed, PIPELINE, holders, {"page": "file"})


def test_invalid_seals_reach_what_depends_on_them(spark, rows):
    reg = pipeline.Registry([pipeline.Stage("a", "page"), pipeline.Stage("b", "page", ("a",)), pipeline.Stage("c", "page")])
    units = spark.createDataFrame([(s, "1") for s in "abc"], "stage string, unit string")
    seals = None
    for s in "abc":
        one = pipeline.seals_for(units.where(F.col("stage") == s), reg.stages[s], "done", "2020-01-01")
        seals = one if seals is None else seals.unionByName(one)
    assert {s for _, _, s in rows(pipeline.unit_states(units, seals, reg))} == {"current"}
    over = pipeline.invalidate(seals, reg, {"a"}, "2020-01-02")
    assert rows(pipeline.unit_states(units, over, reg)) == [("a", "1", "stale"), ("b", "1", "stale"), ("c", "1", "current")]


def test_runs_can_be_cancelled_and_cases_are_partial(spark):
    reg = pipeline.Registry([pipeline.Stage("a", "page"), pipeline.Stage("b", "page"), pipeline.Stage("c", "case", ("b",))])
    states = spark.createDataFrame([(s, "1", "never") for s in "abc"], "stage string, unit string, state string")

    def fail(_units):
        raise RuntimeError

    got = pipeline.run_stale(states, reg, {"a": fail, "b": lambda u: None, "c": lambda u: None}, "now")
    assert [(s, o) for s, _, o in got] == [("a", "failed"), ("b", "done"), ("c", "partial")]
    asked = iter([False, True])
    assert [s for s, *_ in pipeline.run_stale(states, reg, {k: lambda u: None for k in "abc"}, "now", lambda: next(asked))] == ["a"]


def test_unfinished_groups_raise(spark, rows):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    assert {c for _, c in rows(graph.components(path, "a", "b"))} == {0}
    with pytest.raises(RuntimeError):
        graph.components(path, "a", "b", most_rounds=1)


def test_conflicts_are_rescuable_if_a_reading_is_right(spark, rows):
    truth = spark.createDataFrame([(1, "f", "x"), (2, "f", "x"), (3, "f", "x"), (4, "f", None)], "id int, field string, v string")
    guess = spark.createDataFrame([(1, "f", "y", True, ["y", "x"]), (2, "f", "y", True, ["y", "z"]), (3, "f", "x", False, None), (4, "f", None, None, None)], "id int, field string, v string, torn boolean, seen array<string>")
    got = statistics.confusion(guess, truth, ["id", "field"], "v", F.lit(False), F.col("torn"), F.col("seen"))
    assert rows(got) == [("f", "correct_null", 1), ("f", "hit", 1), ("f", "in_conflict", 1), ("f", "rescuable", 1)]
