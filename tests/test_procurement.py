"""Groups over shared keys against the walk of all pairs."""

from __future__ import annotations

import random

from folioscope.operators import graph


def all_pairs(docs):
    """node: group by the walk over all pairs; docs: node -> (label, keys)."""
    root = {n: n for n in docs}
    labels = {n: label for n, (label, _) in docs.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and docs[a][1] & docs[b][1]:
                linked |= {a, b}
                x, y = sorted((find(a), find(b)))
                if x != y and not (labels[x] and labels[y] and labels[x] != labels[y]):
                    root[y] = x
                    labels[x] = labels[x] or labels[y]
    return {n: find(n) for n in linked}


def test_cliques_equal_the_walk_of_all_pairs(spark):
    rng = random.Random(11)
    cases = {"c": {1: ("A", {"s"}), 2: ("B", {"s"}), 3: ("A", {"s"}), 4: ("B", {"s"})}}
    for k in range(300):
        keys = rng.randint(1, 6)
        cases[f"r{k}"] = {n: (rng.choice([None, None, "A", "B", "C"]), {f"s{rng.randrange(keys)}" for _ in range(rng.randint(1, 3))}) for n in range(rng.randint(2, 12))}
    rows_ = [(c, key, n, label) for c, docs in cases.items() for n, (label, keys) in docs.items() for key in keys]
    df = spark.createDataFrame(rows_, "case_id string, key string, node bigint, label string")
    got: dict = {c: {} for c in cases}
    for r in graph.constrained_cliques(df, "case_id", "key", "node", "label").collect():
        got[r.case_id][r.node] = r.group
    assert got["c"] == {1: 1, 2: 2, 3: 1, 4: 2}
    assert got == {c: all_pairs(docs) for c, docs in cases.items()}


def test_papers_near_each_other_or_of_one_set(spark):
    from folioscope.operators import procurement

    rng = random.Random(5)
    papers = {n: ("c", n, f"f{rng.randrange(3)}", p := rng.randrange(30), p + rng.randrange(4), f"t{rng.randrange(3)}", rng.choice([None, None, "A", "B"])) for n in range(60)}
    anchors = {n: {f"k{rng.randrange(12)}"} for n in papers if rng.random() < 0.3}
    sets = {"f0": "s", "f1": "s"}
    root, label = {n: n for n in papers}, {n: p[6] for n, p in papers.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in papers:
        for b in papers:
            if a >= b:
                continue
            pa, pb = papers[a], papers[b]
            tax = pa[5] == pb[5]
            near = pa[2] == pb[2] and abs(pa[4] - pb[3]) <= 3
            together = pa[2] in sets and pb[2] in sets
            if anchors.get(a, set()) & anchors.get(b, set()) or (tax and (near or together)):
                x, y = sorted((find(a), find(b)))
                if x != y and not (label[x] and label[y] and label[x] != label[y]):
                    root[y] = x
                    label[x] = label[x] or label[y]
    want: dict = {}
    for n in papers:
        want.setdefault(find(n), set()).add(n)
    df = spark.createDataFrame(list(papers.values()), "case_id string, node bigint, file string, page_from int, page_to int, tax string, label string")
    keys = spark.createDataFrame([("c", n, k) for n, ks in anchors.items() for k in ks], "case_id string, node bigint, key string")
    files = spark.createDataFrame([("c", f, s) for f, s in sets.items()], "case_id string, file string, set string")
    got: dict = {}
    for r in procurement.procurement_groups(df, keys, files).collect():
        got.setdefault(r.group, set()).add(r.node)
    assert got == {g: ns for g, ns in want.items() if len(ns) > 1}


def test_decisions_on_an_older_fact_do_not_count(spark, rows):
    from folioscope.operators import decisions

    facts = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 2), (3, "c", "x", 1)], "k int, literal string, state string, version int")
    log = spark.createDataFrame([(1, 1, "correct", "z", 1), (2, 1, "correct", "z", 1), (3, 1, "ambiguous", None, 1)], "k int, decision_id int, action string, value string, version int")
    assert rows(decisions.overlay(facts, log, ["k"], lock="version"), "k", "literal", "state") == [(1, "z", "corregido"), (2, "b", "x"), (3, None, "ambiguo")]
