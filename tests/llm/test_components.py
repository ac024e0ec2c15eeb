import random

import numpy as np
import pytest

from labelloom.llm import components as cc


def brute(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def graphs():
    rng = random.Random(3)
    path = [rng.randrange(-(1 << 63) + 1, 1 << 63) for _ in range(120)]
    return {
        "path": list(zip(path, path[1:])),
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(None, 1), (2, None), (3, 3)],
        "hubs": [(0, i) for i in range(1, 80)] + [(500, i) for i in range(80, 160)] + [(79, 80)],
    }


def test_stars_of_edges():
    for edges in graphs().values():
        a, b = np.array([e for e in edges if None not in e], np.int64).T
        node, root = cc.stars(a, b)
        want = {x: r for x, r in brute(edges).items() if x != r}
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == want


@pytest.mark.parametrize("kind", ["path", "random", "hubs"])
def test_edges_of_many_tasks(spark, monkeypatch, kind):
    monkeypatch.setattr(cc, "_EDGES", 5)  # few edges are contracted together
    monkeypatch.setattr(cc, "_contracted", lambda edges, one=cc._contracted: one(edges.repartition(12)))
    edges = graphs()[kind]
    found = cc.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == brute(edges)


def test_edges_of_one_task_need_no_round(spark, monkeypatch):
    def no_round(edges):
        raise AssertionError("shuffled again")

    monkeypatch.setattr(cc, "_round", no_round)
    edges = graphs()["path"]
    found = cc.components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    assert {r.node: r.root for r in found} == brute(edges)


def test_a_round_shuffles_three_times(spark):
    edges = cc.stored(spark.createDataFrame([(3, 2), (2, 1), (9, 3)], "a long, b long"), "edges")
    plan = cc._round(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
