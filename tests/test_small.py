"""Graphs that one task takes: as the rounds have them, and in few jobs however far they reach."""

import uuid

import numpy as np
import pytest

from lattica.operators.objects import Matrix
from lattica.plans import algorithms as alg
from lattica.plans import small
from lattica.store import bucketed


def _graph(spark, edges, n, kind="long"):
    return Matrix(spark.createDataFrame([(int(i), int(j), (float if kind == "double" else int)(v)) for (i, j), v in edges.items()], f"i long, j long, v {kind}"), n, n)


@pytest.fixture(scope="module")
def edges():
    """A path, a hub, a sparse random part and vertices without edges."""
    rng = np.random.default_rng(3)
    x = {(k, k + 1): 2 for k in range(9)} | {(20, k): 5 for k in range(21, 40)} | {(9, 20): 1, (5, 5): 1}
    return x | {(int(i), int(j)): int(rng.integers(1, 20)) for i, j in rng.integers(40, 90, (60, 2))} | {(30, 40): 3, (3, 7): -1}


def _jobs(spark, run):
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup(uuid.uuid4().hex, "")


def _both(monkeypatch, run):
    """(in one task, in rounds)."""
    one = run()
    monkeypatch.setattr(small, "EDGES", -1)
    return one, run()


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _path(spark, n=14):
    return _graph(spark, {e: 1 for k in range(n) for e in ((k, k + 1), (k + 1, k))}, n + 1)


def test_diameter(spark, monkeypatch, edges):
    one, rounds = _both(monkeypatch, lambda: alg.diameter(_graph(spark, edges, 100), 0, 12))
    assert one == rounds


def test_diameter_jobs(spark):
    assert _jobs(spark, lambda: alg.diameter(_path(spark), 0, 3)) < 14


def test_components(spark, monkeypatch, edges):
    one, rounds = _both(monkeypatch, lambda: _rows(alg.connected_components(_graph(spark, edges, 100)).df))
    assert one == rounds and len(one) == 100


def test_components_of_a_path_against_its_order(spark):
    order = np.random.default_rng(1).permutation(300)
    a = _graph(spark, {(int(a), int(b)): 1 for a, b in zip(order, order[1:])}, 302)
    assert [l for _, l in _rows(alg.connected_components(a).df)] == [0] * 300 + [300, 301]


def test_components_jobs(spark):
    assert _jobs(spark, lambda: alg.connected_components(_path(spark, 40)).df.count()) < 16


def test_paths(spark, monkeypatch, edges):
    for kind in ("long", "double"):
        with monkeypatch.context() as m:
            one, rounds = _both(m, lambda kind=kind: _rows(alg.sssp(_graph(spark, edges, 100, kind), 0, dense=False).df))
        assert one == rounds and type(one[0][1]) is type(rounds[0][1])


def test_paths_jobs(spark):
    assert _jobs(spark, lambda: alg.sssp(_path(spark), 0).df.count()) < 14


def test_breadth_first(spark, monkeypatch, edges):
    one, rounds = _both(monkeypatch, lambda: _rows(alg.bfs(_graph(spark, edges, 100), 0).df))
    assert one == rounds


def test_source_without_edges(spark):
    a = Matrix.new(spark, 4, 4, "long")
    assert _rows(alg.bfs(a, 2).df) == [(0, 0), (1, 0), (2, 1), (3, 0)]
    assert _rows(alg.sssp(a, 2, dense=False).df) == [(2, 0)]
    assert alg.diameter(a, 1, 4) == (0, 3)
    assert _rows(alg.connected_components(a).df) == [(k, k) for k in range(4)]


def test_breadth_first_jobs(spark):
    assert _jobs(spark, lambda: alg.bfs(_path(spark), 0).df.count()) < 14


def test_buckets_by_rows(spark):
    assert len(bucketed(_path(spark).df, "i", "few").inputFiles()) == 1
