"""Masked products in cells of a grid."""

import numpy as np
import pytest

from lattica.functions.algebra import SEMIRING
from lattica.operators import cells
from lattica.operators.objects import Matrix
from lattica.operators.products import mxm
from lattica.plans import algorithms


def _matrix(spark, entries, n, kind="long"):
    return Matrix(spark.createDataFrame([(int(i), int(j), v) for (i, j), v in entries.items()], f"i long, j long, v {kind}"), n, n)


@pytest.fixture(scope="module")
def operands():
    """Sparse parts, a full row and a full column."""
    rng, n = np.random.default_rng(5), 60
    a, b, m = ({(i, j): int(rng.integers(1, 9)) for i, j in rng.integers(0, n, (300, 2))} for _ in range(3))
    a |= {(7, k): 2 for k in range(n)}
    b |= {(k, 9): 3 for k in range(n)}
    m |= {(7, j): 1 for j in range(n)} | {(11, 12): 0}
    return n, a, b, m


def test_masked_product_values(spark, operands):
    n, a, b, m = operands
    A, B, M = _matrix(spark, a, n), _matrix(spark, {k: float(v) / 2 for k, v in b.items()}, n, "double"), _matrix(spark, m, n)
    for name, add, mul in (("plus_times", sum, lambda x, y: x * y), ("min_plus", min, lambda x, y: x + y)):
        got = {(r["i"], r["j"]): r["v"] for r in mxm(A, B, SEMIRING[name], mask=M, keep_pattern=False).df.collect()}
        want = {}
        for (i, j), v in m.items():
            if v and (found := [mul(a[i, k], b[k, j] / 2) for k in range(n) if (i, k) in a and (k, j) in b]):
                want[i, j] = add(found)
        assert got == want


def test_masked_product_joins_no_paths(spark, operands):
    """No join makes the paths of two edges: their number grows with the square of a degree."""
    n, a, b, m = operands
    A, M = _matrix(spark, a, n), _matrix(spark, m, n)
    plan = mxm(A, A, SEMIRING["plus_times"], mask=M, keep_pattern=False).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_every_entry_is_dealt_to_as_many_cells_whatever_its_degree(spark):
    """A hub of 400 neighbours, all edges masked: 160,000 paths, 400 entries."""
    hub = _matrix(spark, {(0, k): 1 for k in range(1, 401)}, 500)
    found = cells.terms(hub.df.select("i", "j"), hub.df.selectExpr("i", "j _k", "v _a"), hub.df.selectExpr("i _k", "j", "v _b"))
    assert found.count() == 0
    dealt = found._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count("Generate explode") == 3 and "Join" not in dealt


def test_paths_in_steps(monkeypatch, operands):
    """However few entries are walked at a time, and with repeated entries."""
    _, a, b, m = operands
    mi, mj = np.array(list(m)).T
    (ai, ak), (bk, bj) = np.array([*a, *list(a)[:40]]).T, np.array([*b, *list(b)[:40]]).T
    want = sorted((x, p, q) for x in range(len(mi)) for p in np.flatnonzero(ai == mi[x]) for q in np.flatnonzero((bj == mj[x]) & (bk == ak[p])))
    for step in (1, 7, 1 << 21):
        monkeypatch.setattr(cells, "STEP", step)
        got = sorted(t for part in cells._paths(mi, mj, cells._Block(ai, ak), cells._Block(bj, bk)) for t in zip(*part))
        assert got == want


def test_triangles_of_a_hub_and_a_clique(spark):
    clique = {(i, j): 1 for i in range(12) for j in range(12) if i != j}
    star = {e: 1 for k in range(12, 200) for e in ((0, k), (k, 0))}
    assert algorithms.triangle_count(_matrix(spark, clique | star, 200)) == 220
