"""Operators, objects, files and algorithms on small graphs, against plain loops."""

import functools
import heapq
import itertools
import operator
import random
from collections import defaultdict

import pytest

from lattica import errors
from lattica.functions import algebra
from lattica.functions.algebra import BINARY, MONOID, SEMIRING, UNARY
from lattica.operators.elementwise import apply, ewise_add, ewise_mult, scale
from lattica.operators.objects import Descriptor, Matrix, Vector
from lattica.operators.products import mxm, mxv, trace_mxm_transpose, vxm
from lattica.operators.structure import assign_constant, reduce_rows, reduce_scalar, scatter, transpose, tril
from lattica.plans import algorithms as alg
from lattica.plans import verify
from lattica.plans.fixpoint import Stats
from lattica.sources.matrix_market import UNDIRECTED, load, read_mtx, save, write_mtx
from lattica.streaming.ingest import current, ingest_edges

PR = [(1, 0), (2, 0), (3, 0), (2, 1), (3, 1), (0, 2), (0, 3), (2, 3)]


def graph(spark, edges, n, values=None):
    return Matrix.build(spark, [a for a, _ in edges], [b for _, b in edges], values or [1] * len(edges), n, n)


def random_edges(seed, n, m, undirected=True):
    r = random.Random(seed)
    e = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}
    return sorted(e | {(b, a) for a, b in e} if undirected else e)


def dense(v, n, fill=0):
    got = dict(v.extract_tuples())
    return [got.get(i, fill) for i in range(n)]


# products


@pytest.mark.parametrize("name,add,mul,zero", [("plus_times", lambda a, b: a + b, lambda a, b: a * b, 0), ("min_plus", min, lambda a, b: a + b, float("inf")), ("max_times", max, lambda a, b: a * b, 0)])
@pytest.mark.parametrize("masked", [None, False, True])
def test_products_against_loops(spark, name, add, mul, zero, masked):
    edges = random_edges(1, 12, 40, False)
    r = random.Random(2)
    w = [r.randint(1, 9) for _ in edges]
    A, u = graph(spark, edges, 12, w), Vector.build(spark, [0, 3, 4, 7], [2, 1, 5, 3], 12)
    mask = None if masked is None else Vector.build(spark, [1, 2, 3, 5, 8], [1, 0, 1, 1, 1], 12)
    allowed = {None: set(range(12)), False: {1, 3, 5, 8}, True: set(range(12)) - {1, 3, 5, 8}}[masked]
    values = {0: 2, 3: 1, 4: 5, 7: 3}
    for product, key, inner in ((mxv, 0, 1), (vxm, 1, 0)):
        want = {}
        for e, x in zip(edges, w, strict=True):
            if e[inner] in values and e[key] in allowed:
                term = mul(x, values[e[inner]])
                want[e[key]] = add(want[e[key]], term) if e[key] in want else term
        args = (A, u) if product is mxv else (u, A)
        got = product(*args, SEMIRING[name], mask=mask, desc=Descriptor(complement=bool(masked)))
        assert dict(got.extract_tuples()) == want
    assert mxv(A, u.clear(), SEMIRING[name]).nvals() == 0


def test_accumulate_and_replace(spark):
    A, u = graph(spark, PR, 4), Vector.build(spark, [0, 1], [1, 10], 4)
    w, mask = Vector.build(spark, [0, 2, 3], [100, 200, 300], 4), Vector.build(spark, [2, 3], [1, 1], 4)
    # A u: rows 1 -> 1, 2 -> 11, 3 -> 11
    assert mxv(A, u, SEMIRING["plus_times"], accum=BINARY["plus"], w=w).extract_tuples() == [(0, 100), (1, 1), (2, 211), (3, 311)]
    kept = mxv(A, u, SEMIRING["plus_times"], mask=mask, accum=BINARY["plus"], w=w)
    assert kept.extract_tuples() == [(0, 100), (2, 211), (3, 311)]
    only = mxv(A, u, SEMIRING["plus_times"], mask=mask, accum=BINARY["plus"], w=w, desc=Descriptor(replace=True))
    assert only.extract_tuples() == [(2, 211), (3, 311)]


def test_mxm_and_traces(spark):
    A = graph(spark, PR, 4)
    pairs = defaultdict(int)
    for (i, k), (k2, j) in itertools.product(PR, PR):
        if k == k2:
            pairs[i, j] += 1
    assert {(i, j): v for i, j, v in mxm(A, A, SEMIRING["plus_times"]).extract_tuples()} == dict(pairs)
    masked = {(i, j): v for i, j, v in mxm(A, A, SEMIRING["plus_times"], mask=A).extract_tuples()}
    assert masked == {e: pairs.get(e, 0) for e in PR}
    d = Matrix.build(spark, [*range(7), 7], [*range(7), 6], [*range(7), 0], 8, 8)
    assert trace_mxm_transpose(SEMIRING["plus_times"], d, d) == 91
    assert transpose(A).extract_tuples() == sorted((b, a, 1) for a, b in PR)
    assert [(i, j) for i, j, _ in tril(A).extract_tuples()] == sorted((a, b) for a, b in PR if a >= b)


def test_elementwise(spark):
    u = [1, 1, 3, 2, 2, 0, 3, 0, 1, 0, 2]
    v = [1, 0, 3, 2, 2, 3, 0, 0, 1, 2, 2]
    U, V = (Vector.build_dense(spark, x).to_sparse() for x in (u, v))
    assert dense(ewise_mult(U, V, SEMIRING["plus_times"]), 11) == [1, 0, 9, 4, 4, 0, 0, 0, 1, 0, 4]
    assert dense(ewise_add(U, V, SEMIRING["plus_times"]), 11) == [a + b for a, b in zip(u, v, strict=True)]
    assert dense(scale(U, 3), 11) == [3 * a for a in u]
    assert dense(apply(UNARY["negate"], U), 11) == [-a for a in u] if "negate" in UNARY else True
    with pytest.raises(errors.DimensionMismatch):
        ewise_mult(U, Vector.build(spark, [0], [1], 3), SEMIRING["plus_times"])


def test_reduce_assign_scatter(spark):
    A = graph(spark, PR, 4)
    assert dense(reduce_rows(A, MONOID["plus"]), 4) == [2, 1, 3, 2]
    assert reduce_scalar(A, MONOID["plus"]) == 8
    assert reduce_scalar(Vector.new(spark, 4, "long"), MONOID["plus"]) == 0
    assert reduce_scalar(Vector.build(spark, range(10), [1, 2, 3, 4, 5, 6, 7, 8, 0, 2], 10), MONOID["multiplies"]) == 0
    w = Vector.fill(spark, 4, 0)
    mask = Vector.build(spark, [1, 2], [1, 0], 4)
    assert dense(assign_constant(w, 7, mask), 4) == [0, 7, 0, 0]
    assert dense(assign_constant(w, 7, mask, desc=Descriptor(complement=True)), 4) == [7, 0, 7, 7]
    assert dense(scatter(w, Vector.build(spark, [0, 1, 2], [0, 3, 3], 4), 5), 4) == [0, 0, 0, 5]


# objects


def test_objects(spark):
    v = Vector.build(spark, [2, 0, 2], [5, 1, 6], 4)
    assert v.extract_tuples() == [(0, 1), (2, 11)] and v.nvals() == 2 and v.count_unique() == 2
    assert Vector.build(spark, [2, 2], [5, 6], 4, BINARY["minimum"]).extract_tuples() == [(2, 5)]
    assert v.set_element(3, 9).set_element(0, 4).extract_tuples() == [(0, 4), (2, 11), (3, 9)]
    assert v.to_dense().extract_tuples() == [(0, 1), (1, 0), (2, 11), (3, 0)] and v.to_dense().nvals() == 4
    assert v.resize(1).extract_tuples() == [(0, 1)] and v.extract_element(2) == 11
    for call, error in ((lambda: v.extract_element(1), errors.NoValue), (lambda: v.set_element(4, 1), errors.IndexOutOfBounds), (lambda: Vector.build(spark, [9], [1], 4), errors.IndexOutOfBounds), (lambda: v.extract_tuples(1), errors.InsufficientSpace)):
        with pytest.raises(error):
            call()
    m = Matrix.build_csr(spark, [0, 2, 2, 3], [0, 2, 1], [1, 2, 3], 3)
    assert m.extract_tuples() == [(0, 0, 1), (0, 2, 2), (2, 1, 3)] and m.resize(1, 3).nvals() == 2
    m.check()
    with pytest.raises(errors.InvalidObject):
        Matrix.of(spark.createDataFrame([(0, 9, 1)], "i long, j long, v long"), 3, 3).check()
    with pytest.raises(errors.InvalidValue):
        Matrix.new(spark, 0, 3)
    with pytest.raises(errors.DimensionMismatch):
        mxv(m, Vector.new(spark, 5), SEMIRING["plus_times"])
    with pytest.raises(errors.UninitializedObject):
        mxv(m, None, SEMIRING["plus_times"])


def test_not_every_operator_reduces(spark):
    A, u = graph(spark, PR, 4), Vector.fill(spark, 4, 1)
    with pytest.raises(ValueError):
        mxv(A, u, SEMIRING["greater_plus"])


# files and streams


def test_matrix_market(spark, tmp_path):
    f = tmp_path / "a.mtx"
    f.write_text("%%MatrixMarket matrix coordinate integer symmetric\n% c\n4 4 5\n2 1 7\n3 1 5\n3\t3 9\n4 2 -1\n4 2 -1\n")
    assert read_mtx(spark, str(f)).extract_tuples() == [(0, 1, 7), (0, 2, 5), (1, 0, 7), (1, 3, -1), (2, 0, 5), (3, 1, -1)]
    assert read_mtx(spark, str(f), keep_loops=True).nvals() == 7
    g = tmp_path / "b.mtx"
    g.write_text("%%MatrixMarket matrix coordinate pattern general\n4 4 2\n1 2\n3 4\n")
    assert read_mtx(spark, str(g)).extract_tuples() == [(0, 1, 1), (2, 3, 1)]
    assert read_mtx(spark, str(g), UNDIRECTED).nvals() == 4
    m = read_mtx(spark, str(f), keep_loops=True)
    write_mtx(m, str(tmp_path / "out"), "integer")
    again = read_mtx(spark, str(tmp_path / "out"), keep_loops=True)
    assert again.extract_tuples() == m.extract_tuples()
    # parts of a folder are not read in the order of their names
    big = Matrix.build(spark, range(4000), range(4000), [i * i for i in range(4000)], 4000, 4000)
    write_mtx(big, str(tmp_path / "big"), "integer")
    assert read_mtx(spark, str(tmp_path / "big"), keep_loops=True).extract_tuples() == big.extract_tuples()
    save(m, str(tmp_path / "saved"))
    assert load(spark, str(tmp_path / "saved")).extract_tuples() == m.extract_tuples()
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 0 0\n")
    with pytest.raises(errors.DomainMismatch):
        read_mtx(spark, str(tmp_path / "c.mtx"))


def test_stream_of_edges(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(0, 1, 2), (0, 1, 3), (1, 2, 1)], "i long, j long, v long").write.parquet(str(src))
    stream = spark.readStream.schema("i long, j long, v long").parquet(str(src))
    ingest_edges(stream, str(tmp_path / "m"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, current(spark, str(tmp_path / "m")).collect())) == [(0, 1, 5), (1, 2, 1)]


# algorithms


def hops(edges, s, n):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    d, todo = {s: 1}, [s]
    for x in todo:
        for y in near[x]:
            if y not in d:
                d[y] = d[x] + 1
                todo.append(y)
    return [d.get(i, 0) for i in range(n)]


def test_bfs_and_diameter(spark):
    assert dense(alg.bfs(graph(spark, PR, 4), 0), 4) == [1, 3, 2, 2]
    edges, stats = random_edges(3, 40, 45), Stats()
    A = graph(spark, edges, 40)
    assert dense(alg.bfs(A, 0, stats=stats), 40) == hops(edges, 0, 40) and stats.rounds
    far = [max(hops(edges, s, 40)) - 1 for s in range(10)]
    assert alg.diameter(A, 0, 10) == (max(far), max(s for s in range(10) if far[s] == max(far)))


def test_sssp(spark):
    edges = random_edges(4, 30, 60, False)
    r = random.Random(5)
    w = [r.randint(1, 64) for _ in edges]
    near = defaultdict(list)
    for (a, b), x in zip(edges, w, strict=True):
        near[a].append((b, x))
    best, todo = {}, [(0, 0)]
    while todo:
        d, x = heapq.heappop(todo)
        if x not in best:
            best[x] = d
            for y, c in near[x]:
                heapq.heappush(todo, (d + c, y))
    assert dict(alg.sssp(graph(spark, edges, 30, w), 0, dense=False).extract_tuples()) == best


def test_pagerank(spark):
    got = dense(alg.pagerank(graph(spark, PR, 4), max_rounds=10), 4)
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, [0.364337, 0.196638, 0.192332, 0.246693], strict=True))


def test_components_triangles(spark):
    edges = random_edges(6, 60, 45)
    A = graph(spark, edges, 60)
    want = list(range(60))
    for _ in range(60):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    labels = alg.connected_components(A)
    assert dense(labels, 60, None) == want
    assert tuple(verify.component_violations(A, labels).first())[:2] == (0, 0)
    e = random_edges(7, 20, 80)
    triangles = sum((a, b) in e and (b, c) in e and (a, c) in e for a, b, c in itertools.combinations(range(20), 3))
    assert alg.triangle_count(graph(spark, e, 20)) == triangles


def test_independent_sets_and_colors(spark):
    A = graph(spark, random_edges(8, 30, 70), 30)
    assert tuple(verify.independence_violations(A, alg.maximal_independent_set(A)).first()) == (0, 0)
    for colors in (alg.color_jones_plassmann(A), alg.color_jones_plassmann(A, per_round=True), alg.color_mis(A), alg.color_independent(A)):
        assert tuple(verify.coloring_violations(A, colors).first()) == (0, 0)


def test_local_clustering(spark):
    """The push rounds in a plain loop."""
    edges = random_edges(9, 20, 40)
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    alpha, eps = 0.15, 1e-4
    p, r, front = defaultdict(float), defaultdict(float, {0: 1.0}), {0}
    for _ in range(5):
        push = defaultdict(float)
        for x in front:
            p[x] += alpha * r[x]
            own = (1 - alpha) / 2 * r[x]
            for y in near[x]:
                push[y] += own / len(near[x])
            r[x] = own
        for y, x in push.items():
            r[y] += x
        front = {x for x in r if near[x] and r[x] >= len(near[x]) * eps}
    got = dict(alg.local_clustering(graph(spark, edges, 20), 0, alpha, eps, 5).extract_tuples())
    assert {k: pytest.approx(v) for k, v in p.items() if v} == {k: v for k, v in got.items() if v}


def test_output_under_a_mask(spark):
    """Without an accumulator old entries outside the mask stay, unless they are to be replaced."""
    A = Matrix.build(spark, [0, 1, 2], [0, 1, 2], [1, 1, 1], 3, 3)
    u, w, mask = Vector.build_dense(spark, [5, 6, 7]), Vector.build_dense(spark, [100, 200, 300]), Vector.build(spark, [0], [1], 3)
    call = lambda **k: mxv(A, u, SEMIRING["plus_times"], mask=mask, w=w, desc=Descriptor(**k)).extract_tuples()
    assert call() == [(0, 5), (1, 200), (2, 300)]
    assert call(replace=True) == [(0, 5)]
    assert call(complement=True) == [(0, 100), (1, 6), (2, 7)]
    assert call(complement=True, replace=True) == [(1, 6), (2, 7)]


def test_integers_keep_their_digits(spark):
    big = 9007199254740993
    v = Vector.build(spark, [0, 1], [big, big + 2], 3)
    assert reduce_scalar(v, MONOID["minimum"]) == big
    assert dict(reduce_rows(Matrix.build(spark, [0, 0], [0, 1], [big, big + 2], 2, 2), MONOID["minimum"]).df.dtypes)["v"] == "bigint"
    assert reduce_scalar(Vector.new(spark, 3, "long"), MONOID["minimum"]) == (1 << 63) - 1


@pytest.mark.parametrize("part", [2, 7, 1024])
def test_monoid_of_the_caller(spark, monkeypatch, part):
    monkeypatch.setattr(algebra, "PART", part)
    rows = [i % 3 if i % 5 else 4 for i in range(300)]
    A = Matrix.of(spark.createDataFrame([(r, i, i * i + 1) for i, r in enumerate(rows)], "i long, j long, v long"), 5, 300)
    xor = algebra.Monoid.custom("xor", algebra.BinaryOp("xor", lambda a, b: a.bitwiseXOR(b)), 0)
    want = {}
    for i, r in enumerate(rows):
        want[r] = want.get(r, 0) ^ (i * i + 1)
    assert reduce_rows(A, xor, dense=False).extract_tuples() == sorted(want.items())
    assert reduce_scalar(A, xor) == functools.reduce(operator.xor, want.values())
    assert reduce_scalar(A.clear(), xor) == 0
