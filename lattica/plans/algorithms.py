"""Graph algorithms over an adjacency matrix (i, j, v), as rounds of joins and aggregates.

The edges are written once, bucketed and sorted by i: a round shuffles the frontier or the vertex state,
never the edges. State is one row per vertex. Up to small.EDGES edges, one task takes the graph for breadth-first
search, diameter, shortest paths and components.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.errors import DimensionMismatch, IndexOutOfBounds, InvalidValue
from lattica.functions.algebra import INFINITY, MONOID, SEMIRING, hash_weight
from lattica.operators.objects import Matrix, Vector
from lattica.operators.products import mxm
from lattica.operators.structure import reduce_df
from lattica.plans import small
from lattica.plans.fixpoint import Stats, iterate
from lattica.store import bucketed, cut

MAX_ROUNDS = 10_000
#: Levels that are kept apart before they are written together.
PARTS = 16


def _square(A: Matrix) -> None:
    if A.nrows != A.ncols:
        raise DimensionMismatch("the matrix must be square")


def _source(A: Matrix, s: int) -> None:
    _square(A)
    if not 0 <= s < A.nrows:
        raise IndexOutOfBounds(s)


def _edges(df: DataFrame, name: str, whole: bool = True) -> tuple[DataFrame, bool]:
    """The edges written, and whether one task is to take them: they are few, and the caller (whole) watches no rounds. If not, they are bucketed."""
    kept, seen = cut(df, name)
    one = whole and seen["n"] <= small.EDGES
    return (kept if one else bucketed(kept, "i", name, seen["n"])), one


def _levels(edges: DataFrame, sources: DataFrame, max_rounds: int, stats: Stats | None) -> DataFrame:
    """(src, i, d): hops from each source, counted from 1. All sources advance in one loop."""
    start = sources.select(F.col("i").alias("src"), "i", F.lit(1).cast("long").alias("d"))
    front, seen = cut(start, "levels")
    visited, parts, n = front, 1, seen["n"]
    for k in range(1, max_rounds + 1):  # a round writes its new vertices, no others
        begun = time.time()
        near = front.join(edges.select("i", "j"), "i").select("src", F.col("j").alias("i")).distinct()
        fresh = near.join(visited.select("src", "i"), ["src", "i"], "left_anti").select("src", "i", F.lit(k + 1).cast("long").alias("d"))
        front, seen = cut(fresh, "levels")
        n += seen["n"]
        if stats:
            stats.rounds.append((k, n, time.time() - begun))
        if not seen["n"]:
            break
        visited, parts = visited.unionByName(front), parts + 1
        if parts == PARTS:
            visited, parts = cut(visited, "levels")[0], 1
    return visited


def bfs(A: Matrix, source: int, max_rounds: int = MAX_ROUNDS, stats: Stats | None = None) -> Vector:
    """Depths along edges i -> j: 1 at the source, 0 where it can't be reached; every index has an entry."""
    _source(A, source)
    edges, few = _edges(A.df, "bfs", stats is None and max_rounds == MAX_ROUNDS)
    one = A.df.sparkSession.range(1).select(F.lit(source).cast("long").alias("i"))
    found = small.levels(edges, [source]) if few else _levels(edges, one, max_rounds, stats)
    return Vector(found.select("i", F.col("d").alias("v")), A.nrows).to_dense(0)


def diameter(A: Matrix, first: int, stop: int) -> tuple[int, int]:
    """(largest eccentricity, the last source that has it) over sources in [first, stop); unreachable vertices don't count."""
    row = diameter_df(A, first, stop).first()
    return row["ecc"], row["src"]


def diameter_df(A: Matrix, first: int, stop: int) -> DataFrame:
    """One row (ecc, src)."""
    _source(A, first)
    if stop <= first:
        raise InvalidValue("no sources")
    spark = A.df.sparkSession
    stop = min(stop, A.nrows)
    edges, few = _edges(A.df, "diameter", stop - first <= small.SOURCES)
    found = small.levels(edges, range(first, stop)) if few else _levels(edges, spark.range(first, stop).withColumnRenamed("id", "i"), MAX_ROUNDS, None)
    ecc = found.groupBy("src").agg((F.max("d") - 1).alias("ecc"))
    return ecc.agg(F.max(F.struct("ecc", "src")).alias("x")).select("x.ecc", "x.src")


def sssp(A: Matrix, source: int, max_rounds: int = MAX_ROUNDS, stats: Stats | None = None, dense: bool = True) -> Vector:
    """Least sums of weights from the source. Unreachable: the largest 32-bit float if dense, else no entry.

    A round relaxes the edges of the vertices that the round before has improved.
    Weights must not form negative cycles.
    """
    _source(A, source)
    spark = A.df.sparkSession
    edges, few = _edges(A.df, "sssp", stats is None and max_rounds == MAX_ROUNDS)
    kind = dict(A.df.dtypes)["v"]
    start = spark.range(1).select(F.lit(source).cast("long").alias("i"), F.lit(0).cast(kind).alias("d"), F.lit(True).alias("fresh"))

    def step(state: DataFrame, k: int) -> DataFrame:
        near = state.where("fresh").join(edges, "i").groupBy(F.col("j").alias("i")).agg(F.min(F.col("d") + F.col("v")).alias("c"))
        both = state.select("i", "d").join(near, "i", "full_outer")
        better = F.col("c").isNotNull() & (F.col("d").isNull() | (F.col("c") < F.col("d")))
        return both.select("i", F.when(better, F.col("c")).otherwise(F.col("d")).alias("d"), better.alias("fresh"))

    found = small.costs(edges, source, max_rounds) if few else iterate(start, step, lambda m: not m["fresh"], "sssp", max_rounds, {"fresh": F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0))}, stats)
    out = Vector(found.select("i", F.col("d").alias("v")), A.nrows)
    return Vector(out.df.withColumn("v", F.col("v").cast("double")), A.nrows).to_dense(INFINITY) if dense else out


def pagerank(A: Matrix, alpha: float = 0.85, eps: float = 1e-8, max_rounds: int = MAX_ROUNDS, stats: Stats | None = None) -> Vector:
    """p' = alpha * (sum of p over in-edges, each divided by the out-degree) + (1 - alpha) / n, from 1/n.

    Stops when the Euclidean norm of the change is at most eps. What vertices without
    out-edges hold is not handed on. Edges count alike, whatever their values.
    """
    _square(A)
    spark, n = A.df.sparkSession, A.nrows
    degree = A.df.groupBy("i").agg(F.count("*").alias("deg"))
    edges = bucketed(A.df.select("i", "j").join(degree, "i").select("i", "j", (F.lit(alpha) / F.col("deg")).alias("w")), "i", "pagerank")
    every = spark.range(n).withColumnRenamed("id", "i")
    start = every.select("i", F.lit(1.0 / n).alias("p"), F.lit(0.0).alias("change"))

    def step(state: DataFrame, k: int) -> DataFrame:
        got = state.join(edges, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("p") * F.col("w")).alias("got"))
        both = state.select("i", F.col("p").alias("old")).join(got, "i", "left")
        p = F.coalesce("got", F.lit(0.0)) + F.lit((1 - alpha) / n)
        return both.select("i", p.alias("p"), (p - F.col("old")).alias("change"))

    out = iterate(start, step, lambda m: m["sq"] ** 0.5 <= eps, "pagerank", max_rounds, {"sq": F.coalesce(F.sum(F.col("change") * F.col("change")), F.lit(0.0))}, stats)
    return Vector(out.select("i", F.col("p").alias("v")), n, True)


def symmetric(A: Matrix) -> Matrix:
    """Both directions of every edge, once; self-loops are dropped."""
    _square(A)
    both = A.df.select("i", "j").unionByName(A.df.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()
    return Matrix(both.withColumn("v", F.lit(1).cast("long")), A.nrows, A.ncols)


def connected_components(A: Matrix, max_rounds: int = MAX_ROUNDS, stats: Stats | None = None) -> Vector:
    """For each vertex the smallest index in its component; directions don't count.

    A round takes the least label among neighbours, then the label of that label
    (pointer jumping), so rounds grow with the logarithm of long paths.
    """
    spark = A.df.sparkSession
    edges, few = _edges(symmetric(A).df.select("i", "j"), "components", stats is None and max_rounds == MAX_ROUNDS)
    if few:
        every = spark.range(A.nrows).withColumnRenamed("id", "i")
        return Vector(every.join(small.labels(edges), "i", "left").select("i", F.coalesce("l", "i").alias("v")), A.nrows, True)
    start = spark.range(A.nrows).select(F.col("id").alias("i"), F.col("id").alias("l"), F.lit(True).alias("moved"))

    def step(state: DataFrame, k: int) -> DataFrame:
        near = state.select("i", "l").join(edges, "i").groupBy(F.col("j").alias("i")).agg(F.min("l").alias("m"))
        own = state.select("i", F.col("l").alias("old")).join(near, "i", "left").select("i", "old", F.least("old", "m").alias("l"))
        jump = own.select(F.col("i").alias("l"), F.col("l").alias("ll"))
        return own.join(jump, "l").select("i", F.least("l", "ll").alias("l"), (F.least("l", "ll") < F.col("old")).alias("moved"))

    out = iterate(start, step, lambda m: not m["moved"], "components", max_rounds, {"moved": F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0))}, stats)
    return Vector(out.select("i", F.col("l").alias("v")), A.nrows, True)


def triangle_count_df(A: Matrix) -> DataFrame:
    """One row (v): triangles of an undirected graph given in both directions, by the masked product L<L> = L Lt.

    L has each edge once, from the end with fewer neighbours to the one with more, by index if they have as many. So no
    row of L has more than the square root of twice the edges, whatever the hubs.
    """
    _square(A)
    e = A.df.where("i <> j").select("i", "j")
    degree = e.groupBy("i").agg(F.count("*").alias("d"))
    ends = e.where("i < j").join(degree, "i").withColumnRenamed("d", "di").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    up = F.col("di") <= F.col("dj")
    L, _ = cut(ends.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("j"), F.lit(1).cast("long").alias("v")), "oriented")
    L = Matrix(L, A.nrows, A.ncols)
    closed = mxm(L, L.T, SEMIRING["plus_times"], mask=L, keep_pattern=False)
    return reduce_df(closed, MONOID["plus"])


def triangle_count(A: Matrix) -> int:
    return triangle_count_df(A).first()[0]


def _winners(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, w) of the candidates that beat all candidate neighbours; ties go to the larger index."""
    best = candidates.join(edges, "i").select(F.col("j").alias("i"), F.struct("w", F.col("i").alias("at")).alias("x")).groupBy("i").agg(F.max("x").alias("x"))
    mine = F.struct(F.col("w"), F.col("i").alias("at"))
    return candidates.join(best, "i", "left").where(F.col("x").isNull() | (mine > F.col("x"))).select("i", "w")


def _independent(spark: SparkSession, candidates: DataFrame, edges: DataFrame, stats: Stats | None = None) -> DataFrame:
    """(i) of a maximal independent set among candidates (i, w), by Luby's rounds."""
    start = candidates.select("i", "w", F.lit(0).alias("state"))  # 0 open, 1 in, 2 out

    def step(state: DataFrame, k: int) -> DataFrame:
        open_ = state.where("state = 0")
        won = _winners(open_.select("i", "w"), edges).select("i")
        beside = won.join(edges, "i").select(F.col("j").alias("i")).distinct()
        marks = won.select("i", F.lit(1).alias("m")).unionByName(beside.select("i", F.lit(2).alias("m"))).groupBy("i").agg(F.min("m").alias("m"))
        return state.join(marks, "i", "left").select("i", "w", F.when(F.col("state") == 0, F.coalesce("m", F.lit(0))).otherwise(F.col("state")).alias("state"))

    out = iterate(start, step, lambda m: not m["open"], "independent", MAX_ROUNDS, {"open": F.coalesce(F.sum((F.col("state") == 0).cast("long")), F.lit(0))}, stats)
    return out.where("state = 1").select("i")


def maximal_independent_set(A: Matrix, seed: int = 0, stats: Stats | None = None) -> Vector:
    """1 for the vertices of a maximal independent set, 0 for the others. Weights are hashes, so reruns agree."""
    spark = A.df.sparkSession
    edges = bucketed(symmetric(A).df.select("i", "j"), "i", "independent")
    every = spark.range(A.nrows).withColumnRenamed("id", "i").withColumn("w", hash_weight(seed)(F.col("i")))
    return Vector(_independent(spark, every, edges, stats).withColumn("v", F.lit(1).cast("long")), A.nrows).to_dense(0)


def color_independent(A: Matrix, seed: int = 0, max_colors: int = MAX_ROUNDS) -> Vector:
    """One Luby round per color: winners of round k get color k. 0 only if max_colors is too few."""
    spark = A.df.sparkSession
    edges = bucketed(symmetric(A).df.select("i", "j"), "i", "coloring")
    start = spark.range(A.nrows).withColumnRenamed("id", "i").withColumn("w", hash_weight(seed)(F.col("i"))).withColumn("c", F.lit(0).cast("long"))

    def step(state: DataFrame, k: int) -> DataFrame:
        won = _winners(state.where("c = 0").select("i", "w"), edges).select("i", F.lit(k).cast("long").alias("won"))
        return state.join(won, "i", "left").select("i", "w", F.when(F.col("c") == 0, F.coalesce("won", F.lit(0))).otherwise(F.col("c")).cast("long").alias("c"))

    out = iterate(start, step, lambda m: not m["open"], "coloring", max_colors, {"open": F.coalesce(F.sum((F.col("c") == 0).cast("long")), F.lit(0))})
    return Vector(out.select("i", F.col("c").alias("v")), A.nrows, True)


def color_mis(A: Matrix, seed: int = 0, max_colors: int = MAX_ROUNDS) -> Vector:
    """Color k is the k-th maximal independent set of what is left."""
    spark = A.df.sparkSession
    edges = bucketed(symmetric(A).df.select("i", "j"), "i", "coloring")
    start = spark.range(A.nrows).withColumnRenamed("id", "i").withColumn("w", hash_weight(seed)(F.col("i"))).withColumn("c", F.lit(0).cast("long"))

    def step(state: DataFrame, k: int) -> DataFrame:
        chosen = _independent(spark, state.where("c = 0").select("i", "w"), edges).select("i", F.lit(k).cast("long").alias("won"))
        return state.join(chosen, "i", "left").select("i", "w", F.coalesce(F.when(F.col("c") == 0, F.col("won")), F.col("c")).alias("c"))

    out = iterate(start, step, lambda m: not m["open"], "coloring", max_colors, {"open": F.coalesce(F.sum((F.col("c") == 0).cast("long")), F.lit(0))})
    return Vector(out.select("i", F.col("c").alias("v")), A.nrows, True)


def color_jones_plassmann(A: Matrix, seed: int = 0, max_colors: int = MAX_ROUNDS, per_round: bool = False) -> Vector:
    """Winners of a round take the least color that no neighbour has; with per_round the whole round takes one color, the least that no neighbour of any winner has."""
    spark = A.df.sparkSession
    edges = bucketed(symmetric(A).df.select("i", "j"), "i", "coloring")
    start = spark.range(A.nrows).withColumnRenamed("id", "i").withColumn("w", hash_weight(seed)(F.col("i"))).withColumn("c", F.lit(0).cast("long"))

    def step(state: DataFrame, k: int) -> DataFrame:
        won = _winners(state.where("c = 0").select("i", "w"), edges).select("i")
        used = won.join(edges, "i").join(state.where("c > 0").select(F.col("i").alias("j"), "c"), "j").select("i", "c").distinct()
        if per_round:
            used = used.select(F.lit(0).alias("g"), "c").distinct()
            # ranked colors equal their rank up to the first gap; there is a row per color
            free = used.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("c"))).where("c = r").agg(F.coalesce(F.max("c"), F.lit(0)) + 1)
            fresh = won.withColumn("won", free.scalar().cast("long"))
        else:
            ranked = used.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("c"))).where("c = r")
            fresh = won.join(ranked.groupBy("i").agg(F.max("c").alias("m")), "i", "left").select("i", (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("won"))
        return state.join(fresh, "i", "left").select("i", "w", F.when(F.col("c") == 0, F.coalesce("won", F.lit(0))).otherwise(F.col("c")).cast("long").alias("c"))

    out = iterate(start, step, lambda m: not m["open"], "coloring", max_colors, {"open": F.coalesce(F.sum((F.col("c") == 0).cast("long")), F.lit(0))})
    return Vector(out.select("i", F.col("c").alias("v")), A.nrows, True)


#: The name for "a proper coloring, any algorithm".
graph_color = color_jones_plassmann


def local_clustering(A: Matrix, source: int, alpha: float = 0.15, eps: float = 1e-7, rounds: int = 10, stats: Stats | None = None) -> Vector:
    """Approximate personalised PageRank by pushing residuals, exactly so many rounds; entries where it is above 0.

    In a round every vertex whose residual r is at least its degree times eps (isolated ones excepted, which have
    nobody to push to) gains alpha r, keeps (1 - alpha) r / 2 and deals the same amount to its neighbours.
    """
    _source(A, source)
    spark = A.df.sparkSession
    pairs = symmetric(A).df.select("i", "j")
    degree = pairs.groupBy("i").agg(F.count("*").alias("deg"))
    edges = bucketed(pairs.join(degree, "i"), "i", "clustering")
    start = spark.range(1).select(F.lit(source).cast("long").alias("i"), F.lit(0.0).alias("p"), F.lit(1.0).alias("r"))
    deg = bucketed(degree, "i", "degrees")

    def step(state: DataFrame, k: int) -> DataFrame:
        s = state.join(deg, "i", "left")
        # the source is pushed in the first round whatever its degree
        active = F.col("deg").isNotNull() & ((F.col("r") >= F.col("deg") * eps) | F.lit(k == 1))
        s = s.select("i", "p", "r", active.alias("on"))
        pushed = s.where("on").join(edges, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.lit((1 - alpha) / 2) * F.col("r") / F.col("deg")).alias("got"))
        kept = s.select("i", F.when(F.col("on"), F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(F.col("on"), (1 - alpha) / 2 * F.col("r")).otherwise(F.col("r")).alias("keep"))
        both = kept.join(pushed, "i", "full_outer")
        return both.select("i", F.coalesce("p", F.lit(0.0)).alias("p"), (F.coalesce("keep", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("r"))

    out = iterate(start, step, lambda m: False, "clustering", rounds, stats=stats)
    return Vector(out.where("p > 0").select("i", F.col("p").alias("v")), A.nrows)
