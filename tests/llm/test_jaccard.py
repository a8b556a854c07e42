"""Near-duplicates of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import random

import brute
import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import jaccard, simhash
from lattica.llm.shared import table


def shingles(text):
    w = brute.words(brute.ascii_lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def gone(docs):
    """Ids that go, by all pairs of distinct shingle sets, and the number of linked pairs."""
    first = {}
    for d, t in docs:
        s = shingles(t)
        first[s] = min(d, first.get(s, d))
    sets, parent, links = list(first), {}, 0
    root = lambda s: s if parent.get(s, s) is s else root(parent[s])
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b) and (a or b):
                links += 1
                if (x := root(a)) is not (y := root(b)):
                    parent[x] = y
    least = {}
    for s, d in first.items():
        least[root(s)] = min(d, least.get(root(s), d))
    own = {s: root(s) for s in sets}
    sets = {s: s for s in sets}
    return {d for d, t in docs if d > least[own[sets[shingles(t)]]]}, links


def replaced(words, k, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def stage_gone(spark, docs, small):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.one_of_each_group(spark, df, small)
    assert kept.columns == df.columns
    return {d for d, _ in docs} - {r.doc_id for r in kept.select("doc_id").collect()}


def test_one_word_replaced(spark, small):
    rng = random.Random(7)
    docs = []
    for i in range(200):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 150))]
        docs += [(i, " ".join(w)), (1000 + i, replaced(w, 1, rng))]
    want, links = gone(docs)
    assert links >= 190
    assert stage_gone(spark, docs, small) == want


@pytest.mark.parametrize("side", [jaccard.SIDE, 16])
def test_large_group(spark, small, side, monkeypatch):
    """Copies of one text, some nearer to one another than to the first; buckets dealt out in parts and blocks."""
    monkeypatch.setattr(jaccard, "SIDE", side)
    monkeypatch.setattr(jaccard, "STAR", side // 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base), None, "", " \t", "a b", "A b"]
    for k in (1, 2, 3, 4, 5, 6, 9):
        for _ in range(10):
            w = replaced(base, k, rng)
            texts += [w, replaced(w.split(), 1, rng)]
    docs = list(enumerate(texts))
    want, links = gone(docs)
    assert links > 50 and stage_gone(spark, docs, small) == want


def test_tables(spark, medium):
    docs = [(r.doc_id, r.text) for r in table(spark, medium, "documents").collect()]
    want, links = gone(docs)
    assert links == 5
    assert stage_gone(spark, docs, medium) == want


def test_recall_of_bands():
    """Pairs of similarity 0.8 agree in as many rows as MinHash says, 0.8^5 of their bands, and always in one."""
    rng, shared, met = np.random.default_rng(9), [], 0
    for _ in range(300):
        h = rng.integers(0, 1 << 64, 100, np.uint64)
        same = jaccard.bands(jaccard.minima(h[:90])) == jaccard.bands(jaccard.minima(h[10:]))  # 80 of 100
        shared.append(same.mean())
        met += same.any()
    assert met == 300 and abs(np.mean(shared) - 0.8**5) < 0.02


def test_sketches_agree_as_their_rows_do(spark):
    rng, pairs, want = np.random.default_rng(10), [], []
    for k in range(0, 201, 5):
        h = rng.integers(0, 1 << 64, 400, np.uint64)
        one, two = jaccard.sketch(h[:200]), jaccard.sketch(h[k : 200 + k])
        pairs.append((one.tolist(), two.tolist()))
        a, b = one.view(np.uint8), two.view(np.uint8)
        want.append(int((a & 15 == b & 15).sum() + (a >> 4 == b >> 4).sum()))
        s = (200 - k) / (200 + k)
        assert abs(want[-1] / jaccard.SKETCH - (s + (1 - s) / 16)) < 0.09
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    assert [r[0] for r in df.select(jaccard.agreeing(F.col("a"), F.col("b"))).collect()] == want


def test_recall_of_sketches():
    """Of pairs of similarity 0.8 hardly one has fewer rows in common than it takes to be verified."""
    rng, agree = np.random.default_rng(11), []
    for n in (50, 500):
        for _ in range(500):
            h = rng.integers(0, 1 << 64, 2 * n, np.uint64)
            a, b = (jaccard.sketch(x).view(np.uint8) for x in (h[: 9 * n // 5], h[n // 5 :]))
            agree.append((a & 15 == b & 15).sum() + (a >> 4 == b >> 4).sum())
    assert sum(x < jaccard.AGREE for x in agree) <= 1 and abs(np.mean(agree) - 0.8125 * jaccard.SKETCH) < 1


def test_fingerprints_are_simhash():
    for text in (None, "", " \t", "a b", "A b c d e", "x y z " * 400, "w" + " é ü" * 40_000):
        own, fp = jaccard.set_and_fingerprint(text)
        assert fp == simhash.fingerprint(text, 5, 0) and (own == jaccard.shingles(text)).all()


def test_balls(spark):
    """Components of the pairs that balls give are those of all pairs at 2 bits or fewer, and no pair is further apart."""
    rng, fps = random.Random(12), []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps += [x, x, x ^ 1 << rng.randrange(64), x ^ (1 << rng.randrange(32) | 1 << rng.randrange(32, 64)), x ^ 0b1011 << rng.randrange(60)]
    reps = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(fps)], "rep long, fp long")
    near = [(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2]
    got = [tuple(r) for r in jaccard.ball_pairs(reps).collect()]
    assert set(got) <= set(near)
    assert components_of(got) == components_of(near)


def components_of(pairs):
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_stage_links_by_simhash(spark, small, monkeypatch):
    """With no two sets in one band, the stage still drops near copies whose fingerprints are within 2 bits, and only near copies."""
    signatures = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda *a: signatures(*a).withColumn("bands", F.expr("transform(bands, (x, i) -> xxhash64(doc_id, i))")))
    rng, docs = random.Random(13), []
    for i in range(80):
        w = [f"w{rng.randrange(5000)}" for _ in range(400)]
        docs += [(i, " ".join(w)), (1000 + i, replaced(w, 1, rng))]
    near = {1000 + i for i in range(80) if (simhash.fingerprint(docs[2 * i][1], 5, 0) ^ simhash.fingerprint(docs[2 * i + 1][1], 5, 0)).bit_count() <= 2}
    assert len(near) > 20 and stage_gone(spark, docs, small) == near
