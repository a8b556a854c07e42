"""What op10 does for a string, a chunk and a bucket must not grow with what is unlike any other (F2)."""

import random

import brute
import numpy as np
import pytest
from test_substrings import EDGES, by_hand, frame, repetitive, rows10

from lattica.llm import chunks, suffix_dedup
from lattica.llm.chunks import covered
from lattica.llm.run_index import RunIndex


def near_copies(seed, n=24):
    """Texts of random letters that share passages, some shorter than a string, one of them periodic."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    passages, short, long = [word(400) for _ in range(4)], word(40), "xyz " * 700
    return [(i, word(200) + r.choice(passages)[: r.randint(60, 400)] + word(30) + short + word(30) + (long if i % 6 == 0 else "")) for i in range(n)]


def test_index_holds_what_comes_twice_only(monkeypatch):
    docs, seen = near_copies(1), []

    class Seen(RunIndex):
        def __init__(self, text, sizes, ids, width):
            seen.extend(bytes(x) for x in np.split(text, np.cumsum(sizes)[:-1]))
            super().__init__(text, sizes, ids, width)

    monkeypatch.setattr(suffix_dedup, "RunIndex", Seen)
    got, _ = by_hand(docs, 50, 5, 2)
    assert got == [(d, removed) for d, _, removed, _, _ in brute.without_matches(docs)]
    texts = [t.encode() for _, t in docs]
    times = lambda s: sum(t.startswith(s, i) for t in texts for i in range(len(t) - 49))
    strings = {x[i : i + 50] for x in seen for i in range(len(x) - 49)}
    assert strings and all(len(x) >= 50 for x in seen)
    assert all(times(s) > 1 for s in strings)
    assert max(map(len, seen)) < suffix_dedup.RUN + 50  # a step for each symbol of the longest


@pytest.mark.parametrize("run", [1, 7, 10_000])
@pytest.mark.parametrize("docs", [near_copies(2), [*repetitive(6, 30), *EDGES]], ids=["near", "edges"])
def test_cut_runs_give_the_same(monkeypatch, run, docs):
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    assert by_hand(docs, 50, 6, 3)[0] == [(d, removed) for d, _, removed, _, _ in brute.without_matches(docs)]


def test_buckets_share_rows(spark, monkeypatch):
    docs, rows = [*repetitive(7, 40), *EDGES], []
    monkeypatch.setattr(suffix_dedup, "BUCKET", 512)  # many buckets
    monkeypatch.setattr(chunks, "GROUPS", 2)

    def ask(*args):
        rows.append((out := asked(*args)).count())
        return out

    asked = suffix_dedup.ask
    monkeypatch.setattr(suffix_dedup, "ask", ask)
    assert rows10(suffix_dedup.drop_matches(frame(spark, docs))) == sorted(brute.without_matches(docs), key=repr)
    parts = suffix_dedup.write_chunks(frame(spark, docs))
    buckets, n = chunks.bucket_count(parts, 512), parts.count()
    assert buckets > 100
    assert rows[0] <= n * -(-buckets // chunks.TOGETHER)
    assert rows[1] <= n * -(-2 * buckets // chunks.TOGETHER)


@pytest.mark.parametrize("buckets", [1, 127, 128, 1224, 10**6])
def test_few_buckets_stay_apart(buckets):
    assert chunks.together(buckets) == max(1, min(chunks.TOGETHER, buckets // chunks.GROUPS))
    x = [(3, b""), (0, b"abc"), (buckets, b"\x00" * 9)]
    assert chunks.unpack(chunks.pack(x)) == x and chunks.unpack(chunks.pack([])) == []


@pytest.mark.parametrize("gram,span", [(1, 1), (3, 2), (8, 1), (9, 5), (24, 27), (50, 1), (16, 16)])
def test_least_hashes(monkeypatch, gram, span):
    r = random.Random(gram)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(700)), np.uint8)
    whole = suffix_dedup.least_hashes(data, gram)
    by_gram = {}
    for i, h in enumerate(whole.tolist()):
        assert by_gram.setdefault(bytes(data[i : i + gram]), h) == h
    assert len(set(by_gram.values())) == len(by_gram)
    want = [whole[i : i + span].min() for i in range(len(whole) - span + 1)]
    for block in (1 << 15, 64, 7):  # smaller than span, too
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert suffix_dedup.least_hashes(data, gram, span).tolist() == want
    assert len(suffix_dedup.least_hashes(data[: gram + span - 2], gram, span)) == 0


@pytest.mark.parametrize("width", [1, 2, 50])
def test_spans(width):
    r = random.Random(width)
    for n in (0, 1, 60, 400):
        places = [i for i in range(n - width + 1) if r.random() < 0.03]
        r.shuffle(places)
        at = np.array(places, np.int64)
        gone = np.concatenate([[False], covered(at, width, n), [False]]).astype(np.int8)
        starts, stops = suffix_dedup.spans(at, width, n)
        assert starts.tolist() == np.flatnonzero(np.diff(gone) == 1).tolist()
        assert stops.tolist() == np.flatnonzero(np.diff(gone) == -1).tolist()


@pytest.mark.parametrize("width", [1, 5, 8, 24, 30])
def test_other_widths(width):
    docs = [(i, "".join(random.Random(i % 9).choices("abc", k=80)) + str(i) * (i % 3)) for i in range(20)]
    got, _ = by_hand(docs, width, 4, 2)
    seen, want = set(), []
    for d, t in docs:
        own = [t[i : i + width] for i in range(len(t) - width + 1)]
        gone = {j for i, s in enumerate(own) if s in seen for j in range(i, i + width)}
        want.append((d, len(gone)))
        seen.update(own)
    assert got == want
