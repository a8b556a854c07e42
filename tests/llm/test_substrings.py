"""Repeated word windows (op9) and byte strings of earlier documents (op10), against plain versions."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import recompress, suffix_dedup
from lattica.llm.chunks import Chunk, solve_shared
from lattica.llm.run_index import RunIndex
from lattica.llm.suffix_dedup import Segments, Shared, send_anchors, solve_anchors, solve_least

SCHEMA = "doc_id long, text string, chunk string, bucket int, blob string, n_removed long"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, None, -1) for d, t in docs], SCHEMA)


def repetitive(seed, n=60, vocabulary=40):
    """Documents of shared passages, own words, copies, near copies and odd characters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 7))).strip() or "x"
    vocab = [word() for _ in range(vocabulary)]
    passages = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 90))) for _ in range(6)]
    docs = []
    for i in range(n):
        kind = r.random()
        if docs and kind < 0.2:
            text = r.choice(docs)[1]
        elif docs and kind < 0.35:
            w = (r.choice(docs)[1] or "").split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))]
            parts += [r.choice(passages) for _ in range(r.randint(0, 3))]
            text = r.choice([" ", "\n", "\t\t", "  "]).join(parts)
        docs.append((i * 3 % (2 * n), text))
    return docs


EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a " * 60), (4, "a " * 60), (None, None),
    (5, "same words " * 30), (5, "same words " * 30), (6, "é" * 70), (7, "x" + "é" * 70), (8, "z" * 9000), (9, "z" * 30_000),
    (10, "\x00\x01 " * 80), (11, "\x00\x01 " * 80), (12, "w w w " * 40), (13, "w w w " * 40), (-4, "q" * 49), (-5, "q" * 50), (14, "q" * 51),
]


def rows9(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def rows10(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("docs", [repetitive(1), EDGES, []], ids=["repetitive", "edges", "empty"])
def test_windows_of_words(spark, docs):
    assert rows9(recompress.drop_repeats(frame(spark, docs))) == sorted(brute.without_repeats(docs), key=repr)


@pytest.mark.parametrize("docs", [repetitive(2), EDGES, []], ids=["repetitive", "edges", "empty"])
def test_strings_of_earlier_documents(spark, docs):
    assert rows10(suffix_dedup.drop_matches(frame(spark, docs))) == sorted(brute.without_matches(docs), key=repr)


def test_kept_text_and_spans(spark):
    docs = repetitive(3, 30)
    texts = dict(docs)
    if len(texts) == len(docs):
        for r in suffix_dedup.drop_matches(frame(spark, docs)).collect():
            raw = (texts[r.doc_id] or "").encode()
            cut = set(i for s in r.spans for i in range(s.start, s.stop))
            assert bytes(r.kept) == bytes(x for i, x in enumerate(raw) if i not in cut)


def test_op9_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows9(recompress.op9_recompress(spark, small)) == sorted(brute.without_repeats(docs), key=repr)


def test_op10_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = suffix_dedup.op10_suffix_dedup(spark, small)
    assert rows10(got) == sorted(brute.without_matches(docs), key=repr)
    assert sum(r.n_removed for r in got.collect()) > 0


def by_hand(docs, width, per_chunk, buckets):
    """The rounds of drop_matches without Spark: {row: removed bytes}."""
    chunks = [Chunk(Chunk.pack([d for d, _ in docs[i : i + per_chunk]], [(t or "").encode() for _, t in docs[i : i + per_chunk]])) for i in range(0, len(docs), per_chunk)]

    def ask(emit, solve):
        sent = defaultdict(list)
        for c, chunk in enumerate(chunks):
            for b, blob in emit(c, chunk):
                sent[b].append((c, blob))
        got = [{} for _ in chunks]
        for b, rows in sent.items():
            for (c, _), answer in zip(rows, solve([x for _, x in rows]), strict=True):
                got[c][b] = answer
        return got, sent

    def anchors(c, chunk):
        keys, _, counts, several = Segments(chunk, width).keys()
        return send_anchors(keys, counts, several, buckets)

    first, _ = ask(anchors, solve_anchors)
    second, sent = ask(lambda c, chunk: Shared(chunk, width, first[c], buckets).send(chunk.data, buckets), lambda b: solve_least(width, b))
    out = []
    for c, chunk in enumerate(chunks):
        at, doc, least = Shared(chunk, width, first[c], buckets).receive(second[c], buckets)
        gone = np.zeros(len(chunk.data), bool)
        for a in at[least < chunk.ids[doc]]:
            gone[a : a + width] = True
        out += [(chunk.id_list()[k], int(gone[s:e].sum())) for k, (s, e) in enumerate(zip(chunk.start, chunk.end, strict=True))]
    return out, any(b >= buckets for b in sent)


@pytest.mark.parametrize("hot", [1, 3, 30, 10_000])
def test_hot_anchors_give_the_same(monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 16)
    docs = [*repetitive(4, 40), *EDGES]
    got, was_hot = by_hand(docs, 50, 7, 3)
    assert got == [(d, removed) for d, _, removed, _, _ in brute.without_matches(docs)]
    assert was_hot == (hot < 10_000)


@pytest.mark.parametrize("width", [4, 9, 20, 50])
def test_run_index(width):
    r = random.Random(width)
    base = ["".join(r.choice("ab\x00é") for _ in range(r.randint(5, 80))).encode() for _ in range(12)]
    texts = [r.choice(base) + r.choice(base) for _ in range(40)]
    docs = np.array([r.randrange(100) for _ in texts])
    text, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    index = RunIndex(text, sizes, docs, width)
    out, at = index.stream(text, sizes), 0
    for t in texts:
        for i in range(len(t)):
            s = t[i : i + width]
            want = min(d for d, x in zip(docs, texts, strict=True) if s in x) if len(s) == width else -1
            assert out[at + i] == want
        at += len(t)
    assert len(index.runs) < 0.9 * (len(text) + len(texts))  # copies add to the length of runs only
    for p in [b"", b"ab", texts[0][:width], texts[5][3 : 3 + width // 2], b"zz", b"ba" * (width // 2)]:
        places = sum(x.startswith(p, i) for x in texts for i in range(len(x))) if p else index.start[-1]
        n, doc = index.find(p)
        assert n == places
        if places and p:
            assert doc == min(d for d, x in zip(docs, texts, strict=True) if p in x)


def test_recompression_names_equal_passages_alike():
    r = random.Random(5)
    passage = [f"w{r.randrange(30)}" for _ in range(80)]
    texts = [" ".join([*(f"v{r.randrange(30)}" for _ in range(20)), *passage, *(f"u{r.randrange(30)}" for _ in range(9))]) for _ in range(2)]
    words = recompress.Words(Chunk(Chunk.pack([1, 2], [t.encode() for t in texts])), 35)
    name, size, a, b = recompress.recompress(words)
    at = {int(w): k for k, w in enumerate(words.windows)}
    for i in range(80 - 35):
        one, two = at[20 + i], at[words.n // 2 + 20 + i]
        assert name[a[one] : b[one]].tolist() == name[a[two] : b[two]].tolist()
    assert size.max() >= recompress.LONG


def test_solve_shared_is_by_chunk():
    from lattica.llm.chunks import received_bits, send_keys

    keys = [np.array([1, 5, 9], np.uint64), np.array([5, 7], np.uint64)]
    again = [np.array([False, False, True]), np.array([False, False])]
    sent = [dict(send_keys(k, None, x, 1)) for k, x in zip(keys, again, strict=True)]
    answers = solve_shared([s[0] for s in sent])
    assert received_bits(keys[0], {0: answers[0]}, 1).tolist() == [False, True, True]
    assert received_bits(keys[1], {0: answers[1]}, 1).tolist() == [True, False]


def test_docs_may_have_other_types(spark):
    docs = spark.createDataFrame([(1, "a " * 40), (2, "a " * 40)], "doc_id int, text string").withColumn("TEXT2", F.lit(1))
    assert [r.n_removed for r in suffix_dedup.drop_matches(docs).orderBy("doc_id").collect()] == [0, 80]
    assert [r.n_removed for r in recompress.drop_repeats(docs).orderBy("doc_id").collect()] == [40, 40]


def thue_morse(n):
    """A word of 2^n letters and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(12)
    docs = frame(spark, [(1, " ".join([*map(str, range(34)), x])), (2, " ".join([*map(str, range(34)), y]))])
    assert [(r.doc_id, r.n_words, r.n_removed) for r in recompress.drop_repeats(docs).orderBy("doc_id").collect()] == [(1, 35, 0), (2, 35, 0)]


def test_bytes_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(12)
    docs = [(1, x + "c" * 30), (2, y + "d" * 30), (3, "e" + x), (4, "f" * 60 + y)]
    assert rows10(suffix_dedup.drop_matches(frame(spark, docs))) == sorted(brute.without_matches(docs), key=repr)


def test_runs_become_symbols():
    words = recompress.Words(Chunk(Chunk.pack([1, 2], [b"a " * 4000, b"x " + b"b c " * 3000])), 35)
    name, size, a, b = recompress.recompress(words)
    assert len(name) < 40 and size.sum() == words.n
    assert (a <= b).all()
