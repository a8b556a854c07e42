"""The other operators against plain versions, SQL, round trips and held-out accuracy."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from lattica.llm import components, decontaminate, exact_dedup, mixing, registry, secrets, shared, simhash, sst, toxicity, warc
from lattica.llm.shared import fresh, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gone_id long, bad_id long, copies long, bound long, fp long, h long, w string, rep long"


def frame(spark, docs, source="s"):
    return spark.createDataFrame([(d, t, None, source, 1, 0.5, 1, 2, 3, 4, 5, 6, "w", 7) for d, t in docs], SCHEMA)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def oracle(sf, sql, **tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables.get(t) or f'{sf}/{t}.parquet'}')")
    return con.sql(sql)


EDGES = [(1, None), (2, ""), (3, " \t\n\x0b "), (None, None), (None, "alpha beta gamma delta"), (4, "alpha beta gamma delta"), (4, "alpha beta gamma delta"), (5, "Alpha BETA gamma delta"), (6, "x " * 60_000), (-7, "ÄÖ straße İ ſecret=abcdefgh"), (8, "\x00\x01"), (9, "one"), (10, "one")]


# 1 secrets


def test_base_spans(spark, small):
    docs = [*documents(spark, small), *EDGES]
    docs += [(100, "x PASSWORD = 'hunter2hunter' api-key: AKIA" + "Q" * 16 + " api_key=abc"), (101, "deadbeef" * 4 + "G" + "0" * 23), (102, "token:secret=abcdef123 secretsecret: 'zzzzzz"), (103, "AKIAAKIA" + "B" * 20 + "=" + "a" * 24)]
    got = defaultdict(list)
    for r in secrets.find_secrets(frame(spark, docs)).collect():
        base = [(x.start, secrets.KINDS[x.kind], x.stop) for x in r.spans if x.kind < 3]
        assert base == [(x.start, secrets.KINDS[x.kind], x.stop) for x in r.base]
        got[r.doc_id].append(base)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(brute.base_spans(t))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}


def test_op1_whole_table(spark, small):
    texts = dict(documents(spark, small))
    out = secrets.op1_secrets(spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == __import__("hashlib").sha256(brute.spans_text(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in ("assign", "access", "hex"))
        assert set(brute.spans_text(spans).split(",")) - {""} <= set(r.spans.split(","))


def test_random_strings_stand_out(spark):
    r = random.Random(3)
    hidden = ["".join(r.choice(secrets.ENCODINGS[e]) for _ in range(n)) for e in ("base64", "base62", "base36") for n in (24, 32, 40, 64) for _ in range(40)]
    plain = ["version20240101release", "aaaaaaaaaaaaaaaaaaaa1111111111", "abcdefghijklmnopqrstuvwxyz0123456789", "ThisIsAVeryLongIdentifierName2", "user1user2user3user4user5"] * 30
    docs = [(i, f"see {s} there") for i, s in enumerate(hidden + plain)]
    found = {x.doc_id for x in secrets.find_secrets(frame(spark, docs)).collect() if x.spans}
    real = {i for i, s in enumerate(hidden) if secrets.encoding_of(s)}
    assert len(found & real) > 0.8 * len(real)
    assert len(found - set(range(len(hidden)))) <= 0.1 * len(found)


def test_battery_is_uniform_for_random_strings():
    r = random.Random(4)
    for name, n in (("base64", 32), ("base62", 48), ("hex", 40)):
        p = [secrets.battery_p("".join(r.choice(secrets.ENCODINGS[name]) for _ in range(n)), name) for _ in range(800)]
        for q in (0.1, 0.3, 0.5, 0.8):
            assert abs(sum(x < q for x in p) / len(p) - q) < 0.09


def reported(sizes, q=0.1, seed=0):
    """{class: (share of text in what is reported, share of random strings reported)} for classes of so many random strings and runs of text."""
    r, counts, items = random.Random(seed), defaultdict(lambda: [0] * (len(secrets.BINS) - 1)), defaultdict(list)
    for key, numbers in sizes.items():
        for is_text, n in enumerate(numbers):
            for _ in range(n):
                p = 10 ** -r.uniform(0.3, 14) if is_text else r.random()
                counts[key][min(bisect.bisect_right(secrets.BINS, p), len(secrets.BINS) - 1) - 1] += 1
                items[key].append((p, is_text))
    bounds = secrets.thresholds(dict(counts), q)
    hits = {k: [t for p, t in x if p >= bounds[k]] for k, x in items.items()}
    return {k: (sum(x) / max(1, len(x)), x.count(0) / max(1, sizes[k][0])) for k, x in hits.items()}


@pytest.mark.parametrize(("sizes", "power"), [({("hex", 0): (1, 1)}, 0.3), ({("hex", 0): (0, 2)}, 0), ({("hex", 2): (3, 30)}, 0.2), ({("hex", 0): (500, 500)}, 0.8), ({("hex", 0): (500, 500), ("base62", 0): (1, 1), ("base64", 3): (20, 0)}, 0.4), ({("hex", 0): (5, 500)}, 0)])
def test_false_discoveries_of_sparse_and_dense_classes(sizes, power):
    trials = [reported(sizes, seed=k) for k in range(60 if sum(map(sum, sizes.values())) < 100 else 15)]
    for key in sizes:
        assert sum(t[key][0] for t in trials) / len(trials) <= 0.12
        assert sum(t[key][1] for t in trials) / len(trials) >= power * (sizes[key][0] > 0)


def test_no_report_without_evidence():
    one = [0] * (len(secrets.BINS) - 1)
    for p, n in ((1e-5, 1), (0.003, 2)):
        counts = one.copy()
        counts[bisect.bisect_right(secrets.BINS, p) - 1] = n
        assert secrets.thresholds({("base62", 1): counts}, 0.1)["base62", 1] > p


# 2 shards


def test_tokens_and_lookup(spark, small, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(sst.tokenizer_path("byte_bpe_50k.json"))
    docs = [*documents(spark, small), (-3, "<|endoftext|> a"), (-2, None), (-1, "中文  ²½ x\n\n y" * 40), (10**12, "z" * 50_000)]
    manifest = sst.write_shards(frame(spark, docs), str(tmp_path / "shards"), shard_bytes=1 << 14)
    assert rows(sst.read_shards(manifest)) == sorted(brute.token_rows(docs, tok), key=repr)
    readers = [sst.ShardReader.open(u.uri) for u in manifest.orderBy("part", "seq").collect()]
    assert len(readers) > 3
    for d, t in docs[::7] + docs[-4:]:
        found = [x for rd in readers for x in rd.get(d)]
        assert [x.tolist() for x in found] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2]]
    assert sum(rd.may_hold(sst.key_of(5_000_000 + i)) for rd in readers for i in range(300)) < 0.05 * 300 * len(readers)
    assert not [x for rd in readers for x in rd.get(77_777_777)]


def test_shards_of_odd_rows(spark, tmp_path):
    out = sst.read_shards(sst.write_shards(frame(spark, EDGES), str(tmp_path / "s"))).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in EDGES)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start) if r.doc_id is not None] == sorted(d for d, _ in EDGES if d is not None)
    assert sst.read_shards(sst.write_shards(frame(spark, []), str(tmp_path / "e"))).count() == 0


def test_shard_blocks_and_damage():
    w = sst.ShardWriter(2)
    for i in range(3000):
        w.add(sst.key_of(i * 3), bytes([i % 251, 0]) * (i % 400))
    raw = w.bytes()
    rd = sst.ShardReader(raw)
    assert len(rd.blocks) > 2 and rd.entries_n == 3000
    assert [d for d, _ in rd.entries()] == [i * 3 for i in range(3000)]
    assert rd.get(30)[0].tolist() == [10] * 10 and rd.get(31) == []
    with pytest.raises(ValueError):
        list(sst.ShardReader(raw[:20] + b"\xff" + raw[21:]).entries())
    with pytest.raises(ValueError):
        w.add(sst.key_of(1), b"")


# 3 simhash


@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprints(words):
    r = random.Random(words)
    for _ in range(60):
        text = "".join(r.choice(["Ab", "c", "é", " ", "\t", " ", "\n", "Z"]) for _ in range(r.randint(0, 40)))
        assert simhash.fingerprint(text, words) == brute.fingerprint(text, words)


def test_simhash_edges_and_links(spark):
    fps = [0, 1, 3, 7, 0x8000000000000000, 0xF000, 0xF00F, 0xF003, 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFC, 0x7FFFFFFFFFFFFFFF]
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    named = {r.node: r.component for r in components.components(simhash.simhash_links(df)).collect()}
    assert [named.get(i, i) for i in range(len(fps))] == [c for _, _, c in brute.groups(list(enumerate(fps)))]
    got = rows(simhash.simhash_components(frame(spark, EDGES)))
    assert got == sorted(brute.groups([(d, brute.fingerprint(t)) for d, t in EDGES]), key=repr)
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_op3_whole_table(spark, small):
    docs = documents(spark, small)
    assert rows(simhash.op3_simhash(spark, small)) == sorted(brute.groups([(d, brute.fingerprint(t)) for d, t in docs]), key=repr)


def test_components_of_chains(spark):
    r = random.Random(8)
    ids = list(range(400))
    r.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(300) if i % 100 != 99] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-2]:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: v for k, v in got.items() if k in parent} == {k: root(k) for k in parent}


# 4 warc


def test_warc_round_trip(spark, small, tmp_path):
    pages = [(r.page_id, r.html) for r in table(spark, small, "pages").collect()]
    pages += [(-1, None), (-2, ""), (None, "null id"), (None, "null id"), (10**15, "é" * 30_000), (10**15 + 1, "é" * 30_000), (-(2**63), "least"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(p, None if p == 5 else f"http://x.example/a b{p}", h, "x", 1) for p, h in pages], "page_id long, url string, html string, sha string, size int")
    manifest = warc.write_archives(df, str(tmp_path / "w"), file_bytes=1 << 16)
    assert rows(warc.read_archives(manifest).drop("url")) == sorted(brute.warc(pages), key=repr)
    assert manifest.count() > 2
    for m in manifest.collect():
        data = warc.read_file(m.uri)
        magic, n = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        assert magic == 0x184D2A5D and data[8 : 8 + n][:4] == b"\x37\xa4\x30\xec" or n < 1 << 15
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
        assert codec.decompressobj().decompress(data[8 + n :]).startswith(b"WARC/1.1\r\n")  # the first record alone
        assert sum(1 for _ in warc.read_records(data)) == m.records
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_op4_whole_table(spark, small):
    pages = [(r.page_id, r.html) for r in table(spark, small, "pages").collect()]
    assert rows(warc.op4_warc(spark, small)) == sorted(brute.warc(pages), key=repr)


# 5 decontamination


def test_containment_brute(spark, small):
    docs = documents(spark, small)
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    r = random.Random(1)
    docs += [(90_000 + k, " ".join(["start", *[w if r.random() > cut else "changed" for w in (items[k][1] or "").split()], "end"])) for k in range(len(items)) for cut in [k % 4 * 0.02]]
    items += [(700, "Two words"), (701, None), (702, ""), (703, "Gamma"), (None, "alpha beta"), (704, "alpha beta gamma delta"), (700, "another text of this very item id")]
    docs += [x for x in EDGES if x[0] != 4] + [(4, "alpha beta gamma delta"), (800, "two, WORDS!"), (801, "and another text of this very item id too")]
    seen = {d for d, _ in docs}
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, h string"))
    want = brute.containment(docs, items)
    found = {(x.doc_id, x.item_id): (x.n_shingles, x.n_matched) for x in got.collect()}
    assert found == want and {d for d, _ in found} <= seen and len(found) > 20
    assert all(math.isclose(x.containment, x.n_matched / x.n_shingles) for x in got.collect())
    left = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string"))
    assert left.columns == frame(spark, []).columns
    nameless = brute.containment([(i, t) for i, (d, t) in enumerate(docs) if d is None], items)  # judged by their own texts
    stay = [d for i, (d, _) in enumerate(docs) if (d is not None and d not in {a for a, _ in want}) or (d is None and i not in {a for a, _ in nameless})]
    assert nameless and Counter(x.doc_id for x in left.collect()) == Counter(stay)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, docs), empty).count() == 0
    assert decontaminate.contaminated(frame(spark, []), empty).count() == 0


def test_rows_without_ids_are_decontaminated(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(None, f"x y {item} z"), (None, "clean text of five words"), (3, item), (3, "other"), (4, None), (None, None)]
    items = spark.createDataFrame([(1, item), (2, None), (None, "clean text of five words")], "item_id long, text string")
    out = decontaminate.decontaminate(frame(spark, docs), items)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(None, "clean text of five words"), (4, None), (None, None)], key=repr)


def test_op5_plan_is_native(spark, small):
    plan = decontaminate.op5_decontaminate(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 6 toxicity


def test_automaton_against_edit_distance():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    terms = {word(r.randint(3, 9)): 0.9 for _ in range(25)}
    a = toxicity.Automaton(terms, {})
    for _ in range(1500):
        w = r.choice([word(r.randint(1, 10)), r.choice(list(terms))])
        if r.random() < 0.5 and w:
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", "x", "ab"]) + w[k + r.randint(0, 1) :]
        near = [(e, t) for t in terms if (e := brute.edit_distance(w, t)) <= toxicity.edits_for(len(t))]
        want = (min(near)[1], min(near)[0], False) if near else None
        assert a.find(w) == want, w


def test_misspellings_and_quotations():
    m = toxicity.Model(base=0.05, words={"grumblefoot": 0.98}, stems={})
    s = toxicity.Scorer(m)
    m.fuzzy = {("grumblefoot", 1): 0.95, ("grumblefoot", 2): 0.9}
    abuse, typo, clean = s.score("you are a grumblefoot and you know it"), s.score("you are a grumblef0ot and you know it"), s.score("you are kind")
    quoted = s.score('the word "grumblefoot" has an old meaning')
    assert abuse > 0.7 and typo > 0.7 and clean < 0.1 and clean < quoted < 0.7
    assert s.score(None) == s.score("") == m.base
    assert 0 <= s.score("grumblefoot " * 50_000) <= 1


def test_held_out_accuracy(spark, medium):
    labels = {r.doc_id: r.toxic for r in table(spark, medium, "labels").collect()}
    out = {r.doc_id: r for r in toxicity.op6_toxicity(spark, medium).collect()}
    assert len(out) == table(spark, medium, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in out.items())
    test = [(labels[d], r) for d, r in out.items() if r.held_out and d in labels]
    tp = sum(y and r.predicted for y, r in test)
    assert tp >= 0.7 * sum(y for y, _ in test)  # learned from some 30 toxic rows
    assert tp >= 0.8 * sum(r.predicted for _, r in test)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(frame(spark, EDGES), labels)
    assert kept.columns == frame(spark, []).columns and kept.where("score = 0.5").count() == len(EDGES)
    assert toxicity.keep_clean(frame(spark, []), labels.limit(0)).count() == 0


# 7 mixing


def mixed_frame(spark):
    r = random.Random(5)
    docs = [(i, " ".join("w" for _ in range(int(r.paretovariate(1.2) * 5))), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)]
    docs += [(5000, None, "s1"), (5001, "", None), (5002, "a b c", None), (5003, " ", "empty"), (None, "x y", "s2"), (5004, "d d", "s3"), (5004, "d d", "s3")]
    return docs, spark.createDataFrame([(d, t, None, s, 1, 0.5, 1, 2, 3, 4, 5, 6, "w", 7) for d, t, s in docs], SCHEMA)


def test_targets_and_copies(spark):
    docs, df = mixed_frame(spark)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    got = {r.source: r.target for r in mixing.source_targets(mixing.sizes(df)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)
    out = mixing.mix(df)
    assert out.columns == df.columns
    mixed = out.collect()
    assert Counter(map(repr, mixed)) == Counter(map(repr, mixing.mix(df).collect()))  # reruns agree
    original, taken = Counter((r.doc_id, r.text, r.source) for r in df.collect()), Counter()
    copies = Counter((r.doc_id, r.text, r.source) for r in mixed)
    for (d, t, s), n in copies.items():
        assert n <= 2 * original[d, t, s]
        taken[s] += n * len(brute.words(t))
    rate = {s: want[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    for (d, t, s), n in original.items():
        assert copies[d, t, s] // n in (math.floor(rate[s]), math.floor(rate[s]) + 1)
    largest = {s: max(len(brute.words(t)) for _, t, x in docs if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.07 * want[s] + largest[s]
    assert mixing.mix(df.limit(0)).count() == 0


def test_op7_sums_come_near_targets(spark, medium):
    out = mixing.op7_mixing(spark, medium).collect()
    taken, target = Counter(), {}
    for r in out:
        assert r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert abs(sum(taken.values()) - sum(target.values())) < 0.03 * sum(target.values())


def test_rows_without_ids_are_drawn_apart(spark):
    docs = [(None, "w " * 10) for _ in range(1000)] + [(7, "v " * 8)] * 500 + [(i, "u " * 5) for i in range(2000)]
    df = spark.createDataFrame([(d, t, "abc"[i % 2 if d is None else 2]) for i, (d, t) in enumerate(docs)], "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("copies", "h1", "p", "s", "salt", "doc")})
    want = {r.source: r.target for r in mixing.source_targets(mixing.sizes(df)).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in want)


def test_draws_are_uniform_and_independent(spark):
    n = 4000
    s = mixing.sizes(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source")))
    hits = s.select(*(mixing._hit(F.col("h1"), F.col("h2"), F.lit(k), F.lit(0.3)).cast("int").alias(f"x{k}") for k in (0, 1, 63)))
    found = [tuple(r) for r in hits.collect()]
    for k in range(3):
        assert abs(sum(x[k] for x in found) - 0.3 * n) < 4 * (n * 0.21) ** 0.5
        assert abs(sum(a[k] * b[k] for a, b in zip(found, found[1:], strict=False)) - 0.09 * n) < 4 * (n * 0.09) ** 0.5
    assert abs(sum(x[0] * x[1] for x in found) - 0.09 * n) < 4 * (n * 0.09) ** 0.5


# 8 exact


def test_exact_groups(spark):
    docs = [(d, t) for d, t in EDGES if d is not None] + [(20, "ALPHA beta gamma DELTA"), (21, "É"), (22, "é"), (23, "İ"), (24, "i̇")]
    got = rows(exact_dedup.DigestIndex(spark, buckets=4).ingest(frame(spark, docs)))
    assert got == sorted(brute.exact_groups(docs), key=repr)


def test_index_outlives_a_batch(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), "index_of_test", 4)
    first = index.ingest(frame(spark, [(1, "a"), (2, "A"), (3, "b"), (None, "n")]))
    assert [(r.doc_id, r.keep_id, r.kept) for r in first.where("doc_id is not null").orderBy("doc_id").collect()] == [(1, 2, False), (2, 2, True), (3, 3, True)]
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), "index_of_test", 4)
    second = again.ingest(frame(spark, [(10, "B"), (11, "c"), (12, "C")]))
    assert [(r.doc_id, r.keep_id, r.kept) for r in second.orderBy("doc_id").collect()] == [(10, 3, False), (11, 12, False), (12, 12, True)]
    assert again.read().count() == 4
    plan = again.new(spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert again.ingest(frame(spark, [])).count() == 0
    spark.sql("DROP TABLE index_of_test")


def test_a_batch_again_gives_the_same(spark, tmp_path, monkeypatch):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), "index_of_replays", 4)
    one, two = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(3, "B"), (4, "c"), (5, "d")])
    first = rows(index.ingest(one, "one"))
    assert [r[3] for r in first] == [True, True]
    assert rows(index.ingest(one, "one")) == first and index.read().count() == 2
    # lost after the result was stored, before anything was appended
    with monkeypatch.context() as m:
        m.setattr(index, "append", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.ingest(two, "two", str(tmp_path / "two"))
    stored = rows(spark.read.parquet(str(tmp_path / "two")))
    # lost in the middle of the append
    _, new = index.decide(two, "two")
    index.append(new.limit(1), "two")
    assert rows(index.ingest(two, "two", str(tmp_path / "two"))) == stored and [r[3] for r in stored] == [False, True, True]
    assert rows(index.ingest(one, "one")) == first and index.read().count() == 4
    index.compact(str(tmp_path / "compacted"))
    assert rows(index.ingest(two, "two")) == stored and index.read().count() == 4
    assert [r[3] for r in rows(index.ingest(two, "three"))] == [False, False, False]
    plan = index.state(new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # of the batch's side only


def test_index_of_many_batches_against_plain_version(spark, tmp_path):
    r = random.Random(8)
    index, known = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), "index_of_batches", 4), {}
    for batch in range(3):
        docs = [(batch * 100 + i, r.choice("abcdefghij") * r.randint(1, 3)) for i in range(30)]
        want = []
        for d, t, *_ in docs:
            same = [x for x, y in docs if y.lower() == t.lower()]
            keep = known.get(t.lower(), max(same))
            want.append((d, keep, len(same), d == keep))
        known |= {t.lower(): known.get(t.lower(), max(x for x, y in docs if y.lower() == t.lower())) for _, t in docs}
        assert [x[:4] for x in rows(index.ingest(frame(spark, docs)))] == sorted(want, key=repr)


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    left = spark.createDataFrame([(i, i % 3 if i % 2 else 7) for i in range(200)] + [(500, None)], "id long, k long")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, left.join(groups, "k").collect()))
    for bound in (10, 1000):
        monkeypatch.setattr(shared, "HOT_ROWS", bound)
        assert sorted(map(tuple, shared.join_hot(left, groups, ["k"], "n").collect())) == want


# all


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    want = oracle(small, registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got, expected = rows(df.select(order)), sorted(want.select(*order).fetchall(), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True))


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    assert fresh(df, "score", "other") == ["score__", "other"]
    assert df.withColumn("x", F.lit(1)).columns == ["Score", "score_", "x"]
