"""The corpus pipeline: every stage against a plain version on its own input, then the whole."""

from collections import Counter

import brute
import corpus_pipeline as cp
import duckdb
import pytest
from tokenizers import Tokenizer

from test_jaccard import gone as all_pairs

from lattica.llm import mixing, sst, toxicity
from lattica.llm.shared import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage was given and gave, each written and read again."""
    own, docs, out = tmp_path_factory.mktemp("stages"), table(spark, small, "documents"), []
    for name, f in cp.STAGES:
        result = f(spark, docs, small)
        result.write.parquet(str(own / name))
        result = spark.read.parquet(str(own / name))
        out.append((docs, result))
        docs = result
    return out


def test_shape(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_output"]
    for given, gave in stages[:-1]:
        assert gave.columns == given.columns == COLUMNS


def test_toxicity(spark, small, stages):
    given, gave = stages[0]
    scorer = toxicity.Scorer(toxicity.train(given, table(spark, small, "labels")))
    assert as_rows(gave) == Counter({k: n for k, n in as_rows(given).items() if scorer.score(k[1]) < 0.7})
    toxic = {r.doc_id for r in table(spark, small, "labels").where("toxic = 1").collect()}
    clean = [r.doc_id for r in given.collect() if r.doc_id not in toxic]
    kept = {r.doc_id for r in gave.collect()}
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_near_duplicates(stages):
    given, gave = stages[1]
    rows = as_rows(given)
    gone, links = all_pairs([(r[0], r[1]) for r in rows])  # by the shingle sets of all pairs, as the stage links them
    assert gone and links and as_rows(gave) == Counter({k: n for k, n in rows.items() if k[0] not in gone})


def test_benchmarks(spark, small, stages):
    given, gave = stages[2]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    bad = {d for d, _ in brute.containment([(r.doc_id, r.text) for r in given.collect()], items)}
    assert bad and as_rows(gave) == Counter({k: n for k, n in as_rows(given).items() if k[0] not in bad})


def test_mixing(stages, tmp_path):
    given, gave = stages[3]
    given.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet')")
    want = {r[0]: r[4] for r in con.sql(mixing.ORACLE_SQL["op7_mixing"]).fetchall()}
    copies = Counter(r.doc_id for r in gave.collect())
    for r in given.collect():
        assert copies[r.doc_id] * len(brute.words(r.text)) == want[r.doc_id]
    assert set(as_rows(gave)) <= set(as_rows(given))


def test_tokens(stages):
    given, gave = stages[4]
    want = brute.token_rows([(r.doc_id, r.text) for r in given.collect()], Tokenizer.from_file(sst.tokenizer_path("byte_bpe_50k.json")))
    got = sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in gave.collect()), key=lambda r: r[1])
    assert got == want


def test_whole(spark, small, stages):
    order = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert Counter(map(tuple, cp.run(spark, small).select(order).collect())) == Counter(map(tuple, stages[-1][1].select(order).collect()))


def test_empty_and_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5), (4, "x " * 20_000, "en", "s", 40_000)], schema)
    for docs in (odd, odd.limit(0)):
        for _, f in cp.STAGES:
            docs = f(spark, docs, small)
        assert docs.columns[:1] == ["doc_id"]
        docs.collect()


def test_copies_are_encoded_once():
    """Stage 5 gets each document as often as the mix takes it; the tokenizer gets it once a portion."""
    given = []
    encode = lambda texts: given.extend(texts) or [t.encode() for t in texts]
    texts = ["a b"] * 3 + [""] * 2 + ["c", "a b", "d"]
    assert list(sst.each_once(encode, texts)) == [t.encode() for t in texts]
    assert given == ["a b", "", "c", "d"] and list(sst.each_once(encode, [])) == []
