"""The stages of the pipeline against plain versions, and on odd tables."""

import pytest
from llm_cases import TEXTS, documents, key, none
from test_llm_dedup import plain_exact
from test_llm_shingle_dedup import plain_similar
from test_llm_text import plain_scan

import corpus_pipeline
from conftest import SMALL
from tidemark.llm import common, pieces, toxicity


def test_run_equals_the_plain_stages(spark):
    common.configure(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    terms = lambda t: sorted({model.place[x] for w in toxicity.words_of(t) for x in toxicity.terms_of(w) if x in model.place})
    rows = [(i, t) for i, t in rows if model.score(terms(t)) < 0.5]
    keep = {k for _, k, _, _ in plain_exact(rows)}
    rows = [(i, t) for i, t in rows if i in keep]
    keep = {c for _, c in plain_similar(rows)[0]}
    rows = [(i, t) for i, t in rows if i in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not plain_scan(t, items)[1]]
    out = corpus_pipeline.run(spark, SMALL)
    spell = pieces.load()["text"]
    got = [(r.doc_id, b"".join(spell[p] for p in r.piece_ids)[1:].decode()) for r in out.collect()]
    assert sorted(got) == sorted(rows) and 100 < len(rows) < 200
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "piece_ids", "piece_score", "other_scores"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, empty):
    docs = none(spark) if empty else documents(spark, TEXTS)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(set(kept)) == len(kept) and set(kept) <= set(TEXTS) and bool(kept) != empty
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted((r.doc_id for r in out), key=key) == sorted((i for i, _ in kept), key=key)


def test_the_stages_are_the_named_ones():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_by_fingerprint_go(spark):
    """Texts that repeat one passage have one fingerprint, though few of their different shingles are the same."""
    passage = " ".join(f"w{k}" for k in range(9))
    texts = [(i, " ".join([passage] * 100 + [f"tail{i}x{k}" for k in range(20)])) for i in (1, 2, 3)] + [(4, "quite another text of a few words")]
    docs = documents(spark, texts)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()) == [1, 4]
    assert len(plain_similar(texts)[0]) == 4 and len({c for _, c in plain_similar(texts)[0]}) == 4  # the shingles alone leave them apart
