import corpus_pipeline
from lattica.llm import decontaminate, mixing, simhash, tokens, toxicity
from lattica.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    """Each stage on what its predecessor kept, against its operator's own result."""
    docs = table(spark, DIR, "documents")
    kept = corpus_pipeline.toxicity(spark, docs, DIR)
    bad = {r.doc_id for r in toxicity.op10_toxicity(spark, DIR).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    kept = corpus_pipeline.near_dedup(spark, kept, DIR).cache()
    assert kept.columns == docs.columns and kept.count() == simhash.near_duplicates(kept).select("component_id").distinct().count()
    clean = corpus_pipeline.decontamination(spark, kept, DIR).cache()
    assert decontaminate.contamination(clean, table(spark, DIR, "benchmark")).where(decontaminate.contaminated()).count() == 0
    mixed = corpus_pipeline.mixing(spark, clean, DIR).cache()
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in mixing.mixture(clean).collect())
    out = corpus_pipeline.tokens(spark, mixed, DIR).collect()
    enc = tokens.encoder(tokens.TOKENIZER)
    assert len(out) == mixed.count() and sum(r.n_tokens for r in out) == sum(len(enc._ids(r.text or "")) + 1 for r in mixed.collect())


def test_run_and_empty_tables(spark, no_docs):
    assert corpus_pipeline.run(spark, DIR).count() > 0
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_null_and_repeated_ids_keep_their_own_rows(spark):
    """One row for each component, and only contaminated texts go, whatever the ids."""
    text = lambda w: " ".join(f"{w}{k}" for k in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (1, text("c")), (2, text("a2")), (2, text("c")), (2, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text[:2]) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, "a0"), (None, "b0"), (1, "c0"), (2, "a2"), (2, "d0")], key=str)
    items = spark.createDataFrame([("i", text("a")), ("j", text("d"))], "item_id string, text string")
    clean = sorted(((r.doc_id, r.text[:2]) for r in decontaminate.drop_contaminated(docs, items).collect()), key=str)
    assert clean == sorted([(None, "b0"), (None, "b0"), (1, "c0"), (2, "a2"), (2, "c0")], key=str)
