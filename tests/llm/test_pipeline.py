"""The pipeline's stages, each against a plain computation on its own input."""

import re

import corpus_pipeline as P
from emberlattice.llm.common import table
from test_decontaminate import brute as leaks
from test_ngram_join import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents").cache()
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 0}
    kept = P.quality(spark, docs, SF).cache()
    assert kept.columns == columns
    lost = set(before) - {r.doc_id for r in kept.collect()}
    assert len(lost & bad) >= 0.6 * len(bad) and len(lost) < 0.35 * len(before)
    rows = {r.doc_id: r for r in kept.collect()}
    near = P.near_duplicates(spark, kept, SF).cache()
    found = classes([(d, r.text) for d, r in rows.items()], 5, 80)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {c if n else d for d, n, c in found}
    clean = P.benchmark_leaks(spark, near, SF).cache()
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = {d for d, *_ in leaks([(r.doc_id, r.text) for r in near.collect()], bench)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - leaked
    safe = P.secrets(spark, clean, SF).cache()
    assert safe.columns == columns and {r.doc_id for r in safe.collect()} == {r.doc_id for r in clean.collect()}
    for r in safe.collect():
        assert not re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r.text or "")
        if r.text != before[r.doc_id].text:
            assert re.search(r"\[(assign|access|hex|entropy\w+)\]", r.text)
    mixed = P.mix(spark, safe, SF).collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in safe.collect()} and all(r.copies >= 1 for r in mixed)


def test_run_applies_all_stages(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "text", "topic", "n_tokens", "rate", "copies"} <= set(got.columns) and got.count() > 0


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "de", "s", 0)]
    for docs in (rows, rows[:0]):
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in P.STAGES:
            df = stage(spark, df, SF)
        assert df.count() <= len(docs)
