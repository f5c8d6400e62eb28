from collections import defaultdict

import numpy as np

from emberlattice.llm import mixing as M
from emberlattice.llm.common import table

SF = "/root/testdata/sf0.001"


def test_marginals_meet_their_targets(spark):
    targets = M.MixTargets(rounds=60)
    docs = table(spark, SF, "documents")
    slim = M.classify(docs, targets)
    factors, b, c, tokens = M.rake(slim, targets)
    a = {r.mix_source: r.mix_factor for r in factors.collect()}
    cells = defaultdict(float)
    for r in slim.collect():
        cells[r.source, r.mix_lang, r.topic] += r.n_tokens
    weight = {k: n * a[k[0]] * b[k[1]] * c[k[2]] for k, n in cells.items()}
    assert np.isclose(sum(weight.values()), 1)
    for axis, temperature in ((0, 0.5), (2, 0.7)):
        totals, got = defaultdict(float), defaultdict(float)
        for k, n in cells.items():
            totals[k[axis]] += n
            got[k[axis]] += weight[k]
        scale = sum(n**temperature for n in totals.values())
        assert all(abs(got[k] - n**temperature / scale) < 1e-4 for k, n in totals.items())


def test_draw_keeps_the_rates_and_handles_odd_rows(spark):
    rows = [(i, "w " * (i % 9 + 1), "en" if i % 3 else None, f"s{i % 2}", i) for i in range(4000)]
    rows += [(5000, None, "de", "blank", 1), (None, "a b", "xx", None, 1), (1, "w w", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rate long")
    got = M.mix_documents(docs).collect()
    assert not any(r.doc_id == 5000 for r in got)
    expected = sum(r.copies * r.n_tokens for r in got)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(expected / total - 0.5) < 0.05
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "rate", "topic", "n_tokens", "copies"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert M.op4_source_mix(docs).count() == 0
