import zlib

import numpy as np

from emberlattice.llm import quality_model as Q
from emberlattice.llm.common import table


def test_non_negative_risk_finds_the_positives():
    rng = np.random.default_rng(5)
    k = len(Q.FEATURES)
    good, bad = rng.normal(1.0, 1.0, (4000, k)), rng.normal(-1.0, 1.0, (1000, k))
    model = Q.fit_nnpu(rng.normal(1.0, 1.0, (1500, k)), np.vstack([good, bad]), 0.8)
    x = Q.standardised(np.vstack([good, bad]), np.array(model.centre), np.array(model.scale))
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.bias)))
    assert np.mean(p[:4000] >= 0.5) > 0.97 and np.mean(p[4000:] >= 0.5) < 0.05


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = Q.op10_quality_classifier(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    ones, zeros = [r for r in test if r.quality == 1], [r for r in test if r.quality == 0]
    caught, lost = np.mean([r.predicted == 0 for r in zeros]), np.mean([r.predicted == 0 for r in ones])
    rank = np.mean([[(a.score > b.score) + 0.5 * (a.score == b.score) for b in zeros] for a in ones])
    assert rank > 0.99 and caught > 0.95 and lost < 0.01


def test_odd_rows(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "a few words here", 9.0), (4, "long " * 30000, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.op10_quality_classifier(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert Q.op10_quality_classifier(docs.limit(0), labels.limit(0)).count() == 0
    model = Q.train_quality(docs, labels)
    assert Q.keep_quality(docs, model).columns == docs.columns


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(7)
    k = len(Q.FEATURES)
    positive = rng.normal(0.8, 1.0, (3000, k))
    for prior in (0.3, 0.6, 0.9):
        n = int(6000 * prior)
        mixed = rng.permutation(np.vstack([rng.normal(0.8, 1.0, (n, k)), rng.normal(-0.8, 1.0, (6000 - n, k))]))
        assert abs(Q.estimate_prior(positive, mixed) - prior) < 0.05
    assert Q.estimate_prior(positive[:3], positive) == 0.5


def test_labels_of_zero_are_not_used(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert Q.train_quality(docs, labels) == Q.train_quality(docs, labels.where("quality = 1"))
    share = labels.selectExpr("avg(quality) AS s").first()["s"]
    assert abs(Q.train_quality(docs, labels).prior - share) < 0.15
