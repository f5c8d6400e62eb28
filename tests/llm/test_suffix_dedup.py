import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlattice.llm import suffix_dedup as S
from emberlattice.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(d[i:i + length]).digest() for d in datas for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, datas):
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i:i + length]).digest()] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(d) else 0
        out.append((doc, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    letters = "abcdefghij klmno é"
    noise = lambda n: "".join(rng.choices(letters, k=n))
    passage, base = noise(500), noise(2500)
    rows = [(i, noise(rng.randint(0, 300)) + passage[rng.randint(0, 60):rng.randint(380, 500)] + noise(rng.randint(0, 300))) for i in range(40)]
    for i in range(40, 60):
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(len(text))] = "Z"
        rows.append((i, "".join(text)))
    rows += [(60, base), (61, base), (62, "short"), (63, "short"), (64, None), (65, ""), (None, noise(900) + base[:700]), (66, "ab" * 900), (67, "x" * 399),
             (68, "y" * 400), (69, "z" * 401), (70, passage + passage), (41, rows[41][1]), (71, noise(450) * 2 + "é")]
    return rows


@pytest.mark.parametrize("length, hot, most", [(400, 4096, 3_000_000), (400, 1, 0), (200, 8, 3_000_000)])
def test_matches_brute_force(spark, length, hot, most):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h string, copies int").repartition(4)
    got = S.remove_repeats(docs, length, hot, most).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_whole_table_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = S.op5_suffix_dedup(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_cover_holds_a_common_sample_across_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 101, 9000, dtype=np.uint8))
    want = S.sample_cover(text, 400)
    monkeypatch.setattr(S, "_CHUNK", 700)
    got = S.sample_cover(text, 400)
    assert set(zip(*map(np.ndarray.tolist, want))) == set(zip(*map(np.ndarray.tolist, got)))
    inner = S.sample_cover(text[137:537], 400)
    assert len(inner[0]) == 1 and inner[0][0] + 137 in want[0]


def common_passage(n):
    rng = random.Random(31)
    noise = lambda k: "".join(rng.choices("abcdefghij klmno", k=k))
    passage = noise(900)
    return [(i, noise(rng.randint(300, 500)) + passage + noise(rng.randint(0, 500))) for i in range(n)]


def test_common_passage_is_spread_over_tasks(spark):
    rows = common_passage(1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        _, ranges = S.repeated_ranges(docs)
        sizes = [r["n"] for r in ranges.groupBy(F.spark_partition_id()).agg(F.countDistinct("h").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # No task holds rows of all texts.
    assert max(sizes) < 1000
    assert sorted(map(tuple, S.op5_suffix_dedup(docs).collect()), key=str) == brute(rows, 400)


def test_parts_name_equal_strings_alike():
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 672, dtype=np.uint8))
    contexts = []
    for i in range(90):
        text = bytearray(base)
        for at in rng.integers(0, 672, 2):
            text[at] = 65 + i % 5
        before, after = (int(rng.integers(0, 273)), int(rng.integers(128, 401))) if i % 2 else (272, 400)
        if before + after >= 400:
            contexts.append((before, bytes(text[272 - before:272 + after])))
    _, valid = S.string_hashes(contexts, 400)
    names = {}
    for i, part, core, body, first, last in zip(*(x.tolist() for x in S.part_names(contexts, 400))):
        left, data = contexts[i]
        assert valid[i, first:last + 1].all() and first // S.PART == last // S.PART == part
        names.update({(i, d): (part, core, body, first, last) for d in range(first, last + 1)})
        start, end = part * S.PART, min(part * S.PART + S.PART - 1, 272)
        assert len(data[left - start:left + 400 - end]) == 400 - end + start
    assert set(names) == set(zip(*(x.tolist() for x in np.nonzero(valid))))
    strings = {}
    for (i, d), (part, core, *_) in names.items():
        left, data = contexts[i]
        strings.setdefault((d, data[left - d:left - d + 400]), set()).add((part, core))
    assert all(len(x) == 1 for x in strings.values())
    bodies = {}
    for i, _d in names:
        part, core, body, first, last = names[i, _d]
        left, data = contexts[i]
        bodies.setdefault((part, core, body, first, last), set()).add(data[left - last:left + 400 - first])
    assert all(len(x) == 1 for x in bodies.values()) and len(bodies) > 100


def test_empty_table(spark):
    assert S.op5_suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_and_many_contexts_give_the_same_offsets():
    rng = np.random.default_rng(6)
    base = bytes(rng.integers(97, 123, 672, dtype=np.uint8))
    contexts = []
    for i in range(1100):
        text = bytearray(base)
        for at in rng.integers(0, 672, 3):
            text[at] = 65 + i % 7
        cut = int(rng.integers(0, 272)) if i % 3 == 0 else 272
        contexts.append((cut, bytes(text[272 - cut:])))
    many = S.repeated_offsets(contexts, 400)
    some = S.repeated_offsets(contexts[:1000] + contexts[1000:1024], 400)
    assert many.shape == (1100, 273) and not (some & ~many[:1024]).any()
    for offset in (0, 100, 272):
        strings = [c[left - offset:left - offset + 400] if offset <= left and len(c) - left >= 400 - offset else None for left, c in contexts]
        seen = Counter(x for x in strings if x is not None)
        assert [bool(f) for f in many[:, offset]] == [x is not None and seen[x] > 1 for x in strings]
        seen = Counter(x for x in strings[:1024] if x is not None)
        assert [bool(f) for f in some[:, offset]] == [x is not None and seen[x] > 1 for x in strings[:1024]]
