import os
import random
import re

import pytest

from emberlattice.llm import ngram_join as N
from emberlattice.llm.common import table
from emberlattice.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


def plain_set(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute(rows, width, percent):
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    passage = rng.choices(words, k=30)
    for family in range(25):
        base = rng.choices(words, k=rng.randint(3, 160))
        for _ in range(rng.choice([1, 2, 3, 40])):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: rng.randint(1, len(text))]
            rows.append((key, (" " if key % 2 else "\n").join(text).title() if key % 5 == 0 else " ".join(text)))
            key += rng.randint(1, 3)
    for _ in range(60):
        rows.append((key := key + 1, " ".join(passage + rng.choices(words, k=25))))
    rows += [(key + 1, None), (key + 2, ""), (key + 3, " \t "), (key + 4, "one two"), (key + 5, "One\x0btwo"), (None, "one two"), (None, None), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 60)])
def test_classes_match_brute_force(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sid string, n int").repartition(5)
    for limit in ((200_000, 0) if width == 4 else (200_000,)):
        got = N.linked_classes(docs, width, percent, broadcast_rows=limit)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, width, percent)


def test_whole_table_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, N.op9_ngram_join(docs).collect()), key=str) == brute(rows, 4, 85)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n long")
    kept = N.keep_one_of_each(docs).collect()
    assert docs.columns == ["doc_id", "text", "n"] and len({r.n for r in kept}) == len(kept)
    # Classes by row, for rows whose doc_id may repeat or be null.
    classes = {}
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    for i, n, c in brute(numbered, 5, 80):
        classes.setdefault(c if n else ("blank", i), []).append(i)
    assert len(kept) == len(classes)
    stays = {r.n for r in kept}
    for members in classes.values():
        assert len(stays & set(members)) == 1
        chosen = rows[(stays & set(members)).pop()][0]
        ids = [rows[i][0] for i in members]
        assert chosen == (None if None in ids else min(ids))


def test_shingles_tell_long_words_apart():
    a, b = "a" * 5000, "a" * 4096 + "b" + "a" * 903
    sets = [shingle_set(t, 4)[0] for t in (a, b, b[4096:] + b[:4096], "A" * 5000)]
    assert len(set(sets)) == 3 and sets[0] == sets[3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.linked_classes(docs).count() == 0 and N.keep_one_of_each(docs).count() == 0


def test_prefixes_do_not_stay_in_the_shared_folder(spark, monkeypatch):
    """Of the tables a join stores none with prefixes is left, and one with whole sketches."""
    tables = []

    def keep(df, store=N.store):
        tables.append(store(df))
        return tables[-1]

    monkeypatch.setattr(N, "store", keep)
    rows = corpus()
    got = N.linked_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 85)
    left = [t for t in tables if os.path.exists(t.stored_at.removeprefix("file:"))]
    assert left and not any("prefix" in t.columns for t in left)
    assert sum(N.SKETCH[-1] in t.columns and "root" not in t.columns for t in left) == 1
