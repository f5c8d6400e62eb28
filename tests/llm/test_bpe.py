import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlattice.llm import bpe

PATH = bpe.default_tokenizer()
CONTENT = open(PATH, encoding="utf-8").read()
TOK = Tokenizer.from_file(PATH)
TABLE, LENGTHS = bpe.bytes_of_ids(CONTENT)


def direct(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    return ids, TOK.decode(ids, skip_special_tokens=False)


def row(doc_id, text):
    ids, back = direct(text)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def prose(rng, words):
    pool = ["the", "fire", "weather", "index", "isn't", "we'll", "naïve", "größe", "東京", "42", "3.14", "--", "…", "x=y;", "\t", "\n\n", "  "]
    return " ".join(rng.choice(pool) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(words))


def cut_and_joined(text, places):
    """Ids of a text cut at any byte places between characters, every other piece taken as known."""
    data = text.encode()
    edges = sorted({0, len(data), *(p for p in places if 0 < p < len(data) and data[p] & 0xC0 != 0x80)})
    known = [(a, b, np.array(TOK.encode(data[a:b].decode(), add_special_tokens=False).ids, "<u4").tobytes())
             for a, b in zip(edges, edges[1:])][::2] if data else []
    return bpe.assembled([(text, known)], bpe.Stretches(CONTENT), LENGTHS)[0].tolist()


PARTS = st.sampled_from(["a", "word", "'", "'re", "'ll", "s", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "\x1f", "!", "!?", "7", "42", "é", "東",
                         "🙂", "<|endoftext|>", "<|endof", "text|>", "aaaa", "==", "​", "﻿", "᠎", "\x00", "́"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), st.lists(st.integers(0, 200), max_size=12))
def test_any_cut_is_repaired(text, places):
    assert cut_and_joined(text, places) == direct(text)[0]


def test_windows_grow_until_they_agree():
    """With every boundary called safe, first windows end inside tokens; growing them still gives the text's ids."""
    text = "unbelievable counterrevolutionaries misunderstanding " * 3
    data = text.encode()
    cuts = [0, 7, 30, 33, 90, len(data)]
    pieces = [bpe.Piece(a, b, np.array(TOK.encode(data[a:b].decode()).ids, np.uint32), LENGTHS) for a, b in zip(cuts, cuts[1:])]
    joints = bpe.Joints(data, text, pieces)
    joints.marks = np.array([0, 2, 3, 5, 6, 8, 12, 13, 29, 31, 32, 34, 35, 52, 53, 89, 91, 92, 105, len(data)])
    joints.windows = joints._joined([(int(np.searchsorted(joints.marks, c, side="right")) - 2, int(np.searchsorted(joints.marks, c)) + 1) for c in cuts[1:-1]])
    calls = []

    def encode(t):
        calls.append(t)
        return np.array(TOK.encode(t).ids, np.uint32)

    first = list(joints.windows)
    assert joints.repaired(encode, LENGTHS).tolist() == TOK.encode(text).ids
    assert len(calls) > len(first) and max(map(len, calls)) > max(len(joints.text_of(w)) for w in first)


def test_what_is_remembered_does_not_matter():
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(60)] + ["", " ", "a"]
    for most in (0, 50, 10**6):
        pieces = bpe.Stretches(CONTENT, most)
        for k in range(0, len(texts), 7):
            assert [i.tolist() for i in pieces.encode(texts[k:k + 7])] == [direct(t)[0] for t in texts[k:k + 7]]
    assert [i.tolist() for i in bpe.Stretches(CONTENT).encode([])] == []


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join))
def test_stretches_end_at_safe_places(text):
    assert bpe.stretches_of(text) == bpe.SAFE.split(text)
    assert bpe.safe_places(text).tolist() == [len(text[:m.start()].encode()) for m in bpe.SAFE.finditer(text)]


def test_frequent_stretches_are_encoded_once(monkeypatch):
    """What comes often stays known when the memory is full and from one task to the next; the rest is forgotten."""
    given_, encode_all = [], bpe._encode_all
    monkeypatch.setattr(bpe, "_encode_all", lambda tok, texts: given_.extend(texts) or encode_all(tok, texts))
    pieces = bpe.Stretches(CONTENT, 400)
    for k in range(40):
        text = f"start often again{k} often naïve rare{k} often naïve seldom{k}"
        assert [i.tolist() for i in pieces.encode([text])] == [direct(text)[0]]
        assert pieces.chars <= 400 + len(text)
    said = "".join(given_)
    assert said.count(" often") == said.count(" naïve") == 1 and said.count("rare") == 40
    assert bpe.pieces_of(CONTENT) is bpe.pieces_of("".join([CONTENT[:9], CONTENT[9:]]))


def test_chunks_depend_on_content():
    rng = random.Random(4)
    shared = prose(rng, 1500).encode()
    a, b = [bpe.chunks_of(lead.encode() + shared) for lead in ("", prose(rng, 300))]
    shift = b[-1][1] - len(shared)
    assert len({(s + shift, e + shift) for s, e in a} & set(b)) > 0.8 * len(a)
    assert all(e - s >= bpe.LEAST_CHUNK for s, e in a[:-1]) and a[0][0] == 0 and [e for _, e in a[:-1]] == [s for s, _ in a[1:]]
    for data in (b"", b"a" * 50_000, b"ab" * 30_000, "🙂".encode() * 5000):
        for s, e in bpe.chunks_of(data):
            data[s:e].decode()
    assert bpe.chunks_of(b"") == [] and len(bpe.chunks_of(b"a" * 50_000)) == 1


def test_table_of_bytes():
    for ids in ([50256, 50256], direct("naïve 東京 🙂")[0], list(range(300))):
        assert bpe.decoded(np.array(ids, np.uint32), TABLE) == TOK.decode(ids, skip_special_tokens=False)


def test_query_like_the_library(spark):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (200, 400, 900)]
    rows = [(i, prose(rng, rng.randrange(0, 200)) + rng.choice(passages) + prose(rng, rng.randrange(0, 200))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, passages[0]), (104, passages[0]), (105, passages[0] * 3), (None, passages[1]), (None, None),
             (3, rows[3][1]), (3, rows[3][1]), (106, "x" * 30_000), (107, "a b\n" * 20_000), (108, "東" * 4000 + passages[2]),
             (109, "<|endoftext|>" * 400), (110, passages[1] + "<|endoftext|>" + passages[1]), (111, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'k' AS key", "2 AS h", "3 AS known")
    want = sorted((row(*r) for r in rows), key=str)
    assert sorted(map(tuple, bpe.op11_shared_chunk_bpe(docs.repartition(4)).collect()), key=str) == want
    made = bpe.encode_corpus(docs.repartition(4), PATH, broadcast_bytes=0)
    assert sorted(((r.doc_id, r.n_tokens, r.decoded) for r in made.collect()), key=str) == sorted(((i, len(direct(t)[0]), direct(t)[1]) for i, t in rows), key=str)
    assert bpe.op11_shared_chunk_bpe(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_documents_like_the_library(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, bpe.op11_shared_chunk_bpe(docs).collect())) == want
