import hashlib
import re
from collections import Counter

import numpy as np

from emberlattice.llm import pii as P

TEXTS = ["", " ", "a@b.co, x.y+z@m-1.ex.com. @b.c a@b @@ a@b..c a@@b.cc aa@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.02.3.255 1.2.3 " + "9" * 5000,
         "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 4111111111111111111 0000000000000000", "+1 (487) 555-7209 +12 +1----2 +123456789012345678 é+49 (0) 30.12345",
         "Contact my name is John Smith or call (212) 555-0199, ssn 123-45-6789, version 123-45-6780", "jane dot doe at mail dot com and write jane [at] mail [dot] org now",
         "IBAN DE89370400440532013000 ok", "x" * 50000 + "@" + "y" * 10 + ".z", "clean prose, nothing to see in it at all."]
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                  "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_plain_patterns(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (2, TEXTS[2], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")
    got = P.op3_personal_data(docs).collect()
    want = []
    for i, t, *_ in rows:
        spans = brute(t)
        n = Counter(k for k, *_ in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((w[:6] for w in want), key=str)
    for r, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert r.spans.startswith(w[6])
    assert {r.doc_id: r.spans for r in got}[10] == ""


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.3
    right = [0.95, 0.85, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where(rng.random(20000) < a, 1, -1) * np.where(truth, 1, -1)) for a in right], axis=1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    post, table, share = P.estimate_reliabilities(rows, counts.astype(float))
    assert abs(share - 0.3) < 0.03
    for j, a in enumerate(right):
        assert abs(table[1, j, 2] / (table[1, j, 2] + table[1, j, 0]) - a) < 0.04


def test_classifier_adds_supported_spans_only(spark):
    good = [f"Please call {n} Miller at (212) 555-0{i:03d} today" for i, n in enumerate(["John", "Mary", "Peter", "Laura"] * 30)]
    bad = [f"see figure 123-00-{i:04d} and version 912.0{i % 90 + 10}.0000 of it" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.extra] for r in P.find_personal_data(docs).collect()}
    assert sum("local_phone" in found[i] for i in range(120)) > 110
    assert sum(bool(found[i]) for i in range(120, 240)) < 10


def test_empty_table(spark):
    assert P.op3_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
