from collections import Counter, defaultdict

import regex

from emberlattice.llm import decontaminate as D
from emberlattice.llm.common import table

SF = "/root/testdata/sf0.001"


SPACE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def tokens(text):
    text = regex.sub(SPACE, " ", text or "")
    text = regex.sub(rf"([0-9])(?=(?i:{'|'.join(D.UNITS)})\b)", r"\1 ", text).replace("\x01", "")
    marked = regex.sub(rf"\b(?:{'|'.join(D.NAMES)})\b|(?<=[\p{{Ll}},;] )\p{{Lu}}\p{{Ll}}+", lambda m: "\x01n" + m[0], text)
    marked = regex.sub(r"(?<![\p{L}\p{N}])([0-9]+(?:[.,][0-9]+)*)", lambda m: "\x01d" + m[0], marked)
    marked = regex.sub(rf"(\x01d[0-9.,]*[0-9]) ?({'|'.join(D.UNITS)})\b", lambda m: f"{m[1]} \x01u{m[2]}", marked).lower()
    marked = regex.sub(rf"(?<![\p{{L}}\p{{N}}\x01])(?:{'|'.join(D.NUMBER_WORDS)})(?![\p{{L}}\p{{N}}])", lambda m: "\x01d" + m[0], marked)
    return regex.sub(r"(?<![0-9])[.,]|[.,](?![0-9])|[^\p{L}\p{N}\x01.,]+", " ", marked).split()


def windows(text, sizes, whole, width=8, max_slots=3):
    """(pos, key, slots): template windows, word windows of those with slots, and short windows by words."""
    t = tokens(text)
    plain = [w[2:] if w[0] == "\x01" else w for w in t]
    for i in range(len(t) - width + 1):
        slots = tuple(w for w in t[i:i + width] if w[0] == "\x01")
        if len(slots) <= max_slots:
            yield i, tuple(w[:2] if w[0] == "\x01" else w for w in t[i:i + width]), slots
        if slots:
            yield i, tuple(plain[i:i + width]), ()
    for n in sizes:
        for i in range(len(t) - n + 1):
            if not whole or len(t) == n:
                yield i, tuple(plain[i:i + n]), ()


def brute(docs, items, width=8, run=6):
    index, size = defaultdict(set), {}
    for item, text in items:
        own = set(windows(text, range(1, width), True))
        size[item] = len({pos for pos, _, _ in own})
        for pos, key, slots in own:
            index[key].add((item, pos, slots))
    short = {n for n in (len(tokens(text)) for _, text in items) if 0 < n < width}
    lines = defaultdict(set)
    for doc, text in docs:
        for pos, key, slots in windows(text, short, False):
            for item, b_pos, b_slots in index.get(key, ()):
                lines[doc, text, item, pos - b_pos].add((b_pos, b_slots, slots))
    found = defaultdict(lambda: [set(), True, False])
    for (doc, _, item, shift), hits in lines.items():
        votes = Counter((b, d) for _, bs, ds in hits for b, d in zip(bs, ds))
        best = {}
        for (b, d), n in votes.items():
            best[b] = max(best.get(b, (0, False, "")), (n, b == d, d))
        counts = [(p, bs == ds) for p, bs, ds in hits if bs == ds or all(best[b][2] == d for b, d in zip(bs, ds))]
        if counts:
            kept = {p for p, same in counts if same}
            row = found[doc, item]
            row[0] |= {(shift, p) for p, _ in counts}
            row[1] &= all(bs == ds for _, bs, ds in hits)
            row[2] |= any(all(p + k in kept for k in range(run)) for p in kept)
    return sorted(((d, i, len(n), size[i], same) for (d, i), (n, same, long) in found.items() if n and (len(n) >= 0.5 * size[i] or len(n) >= 24 or long)), key=str)


ITEM = ("Natalia sold 48 clips to her friends in April, and then she sold half as many clips in May. "
        "Each clip weighs 48 g and the box holds 10 clips per layer of the shelf.")
DOCS = [(1, ITEM), (2, "Before. " + ITEM.replace("48", "36").replace("Natalia", "Emma").replace("10", "12") + " After."),
        (3, ITEM.replace("48 clips", "36 clips").replace("48 g", "99 g")), (4, ITEM.upper()), (5, "she sold half as many clips in May then left"),
        (6, None), (7, ""), (None, ITEM), (1, ITEM), (8, "x " * 20000 + ITEM + " 1,5 \x01d9 ")]


def test_matches_brute_force(spark):
    items = [(1, ITEM), (2, "too short"), (3, None), (None, "one of many other items with enough plain words to be found somewhere")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, item_id string, h int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, pos int")
    want = brute([d for d in DOCS if d != (1, ITEM)] + [(1, ITEM)], items)
    for limit in (500_000, 0):
        got = sorted(map(tuple, D.leaks(docs, bench, broadcast_rows=limit).collect()), key=str)
        assert got == want
    found = {d: same for d, _, _, _, same in want}
    assert found[1] and found[None] and found[2] is False and found[4] and 5 not in found
    kept = [r.doc_id for r in D.decontaminate(docs, bench).collect()]
    assert sorted(kept) == sorted(d for d, _ in DOCS if d not in found)


def test_whole_tables_match_brute_force(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(map(tuple, D.op8_benchmark_leaks(docs, bench).collect()), key=str) == want and want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, bench).count() == 0
    full = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert D.decontaminate(full, bench).count() == len(DOCS)
