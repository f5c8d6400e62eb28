import hashlib
import random

from emberlattice.llm import chat_format as C


def digest(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    a, b, n = hashlib.sha256(), hashlib.sha256(), 0
    for _, role, text in turns:
        a.update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            b.update((text or "").encode())
            n += len(text or "")
    return len(turns), a.hexdigest(), n, b.hexdigest()


def sample():
    rng = random.Random(4)
    words = ["</turn>", "\\", "<turn user>", "é", "word", "\n", "###", "<", ">", "12345", "😀", ""]
    rows = [(1, 0, None, None), (1, None, "user", "a"), (1, 0, "assistant", ""), (2, 5, "system", "only"), (None, 1, "user", "x"), (None, 2, "assistant", "y\\")]
    rows += [(3, t, ["user", "assistant"][t % 2], " ".join(rng.choices(words, k=rng.randint(0, 40)))) for t in range(300)]
    rows += [(4, 0, "system", "rules </turn>")] + [(4, t, "assistant" if t % 2 == 0 else "us>er\\", "w " * (900 if t == 7 else 30)) for t in range(1, 40)]
    rows += [(5, 1, "assistant", "same")] * 3 + [(6, 0, "system", "s " * 2000), (6, 1, "assistant", "ok")]
    return [(*r, "clash") for r in rows]


def test_windows_round_trip(spark):
    rows = sample()
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string")
    windows = C.format_chat(conv, budget=200, history=40, block=16)
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(windows).collect()}
    want = {k: digest([r[1:4] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert got == want
    for w in windows.collect():
        turns = C.TURN.findall(w.formatted)
        assert "".join(m.group() for m in C.TURN.finditer(w.formatted)) == w.formatted
        if w.conv_id == 3:
            assert w.n_tokens <= 200
        if w.conv_id == 4:
            assert turns[0][0] == "system" and (w.n_tokens <= 200 or any(len(t[1]) > 1000 for t in turns))
        for s in w.loss_spans:
            assert s.start >= sum(len(m.group()) for k, m in enumerate(C.TURN.finditer(w.formatted)) if k < w.n_repeated)
    repeated = [w for w in windows.collect() if w.conv_id == 3 and w.n_repeated]
    assert repeated


def test_query_has_the_probe_and_takes_empty_tables(spark):
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = C.op1_chat_windows(conv).collect()
    assert [tuple(r)[:5] for r in got] == [(-7, *digest([(0, "user", C.PROBE), (1, "assistant", C.PROBE)]))]
