import re

import pytest

from emberlattice.llm import url_filter as U

URLS = ["https://WWW.Example.org/es/1?x#y", "http://a.example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1",
        "http://notexample.org/es/1", "http://com/de/", "ftp://m.casino-win.example.net/en/1", None, "", "no scheme/de/", "a://b://c/d", "x://",
        "http://h?q=/de/", "http://h#f", "http://quiet.letters.net/en/31\nsecond", "HTTP://ÄB.Com/fr/é"]


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, "kept", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "kept", 1)],
                                  "page_id long, url string, host string, rule int")
    return U.op7_url_filters(pages).collect()


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2)) if m else ("", "")


def test_parts_and_rules(judged):
    assert len(judged) == len(URLS) + 1
    for row in judged:
        host, path = parts(URLS[row.page_id])
        assert (row.host, row.path) == (host, path)
        fits = [(r, v) for r, v in U.RULES
                if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/"):])]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert row.rule == rule[0]
        assert row.verdict == (rule[1] or ("block" if row.block_score >= 0.5 else "allow"))


def test_model_separates_held_out_hosts(spark):
    model = U.train_url_model(U.labelled_urls(spark))
    bad = ["http://www.casino-royal.net/en/1", "https://blog.cheap-pills.net/x", "http://m.free-bets.net/en/22", "http://spam-farm.net/de/2", "https://ads-track.net/en/9"]
    good = ["https://www.archive.net/en/61", "http://blog.physics.net/en/9321.html", "https://m.therin.net/es/75", "http://ththth.net/de/33#top"]
    pages = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.verdict for r in U.filter_urls(pages, model).collect()}
    assert [got[u] for u in bad] == ["block"] * len(bad)
    assert [got[u] for u in good] == ["allow"] * len(good)


def test_empty_table(spark):
    assert U.op7_url_filters(spark.createDataFrame([], "page_id long, url string")).count() == 0
