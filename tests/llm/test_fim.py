import hashlib
import re

from pyspark.sql import functions as F

from emberlattice.llm import fim

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= fim_percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "\n", "one", "one\n", "\n\n\n", "a\nb\nc\nd", "a\r\nb\u2028c\u0085d\ne", "x <P> y\nz", "<S>\n", "tail <M>", "<\nP>\n<S\n>M>\n<",
         "$1 \\1\n$3\\\n", "\U0001f600\U0001f600\nzwei \u00fc\n\U0001f680", "q" * 100_000, "l\n" * 60_000, "x\n" * 30_000 + "y" * 50_000, "a\nb\nc\nd"]


def test_cut_and_restored_like_brute_force(spark):
    rows = [(i + 40 * k, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "no\nid\n"), (6, TEXTS[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS output", "'x' AS form", "2 AS n")
    for options in ({}, {"seed": 3, "fim_percent": 60, "spm_percent": 20}):
        made = fim.fill_in_middle(docs, **options)
        assert sorted(map(tuple, made.collect()), key=str) == sorted((brute(i, t, **options) for i, t in rows), key=str)
        back = made.select("doc_id", fim.restore(F.col("output"), F.col("form"))).collect()
        assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_all_forms_and_empty_parts_occur(spark):
    rows = [(i, "a\nb\nc") for i in range(200)]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["form"] for r in made} == {"psm", "spm"}
    assert min(r["prefix_chars"] for r in made) == 0 and min(r["middle_chars"] for r in made) == 0
    assert max(r["prefix_chars"] + r["middle_chars"] for r in made) == 5


def test_empty_table_and_digests(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.op13_fill_in_middle(none).collect() == []
    row = fim.op13_fill_in_middle(spark.createDataFrame([(5, "a\nb")], "doc_id long, text string")).first()
    assert row["output_sha256"] == hashlib.sha256(brute(5, "a\nb")[5].encode()).hexdigest()
    assert row["restored_sha256"] == hashlib.sha256(b"a\nb").hexdigest()


def test_plan_holds_no_python_and_one_replacement(spark):
    plan = fim.op13_fill_in_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
