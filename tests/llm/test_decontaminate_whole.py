"""Cases of the whole rule made by hand."""

import textwrap

import pytest

from emberlattice.llm import decontaminate as D

ITEM = ("Natalia sold 48 clips to her friends in April, and then she sold half as many clips in May. "
        "Each clip weighs 48 g and the box holds 10 clips per layer of the shelf.")
TOM = ("Last summer old Tom walked along the narrow path behind the mill until the river came into view, and there the miller's "
       "dog waited quietly under a broken bridge while the whole village slept, because nobody had told them that the long "
       "winter would end so early, and when the first boats arrived at dawn the children shouted that Tom was back.")
GERMAN = "Der alte Mann gab dem Kind einen Apfel und sagte leise, dass jeder Apfel im Garten bald reif sein wird."


def leaks(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(docs, items, **options).collect()}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_one_conflicting_value_costs_only_its_windows(spark, limit):
    docs = [(1, ITEM.replace("48 g", "47 g")), (2, TOM.replace("old Tom", "old Ken")), (3, GERMAN.replace("einen Apfel", "einen Besen")),
            (4, ITEM.replace("48", "36")), (4, ITEM.replace("48", "37")), (5, ITEM)]
    got = leaks(spark, docs, [(1, ITEM), (2, TOM), (3, GERMAN)], broadcast_rows=limit)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 1), (5, 1)}
    assert got[4, 1].matched == got[5, 1].matched == got[5, 1].item_windows
    assert got[1, 1].matched >= 0.5 * got[1, 1].item_windows
    assert [got[k].verbatim for k in sorted(got)] == [False, False, False, False, True]


def test_windows_of_many_slots_match_word_for_word(spark):
    numbers = "12 + 7 * 3 - 4 / 2 + 19 - 5 * 8 + 6 - 11 * 2 + 9 - 14"
    german = "Der Bauer bringt Äpfel, Birnen, Pflaumen, Kirschen, Nüsse, Trauben, Beeren, Quitten zum Markt am Fluss."
    items = [(1, numbers), (2, german)]
    docs = [(1, "So: " + numbers + " and so on"), (2, german), (3, numbers.replace("12", "13").replace("19", "18").replace("8 +", "1 +"))]
    got = leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1].matched == got[1, 1].item_windows == 6 and got[2, 2].matched == got[2, 2].item_windows == 8


def test_short_items_and_long_passages(spark):
    words = TOM.split()
    docs = [(1, "Quiz: what is the capital of France? Nobody knew."), (2, "What is the capital of Peru?"), (3, "yes 12 Grams"),
            (4, "A start. " + " ".join(words[:28]) + " another end"), (5, " ".join(words[32:45]) + " or so"), (6, " ".join(words[32:44]) + " or so"),
            (7, None)]
    for limit in (500_000, 0):
        got = leaks(spark, docs, [(1, "What is the capital of France?"), (2, "12 grams"), (3, TOM), (4, None), (5, "?!")], broadcast_rows=limit)
        assert set(got) == {(1, 1), (3, 2), (4, 3), (5, 3)}
        assert got[1, 1].matched == got[1, 1].item_windows == 1
        assert got[4, 3].matched == 22 and got[5, 3].matched == 6


def test_case_and_line_wrap_do_not_matter(spark):
    units = "A rope of 48cm and a bag of 3KG lie beside the old door of the mill since May"
    items = [(1, ITEM), (2, GERMAN), (3, TOM), (4, units)]
    forms = [str.upper, str.lower, str.swapcase, lambda t: textwrap.fill(t, 40), lambda t: textwrap.fill(t, 60).replace("\n", "\r\n"),
             lambda t: t.replace(" ", "  \t"), lambda t: t.replace(" ", "\u00a0")]
    docs = [(10 * i + n, "Before. " + form(t) + " After.") for i, t in items for n, form in enumerate(forms)]
    got = leaks(spark, docs, items)
    assert set(got) == {(d, d // 10) for d, _ in docs}
    assert all(r.matched >= r.item_windows for r in got.values())


def test_white_space_of_every_kind_is_evened(spark):
    """Each blank, ASCII or not, and any run of them, reads as one space; a mark of slots in the text is no word."""
    texts = [f"a{blank}b" for blank in D.ASCII_BLANKS + D.WIDE_BLANKS] + ["a \t \n  b", "a\x01 \xa0b", "a" + " \n" * 5000 + "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r[0] for r in df.select(D.canonical(D.evened(D.text_of()))).collect()} == {"a b"}


def test_empty_and_null_texts_are_evened(spark):
    df = spark.createDataFrame([(None,), ("",), ("\n",)], "text string")
    assert [r[0] for r in df.select(D.evened(D.text_of())).collect()] == ["", "", " "]
