"""Benchmark decontamination by canonical templates, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.llm.common import let, store, text_of

# Words that stand for a number, units that may follow one, common given names.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand".split()
UNITS = ("mm cm m km mg g kg ml l s min h ms inch inches feet ft miles mile pounds lb oz dollars dollar cents euros euro hours hour "
         "minutes minute seconds second days day weeks week months month years year percent degrees meters metres litres liters").split()
NAMES = ("Alice Bob Carol David Emma Frank Grace Henry Anna Tom John Mary James Sarah Peter Maria Michael Laura Sam Lisa Jack Julia "
         "Daniel Emily Mark Olivia Paul Sophie Max Natalia Weng Betty Ken Joy Randy Albert Tina Toula").split()
MARK = "\x01"
# White space within ASCII, and beyond it.
ASCII_BLANKS = "\t\n\x0b\x0c\r"
WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _spaced(text: Column, blanks: str) -> Column:
    """Each of ``blanks`` as a space: plain replacement, many times cheaper than a pattern over every character."""
    for blank in blanks:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def evened(text: Column) -> Column:
    """Runs of white space as one space, and a space before a unit of any case, so line wrap and case leave the words as they are."""
    def single(spaced: Column) -> Column:
        return F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)

    def unit_apart(spaced: Column) -> Column:
        return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, rf"([0-9])(?=(?i:{'|'.join(UNITS)})\b)", "$1 ")).otherwise(spaced)

    plain = let(_spaced(text, ASCII_BLANKS), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(_spaced(t, WIDE_BLANKS)))
    return let(let(plain, single), unit_apart)


def canonical(text: Column) -> Column:
    """Lower-case words joined by spaces; slots are a mark, a type letter (d, u or n) and the value.

    Numbers and number words are d, units right after a number u, names n: listed given names, and
    capitalised words inside a sentence. Each step's text is named by ``let``: inside the array functions that
    read it Spark does not share equal expressions, and would run the earlier steps again for every mention.
    """
    units, words = "|".join(UNITS), "|".join(NUMBER_WORDS)
    firsts = "".join(sorted({w[0] for w in NUMBER_WORDS}))

    def named(plain: Column) -> Column:
        return F.regexp_replace(plain, rf"(?=\p{{Lu}})(?:\b(?:{'|'.join(NAMES)})\b|(?<=[\p{{Ll}},;] )\p{{Lu}}\p{{Ll}}+)", f"{MARK}n$0")

    def numbered(marked: Column) -> Column:
        numbers = F.regexp_replace(marked, r"(?<![\p{L}\p{N}])([0-9]+(?:[.,][0-9]+)*)", f"{MARK}d$1")
        return F.when(marked.rlike("[0-9]"), F.regexp_replace(
            numbers, rf"({MARK}d[0-9.,]*[0-9]) ?({units})\b", f"$1 {MARK}u$2")).otherwise(marked)

    marked = let(named(F.replace(text, F.lit(MARK), F.lit(""))), numbered)
    marked = F.regexp_replace(F.lower(marked), rf"(?=[{firsts}])(?<![\p{{L}}\p{{N}}{MARK}])(?:{words})(?![\p{{L}}\p{{N}}])", f"{MARK}d$0")
    return F.regexp_replace(marked, rf"[.,](?:(?<![0-9].)|(?![0-9]))|[^a-z \p{{L}}\p{{N}}{MARK}.,]+", " ")


ROW = "struct<pos:int,h:bigint,slots:array<string>>"
BITS = 1 << 20


def hash_bits(hashes: DataFrame) -> Column:
    """The values of ``h`` as a bit map of fixed size (128 KB), a constant array that every row can look into."""
    word, bit = F.shiftright(F.col("h").bitwiseAND(BITS - 1), 6), F.col("h").bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    known = {r["word"]: r["bits"] for r in hashes.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).collect()}
    return F.split(F.lit(",".join(str(known.get(k, 0)) for k in range(BITS >> 6))), ",").cast("array<bigint>")


def _seen(bits: Column | None, h: Column) -> Column:
    """Whether a hash may be among those of a bit map; without one, any may."""
    if bits is None:
        return F.lit(True)
    return F.getbit(F.get(bits, F.shiftright(h.bitwiseAND(BITS - 1), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1


def _windows(spans: Column, span: int, size: int, last: Column, bits: Column | None) -> Column:
    """(pos, h) of windows of ``size`` words from the hashes of all windows of ``span``: two of them, which may overlap, make a longer one."""
    if span == size:
        places = F.transform(spans, lambda h, i: F.when(
            (i <= last) & _seen(bits, h), F.struct((i + 1).alias("pos"), h.alias("h"))))
        return F.filter(places, lambda r: r.isNotNull())
    gap = min(span, size - span)
    wider = F.transform(spans, lambda h, i: F.xxhash64(h, F.get(spans, i + gap)))
    return let(wider, lambda wider: _windows(wider, span + gap, size, last, bits))


def windows_of(text: Column, width: int, max_slots: int, short: list[int] = (), whole: bool = False, bits: Column | None = None) -> Column:
    """Array of (pos, h, slots): each window's template hash and its slot values in order.

    Windows with more than ``max_slots`` slots say too little as templates and are left out. Every window with slots
    has a second row, the hash of its words without slots, so that an equal window meets it whatever is typed as a
    slot there: capital letters decide what is a name. ``short`` adds windows of these numbers of words, by words;
    with ``whole`` only if the text has that many. With ``bits`` windows whose hash is not in the map are left out
    before their slots are looked up. Each word is hashed once.
    """
    def hashed(tokens: Column, of_slot) -> Column:
        """A hash for each word; a mark stands at the beginning of a word only."""
        return F.transform(tokens, lambda w: F.xxhash64(F.when(w.startswith(MARK), of_slot(w)).otherwise(w)))

    def found(hashes: Column, size: int) -> Column:
        """(pos, h) of the windows of ``size`` words that may be wanted."""
        return let(hashes, lambda h: _windows(h, 1, size, F.size(h) - size, bits))

    def rows(places: Column, slots=None) -> Column:
        values = (lambda r: F.array_remove(F.slice(slots, r["pos"], width), "")) if slots is not None else (lambda r: F.array().cast("array<string>"))
        return F.transform(places, lambda r: F.struct(r["pos"].alias("pos"), r["h"].alias("h"), values(r).alias("slots"))).cast(f"array<{ROW}>")

    def few(words: Column) -> Column:
        none = F.array().cast(f"array<{ROW}>")
        parts = [F.when(F.size(words) == n, rows(found(words, n))).otherwise(none) if whole else rows(found(words, n)) for n in short]
        return F.concat(*parts) if parts else none

    def with_slots(tokens: Column, words: Column) -> Column:
        slots = F.transform(tokens, lambda w: F.when(w.startswith(MARK), w).otherwise(""))

        def both(slots: Column) -> Column:
            template = hashed(tokens, lambda w: F.substring(w, 1, 2))
            typed = F.filter(rows(found(template, width), slots), lambda r: F.size(r["slots"]) <= max_slots)
            plain = F.filter(rows(found(words, width), slots), lambda r: F.size(r["slots"]) > 0)
            return F.concat(typed, F.transform(plain, lambda r: F.struct(
                r["pos"].alias("pos"), r["h"].alias("h"), F.array().cast("array<string>").alias("slots"))).cast(f"array<{ROW}>"))

        return let(slots, both)

    def of_line(line: Column) -> Column:
        return let(F.array_remove(F.split(line, " "), ""), lambda tokens: let(
            hashed(tokens, lambda w: w.substr(F.lit(3), F.length(w))), lambda w: F.concat(
                F.when(line.contains(MARK), with_slots(tokens, w)).otherwise(rows(found(w, width))), few(w))))

    return let(canonical(text), of_line)


def wanted_windows(text: Column, hashes: DataFrame, width: int, max_slots: int, short: list[int]) -> Column:
    """``windows_of`` a document, those that may meet one of ``hashes`` (h)."""
    return let(hash_bits(hashes), lambda bits: windows_of(text, width, max_slots, short, bits=bits))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, max_slots: int = 3, min_share: float = 0.5,
          min_windows: int = 24, broadcast_rows: int = 500_000, run_words: int = 13) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a benchmark item: matched, item_windows, verbatim.

    Template windows of both sides meet by their hash. Along one alignment (a constant shift between the
    two texts) the slots must be consistent: equal benchmark values stand for equal document values; windows
    that break the rule do not count (see ``_judged``). Windows with slots meet by their words too, whatever their case
    and line wrap. An item is leaked if ``min_share`` of its windows, or ``min_windows`` of
    them, match, or if a document holds ``run_words`` of its words in a row, unchanged.
    verbatim tells that every slot kept its value.

    Null text counts as empty; null ids are an id. Rows with one doc_id are one document; repeated rows change
    nothing. Items shorter than ``width`` words are one window of their whole length, met by
    its words (an item of one or two words wherever these stand). Items without a word match nothing. Other columns are ignored,
    so their names may clash. The benchmark's windows are broadcast only if counted to be at most
    ``broadcast_rows``; else both sides shuffle by hash. Windows of documents are looked up in a bit map of the benchmark's
    hashes first, so that few are joined.
    """
    text = evened(text_of())
    items = benchmark.select(F.col("item_id"), F.inline(windows_of(text, width, max_slots, list(range(1, width)), whole=True)))
    items = items.withColumnsRenamed({"pos": "b_pos", "slots": "b_slots"})
    items = store(items.dropDuplicates(["item_id", "b_pos", "h", "b_slots"]))
    lengths = benchmark.select(F.size(F.array_remove(F.split(canonical(text), " "), "")).alias("n"))
    short = sorted(r["n"] for r in lengths.where(F.col("n").between(1, width - 1)).distinct().collect())
    sizes = items.groupBy("item_id").agg(F.countDistinct("b_pos").alias("item_windows"))
    bounded = items.count() <= broadcast_rows
    windows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"),
                          F.inline(wanted_windows(text, items, width, max_slots, short)))
    hits = windows.join(F.broadcast(items) if bounded else items, "h").withColumn("shift", F.col("pos") - F.col("b_pos"))
    found = _judged(hits, max(run_words - width + 1, 1))
    sizes = sizes.withColumnRenamed("item_id", "sized_item")
    joined = found.join(F.broadcast(sizes) if bounded else sizes, F.col("item_id").eqNullSafe(F.col("sized_item")))
    enough = (F.col("matched") >= min_share * F.col("item_windows")) | (F.col("matched") >= min_windows) | F.col("long_run")
    return joined.where(enough).select("doc_id", "item_id", "matched", "item_windows", "verbatim")


def _pairs() -> Column:
    return F.zip_with("b_slots", "slots", lambda b, d: F.struct(b.alias("b"), d.alias("d")))


def _judged(hits: DataFrame, run: int) -> DataFrame:
    """(doc_id, item_id, matched, verbatim, long_run), each window judged by itself.

    long_run tells that ``run`` windows in a row are unchanged along one alignment.

    Windows without slots or with unchanged values always count. Another window counts if each of its
    benchmark values stands for the document value that most windows of the alignment give it (ties: the
    unchanged value, then the greatest). An alignment lies inside one text, so two texts of one doc_id
    never conflict. The sort windows need no shuffle besides the one by alignment.
    """
    line = ["doc_id", "text_key", "item_id", "shift"]
    rows = hits.select(*line, "b_pos", "slots", (F.col("b_slots") == F.col("slots")).alias("exact"), _pairs().alias("pairs"))
    rows = rows.repartition(*line).dropDuplicates([*line, "b_pos", "slots", "exact"])
    rows = rows.select(*line, "b_pos", "slots", "exact", F.inline_outer("pairs"))
    votes = rows.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*line, "b", "d")))
    best = F.max(F.struct("votes", (F.col("b") == F.col("d")).alias("kept"), "d")).over(Window.partitionBy(*line, "b"))
    fits = votes.withColumn("fits", F.col("exact") | (best["d"] == F.col("d")))
    judged = fits.groupBy(*line, "b_pos", "slots", "exact").agg(F.every("fits").alias("counts"))
    lines = judged.groupBy(*line).agg(
        F.collect_set(F.when(F.col("counts"), F.col("b_pos"))).alias("places"),
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("b_pos")))).alias("kept"), F.every("exact").alias("same"))
    # In sorted distinct places, the place run - 1 further on is run - 1 higher only if none between is missing.
    starts = F.sequence(F.lit(1), F.size("kept") - (run - 1))
    unbroken = F.exists(starts, lambda i: F.element_at("kept", i + (run - 1)) - F.element_at("kept", i) == run - 1)
    lines = lines.where(F.size("places") > 0).withColumn("long_run", F.when(F.size("kept") >= run, unbroken).otherwise(False))
    places = F.transform("places", lambda p: F.struct(F.col("shift"), p.alias("pos")))
    return lines.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long").alias("matched"), F.every("same").alias("verbatim"),
        F.some("long_run").alias("long_run"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; null ids and repeated rows stay as they are.

    Rows with one doc_id go or stay together; an empty table of either kind drops nothing.
    """
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked_id"]), "left_anti")


def op8_benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` of the benchmark in the documents; nulls, ties, repeats, short and very long texts as there."""
    return leaks(docs, benchmark)
