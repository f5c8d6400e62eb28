"""Secret scans: patterns and sliding-window entropy, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import let, text_of
from emberlattice.llm.spans import as_spans, clear_of, joined, matches, no_spans, replaced

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
# Character classes of the entropy scan: name, alphabet, least bits in a window.
CLASSES = (
    ("entropy_hex", "0123456789ABCDEF", 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9),
)
# Candidates that are no secrets whatever their entropy: UUIDs, slugs and paths of words, one case
# of letters without digits, repeated examples. An example word speaks only for its path segment: the
# last pattern takes a candidate if every segment holds one or is harmless by the other rules.
EXAMPLE = r"(?i:example|placeholder|xxxx|abcdef0?123|0123456789abcdef)"
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]?[a-z]*([-_/][A-Za-z]?[a-z]*)*$",
    r"^(?:[^0-9A-Z]*|[^0-9a-z]*)$",
    r"^[^A-Za-z]*$",
    rf"^(?=.*{EXAMPLE})(?!(?:.*/)?(?![^/]*{EXAMPLE}|(?:[A-Za-z]?[a-z]*(?:[-_][A-Za-z]?[a-z]*)*|[^0-9A-Z/]*|[^0-9a-z/]*|[^A-Za-z/]*)(?:/|$))[^/]+)",
)


def entropy_range(candidate: Column, alphabet: str, bits: float, width: int) -> Column:
    """(first, last) of the code points under windows of at least ``bits``; nulls if there is none.

    One walk over the characters, cut apart once, keeps the sum of c*log2(c) over the last ``width`` of them.
    A step changes two counts, read from a slice of the last characters, so its cost does not depend on the string's
    length. A character outside the alphabet empties the window.
    """
    codes = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(alphabet)))
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    state = "struct<total:double,filled:int,at:int,first:int,last:int>"

    def step(codes, acc, code):
        def weight(n):
            return F.element_at(plogp, n + 1)

        def moved(window):
            """The sum after the window's first character, if it is full, has given way to the new one."""
            full = acc["filled"] >= width
            gone = F.when(full, F.get(window, F.lit(0))).otherwise(F.lit(0))
            new = F.size(F.filter(window, lambda c: c == code))
            old = F.size(F.filter(window, lambda c: c == gone))
            added = weight(new + 1) - weight(new)
            left = F.when(full, weight(old) - weight(F.greatest(old - 1, F.lit(0)))).otherwise(0.0)
            return F.when(gone == code, acc["total"]).otherwise(acc["total"] + added - left)

        def inside(total):
            filled = F.least(acc["filled"] + 1, F.lit(width))
            high = (filled >= width) & (F.lit(math.log2(width)) - total / width >= bits)
            at = acc["at"] + 1
            return F.struct(
                total.alias("total"), filled.alias("filled"), at.alias("at"),
                F.when(high, F.coalesce(acc["first"], at - width)).otherwise(acc["first"]).alias("first"),
                F.when(high, at).otherwise(acc["last"]).alias("last")).cast(state)

        outside = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("filled"), (acc["at"] + 1).alias("at"),
                           acc["first"].alias("first"), acc["last"].alias("last")).cast(state)
        window = F.slice(codes, acc["at"] - acc["filled"] + 1, acc["filled"])
        return F.when(code > 0, let(let(window, moved), inside)).otherwise(outside)

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("filled"), F.lit(0).alias("at"),
                     none.alias("first"), none.alias("last")).cast(state)
    return let(codes, lambda codes: F.aggregate(
        codes, start, lambda acc, code: step(codes, acc, code),
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def entropy_spans(text: Column, width: int = 24, classes=CLASSES, allowed=ALLOWED) -> Column:
    """Spans of high-entropy stretches in long unbroken strings, allow-listed strings left out."""
    found = matches(text, CANDIDATE.replace("24", str(width)))
    if allowed:
        harmless = "|".join(f"(?:{p})" for p in allowed)
        found = F.filter(found, lambda m: ~m["hit"].rlike(harmless))

    def scan(name, alphabet, bits, rank):
        def one(m):
            hit = F.upper(m["hit"]) if alphabet.isupper() else m["hit"]
            r = entropy_range(hit, alphabet, bits, width)
            return F.struct((m["start"] + r["first"]).alias("start"), F.lit(rank).alias("rank"),
                            (m["start"] + r["last"]).alias("end"), F.lit(name).alias("kind"))
        return one

    spans = no_spans()
    for rank, (name, alphabet, bits) in enumerate(classes, start=10):
        own = F.filter(F.transform(found, scan(name, alphabet, bits, rank)), lambda s: s["start"].isNotNull())
        spans = F.concat(spans, clear_of(own, spans))
    return F.when(text.rlike(CANDIDATE.replace("24", str(width))), spans).otherwise(no_spans())


def find_secrets(docs: DataFrame, text: str = "text", width: int = 24, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """Add ``assign_spans``, ``access_spans``, ``hex_spans``, ``entropy_spans``: arrays of spans.

    Row by row, without a shuffle. Null text counts as empty. Repeated rows each get their spans. A
    column of the input with one of the four names is replaced. Entropy spans never overlap the
    pattern spans, which stay as they are. Work grows with the square of the spans in one text.
    """
    whole = text_of(text)
    assign = F.filter(matches(whole, ASSIGN, 2), lambda m: F.length(m["value"]) >= 12)
    out = docs.withColumns({
        "assign_spans": as_spans(assign, "assign", 0),
        "access_spans": as_spans(matches(whole, ACCESS), "access", 1),
        "hex_spans": as_spans(matches(whole, HEX), "hex", 2),
        "entropy_spans": entropy_spans(whole, width, classes, allowed),
    })
    known = F.concat("assign_spans", "access_spans", "hex_spans")
    return out.withColumn("entropy_spans", clear_of(F.col("entropy_spans"), known))


def redact_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every secret in ``text`` replaced by a mark; null and empty texts stay.

    Overlapping spans get one mark. Other columns, repeated rows and their order of columns stay as they are.
    """
    found = find_secrets(docs, text, **options)
    every = F.concat("assign_spans", "access_spans", "hex_spans", "entropy_spans")
    cleaned = found.withColumn(text, F.when(F.col(text).isNotNull(), replaced(F.col(text), every)))
    return cleaned.select(*docs.columns)


def op6_secret_scans(docs: DataFrame) -> DataFrame:
    """The scan's digest per document row."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.sort_array(F.concat("assign_spans", "access_spans", "hex_spans"))
    return found.select(
        "doc_id",
        F.size("assign_spans").cast("bigint").alias("n_assign"),
        F.size("access_spans").cast("bigint").alias("n_access"),
        F.size("hex_spans").cast("bigint").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat(base, "entropy_spans"))).alias("spans"),
    )
