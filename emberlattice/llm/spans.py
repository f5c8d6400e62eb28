"""Match positions and span lists as columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlattice.llm.common import let

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, hit, value), in code points.

    Positions are running sums over the pieces between the matches, so only built-in functions are
    used. Texts without a match cost one search.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    rows = F.zip_with(F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("gap"), h.alias("hit"))), values,
                      lambda a, v: F.struct(a["gap"].alias("gap"), a["hit"].alias("hit"), v.alias("value")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,value:string>>")

    def step(acc, row):
        start = acc["at"] + row["gap"]
        end = start + F.length(row["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), row["hit"].alias("hit"), row["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(row["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found)))
                        .alias("out"))

    walked = F.aggregate(rows, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)
    return F.when(text.rlike(pattern), walked["out"]).otherwise(empty)


def as_spans(found: Column, kind: str, rank: int) -> Column:
    """Matches as spans that sort by start, then by the kind's rank."""
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def joined(spans: Column) -> Column:
    """``kind:start:end`` in the array's order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clear_of(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of ``taken``."""
    return let(taken, lambda taken: F.filter(
        spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))))


def replaced(text: Column, spans: Column, label: str = "[{}]") -> Column:
    """The text with each span, overlapping ones together, replaced by a mark naming its kind."""
    before, after = label.split("{}")

    def step(acc, s):
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit(before), s["kind"], F.lit(after))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, mark)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(F.sort_array(spans), start, step)
    rest = text.substr((walked["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(walked["out"], rest)).otherwise(text)
