"""Fill-in-middle documents, cut by one regular expression with counted quantifiers; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import text_of

# A line with its line feed, or the last one without. Possessive, so no line is ever tried twice.
LINE = r"(?:[^\n]*+\n|[^\n]++)"
MARKS = ("<P>", "<S>", "<M>")


def _draws(seed: int, key: Column, count: int) -> list[Column]:
    """Unsigned 32-bit numbers from the SHA-256 of ``seed:key``, eight hex digits each."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, unit: str = LINE) -> DataFrame:
    """One row per document row: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n units (lines), matched left to right. Two draws from the document's id choose how many
    units a and b >= a the prefix and the prefix with the middle take; one match of ``(unit{a})(unit{b-a})(rest)``,
    each counted group possessive, captures the three parts and writes them in their new order. The counted
    groups run as loops, so a text may have any number of units, and no place is tried twice. ``unit`` is a
    regular expression whose matches cover any text without gaps.

    form is psm (``<P>``prefix``<S>``suffix``<M>``middle), spm (``<S>``suffix``<P>``prefix``<M>``middle) or plain
    (the text itself): empty texts, texts that hold a mark, and those beyond ``fim_percent``. The two lengths
    (code points) are null for plain. Null text counts as empty, a null id as the empty string; rows that
    repeat an id and a text give equal rows. Parts may be empty, also when both draws are equal. Other columns
    are ignored, so their names may clash.
    """
    h1, h2, h3, h4 = _draws(seed, F.col("doc_id"), 4)
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.withColumn("n", F.call_function("regexp_count", "text", F.lit(unit)).cast("long"))
    has_mark = F.lit(False)
    for mark in MARKS:
        has_mark = has_mark | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | has_mark | (h3 % 100 >= fim_percent)
    rows = rows.select("doc_id", "text", "n", (h1 % (F.col("n") + 1)).alias("c1"), (h2 % (F.col("n") + 1)).alias("c2"),
                       F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    first, last = F.least("c1", "c2"), F.greatest("c1", "c2")
    pattern = F.concat(F.lit(rf"\A({unit}{{"), first.cast("string"), F.lit(rf"}}+)({unit}{{"), (last - first).cast("string"),
                       F.lit(r"}+)((?s:.*+))\z"))
    order = F.when(F.col("form") == "psm", "<P>$1<S>$3<M>$2").otherwise("<S>$3<P>$1<M>$2")
    rows = rows.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.call_function("regexp_replace", "text", pattern, order)).alias("output"))
    p, s, m = (F.instr("output", mark) for mark in MARKS)
    size = F.length("output")
    prefix = F.when(F.col("form") == "psm", s - p - 3).when(F.col("form") == "spm", m - p - 3)
    middle = F.when(F.col("form") != "plain", size - m - 2)
    return rows.select("doc_id", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. A mark never stands in a part, so its first place is the mark."""
    p, s, m = (F.instr(output, mark) for mark in MARKS)

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start + 3, end - start - 3)

    end = F.length(output) + 1
    return (F.when(form == "psm", F.concat(between(p, s), between(m, end), between(s, m)))
            .when(form == "spm", F.concat(between(p, m), between(m, end), between(s, p))).otherwise(output))


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """The cut documents with digests of the output and of the text restored from it; see ``fill_in_middle``."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, string_split(text, chr(10)) AS parts, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), l AS (
  SELECT *, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS n FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l
), p AS (
  SELECT *, array_to_string(parts[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(parts) THEN chr(10) ELSE '' END AS prefix,
    array_to_string(parts[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(parts) THEN chr(10) ELSE '' END AS head FROM c
), q AS (
  SELECT *, substr(head, length(prefix) + 1) AS middle, substr(text, length(head) + 1) AS suffix FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM q
"""
