"""Host-level quality rules: failure rates by host, shrunk with an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import GAPS, GAP_CLASS, let, store, text_of, words_of

# Rule name -> (a * numerator > limit * denominator), or the count below which it fails.
MIN_WORDS = 50
RATIO_RULES = {
    "repeats": ("n_repeat_words", 50, "n_words"),
    "symbols": ("n_symbols", 10, "word_chars"),
    "duplicate_lines": ("n_dup_lines", 30, "n_lines"),
}


def repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more among ``words``.

    Windows are compared by a 64-bit hash. Only if some window repeats are they sorted with their
    places; the places of repeated ones, in order, then give the covered words.
    """
    def covered(placed):
        twin = F.filter(placed, lambda p, k: (p["h"] == F.get(placed, k - 1)["h"]) | (p["h"] == F.get(placed, k + 1)["h"]))
        places = F.sort_array(F.transform(twin, lambda p: p["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda acc, p: F.struct((acc["n"] + F.least(p - acc["at"], F.lit(3))).alias("n"), p.alias("at")),
            lambda acc: acc["n"].cast("bigint"))

    def windows_of(words):
        three = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
        return F.transform(three, lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))

    def counted(windows):
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(repeated, let(placed, covered)).otherwise(F.lit(0).cast("bigint"))

    return let(let(words, windows_of), counted)


def count_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    whole = text_of(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({"_words": words_of(whole), "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.translate(whole, GAPS, "")).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("_words")),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rule_failures() -> dict[str, Column]:
    """Rule name -> whether a counted document fails it."""
    ratios = {name: 100 * F.col(a) > limit * F.col(b) for name, (a, limit, b) in RATIO_RULES.items()}
    return {"short": F.col("n_words") < MIN_WORDS, **ratios}


def host_verdicts(counted: DataFrame, host: str = "host", max_rate: float = 0.5) -> DataFrame:
    """One row per host: host, host_kept, worst_rate.

    For each rule the hosts' failure rates give a beta prior by the method of moments; a host's rate is then
    (failures + a) / (documents + a + b). Small hosts differ by chance alone, so the binomial part of their spread is
    taken off: between = (sum n(p-m)^2 - (hosts-1)m(1-m)) / (N - sum n^2/N), not below 0. A host is kept if no
    shrunk rate exceeds ``max_rate``; a rate equal to it is kept. If hosts differ no more than by chance, all have the mean rate.
    Rows are combined before the shuffle, so a hot host is one row per task.
    """
    rules = rule_failures()
    sums = [F.sum(F.when(failed, 1).otherwise(0)).alias(f"fails_{name}") for name, failed in rules.items()]
    per_host = counted.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = per_host.select(host, "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"fails_{name}").alias("fails")) for name in rules])).alias("cell"))
    cells = cells.select(host, "n", "cell.rule", "cell.fails")
    # Weighted moments from whole-number sums: mean = F/N, sum n(p-m)^2 = sum f*f/n - F*F/N.
    moments = cells.groupBy("rule").agg(
        F.sum("n").alias("docs"), F.sum("fails").alias("failed"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("fails") * F.col("fails") / F.col("n")).alias("squares"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("sizes"))
    mean = F.col("failed") / F.col("docs")
    noise = (F.col("hosts") - 1) * mean * (1 - mean)
    between = F.try_divide(F.col("squares") - F.col("docs") * mean * mean - noise, F.col("docs") - F.col("sizes") / F.col("docs"))
    prior = moments.select(F.col("rule").alias("prior_rule"), mean.alias("mean"), F.when(
        between > 1e-12, F.greatest(mean * (1 - mean) / between - 1, F.lit(0.0))).alias("weight"))
    # One row per rule, whatever the input: always small enough to broadcast.
    joined = cells.join(F.broadcast(prior), F.col("rule") == F.col("prior_rule"))
    rate = F.coalesce((F.col("fails") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight")), F.col("mean"))
    return joined.groupBy(host).agg(F.max(rate).alias("worst_rate")).withColumn("host_kept", F.col("worst_rate") <= max_rate)


def host_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
               max_rate: float = 0.5) -> DataFrame:
    """One row per document row: key, counts, base_failed, host_kept, kept.

    kept is false for a document that fails the base rules or whose host is rejected. Null text counts as
    no words; null hosts are one host of their own. Other columns are ignored, so their names may clash.
    Repeated rows count each. The counts, a few numbers a row, are stored once; the verdicts join them on
    the host, where Spark splits a hot host.
    """
    counted = count_text(docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")))
    counted = store(counted.drop("text"))
    verdicts = host_verdicts(counted, "host", max_rate).withColumnRenamed("host", "judged_host")
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("judged_host")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "host_kept", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def op2_host_rules(docs: DataFrame) -> DataFrame:
    """``host_rules`` of the documents, hosts being their sources; nulls, ties, repeats and clashing names as there."""
    return host_rules(docs)


_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{GAP_CLASS}+'), lambda w: w <> '')"
OP2_SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
windows AS (SELECT row_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS win FROM (
  SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT *, row_number() OVER () AS row_id FROM base))),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest([i, i+1, i+2]) AS j FROM twice) GROUP BY 1),
counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, row_number() OVER () AS row_id FROM base) LEFT JOIN covered USING (row_id)),
docs AS (
  SELECT doc_id, source, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [CAST(n_words < 50 AS INT), CAST(100 * n_repeat_words > 50 * n_words AS INT),
     CAST(100 * n_symbols > 10 * coalesce(wc, 0) AS INT), CAST(100 * n_dup_lines > 30 * n_lines AS INT)] AS f FROM counted),
cells AS (SELECT source, r, count(*) AS n, CAST(sum(f[r]) AS DOUBLE) AS fails
  FROM docs CROSS JOIN range(1, 5) x(r) GROUP BY 1, 2),
between AS (SELECT r, m, (s - d * m * m - (h - 1) * m * (1 - m)) / nullif(d - q / d, 0) AS b
  FROM (SELECT r, CAST(sum(n) AS DOUBLE) AS d, count(*) AS h, sum(fails) / sum(n) AS m, sum(fails * fails / n) AS s, sum(CAST(n AS DOUBLE) * n) AS q
    FROM cells GROUP BY 1)),
prior AS (SELECT r, m, CASE WHEN b > 1e-12 THEN greatest(m * (1 - m) / b - 1, 0) END AS k FROM between),
hosts AS (SELECT source AS host, max(coalesce((fails + m * k) / (n + k), m)) <= 0.5 AS host_kept
  FROM cells JOIN prior USING (r) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_kept,
  NOT base_failed AND host_kept AS kept
FROM docs JOIN hosts ON source IS NOT DISTINCT FROM host
"""
