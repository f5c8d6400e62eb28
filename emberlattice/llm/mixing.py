"""Mixing sources to target weights by iterative proportional fitting of token weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import GAP_CLASS, fraction_of, store, text_of

# A document's topic is the first rule whose pattern it holds, else the last name.
TOPICS = (("licence", "[Ll]icensed under"), ("contact", "@[A-Za-z0-9-]+[.]"), ("table", " [|] "), ("records", "[0-9]"))
REST_TOPIC = "prose"
LANGUAGES = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}
REST_LANGUAGE = "other"


@dataclass(frozen=True)
class MixTargets:
    """Marginals: sources and topics by tempered token shares, languages by given shares.

    ``tokens ** temperature`` flattens a share. Languages outside the table form one more class; it gets
    ``rest`` and the given shares are scaled to the classes that have tokens.
    """

    source_temperature: float = 0.5
    topic_temperature: float = 0.7
    languages: tuple[tuple[str, float], ...] = tuple(LANGUAGES.items())
    rest: float = 0.02
    token_share: float = 0.5
    rounds: int = 20

    def language_shares(self) -> dict[str, float]:
        return {**dict(self.languages), REST_LANGUAGE: self.rest}


def topic_of(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in TOPICS], F.lit(REST_TOPIC))


def language_of(lang: Column, targets: MixTargets) -> Column:
    return F.when(lang.isin([name for name, _ in targets.languages]), lang).otherwise(F.lit(REST_LANGUAGE))


def classify(docs: DataFrame, targets: MixTargets) -> DataFrame:
    """Add topic, mix_lang and n_tokens (words)."""
    text = text_of()
    return docs.withColumns({"topic": topic_of(text), "mix_lang": language_of(F.col("lang"), targets),
                             "n_tokens": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")})


def normalised(parts: dict[str, float]) -> dict[str, float]:
    total = sum(parts.values())
    return {k: v / total if total else 0.0 for k, v in parts.items()}


def pick(value: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(float(v))) for k, v in table.items()], F.lit(0.0))


def rake(classified: DataFrame, targets: MixTargets) -> tuple[DataFrame, dict[str, float], dict[str, float], float]:
    """Factors of the raked weights: (source, factor) rows, language factors, topic factors, tokens.

    A cell's weight is its tokens times its three factors. Sources are many and stay a table, one row
    each with its tokens by language and topic, whose numbers the parameters bound. A round is one pass
    over it: each source's factor follows from its own row, and only sums by language and topic, a fixed
    number of values, come to the driver.
    """
    langs, topics = list(targets.language_shares()), [name for name, _ in TOPICS] + [REST_TOPIC]
    cells = [(lang, topic, f"c{i}_{j}") for i, lang in enumerate(langs) for j, topic in enumerate(topics)]
    sums = [F.sum(F.when((F.col("mix_lang") == a) & (F.col("topic") == t), F.col("n_tokens")).otherwise(0)).cast("double").alias(c)
            for a, t, c in cells]
    wide = classified.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("tokens"), *sums)
    wide = store(wide.withColumn("target", F.pow("tokens", F.lit(targets.source_temperature))))
    first = wide.agg(F.sum("tokens").alias("tokens"), F.sum("target").alias("target"), *[F.sum(c).alias(c) for *_, c in cells]).first()
    mass = {(a, t): first[c] or 0.0 for a, t, c in cells}
    by_lang = {a: sum(mass[a, t] for t in topics) for a in langs}
    by_topic = {t: sum(mass[a, t] for a in langs) for t in topics}
    want_lang = normalised({a: s if by_lang[a] else 0.0 for a, s in targets.language_shares().items()})
    want_topic = normalised({t: n**targets.topic_temperature for t, n in by_topic.items()})
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def factor():
        inner = reduce(lambda x, y: x + y, [F.col(name) * F.lit(b[a] * c[t]) for a, t, name in cells])
        return F.when(inner > 0, F.col("target") / F.lit(first["target"] or 1.0) / inner).otherwise(F.lit(0.0))

    for _ in range(targets.rounds if first["tokens"] else 0):
        row = wide.withColumn("a", factor()).agg(*[F.sum(F.col(name) * F.col("a")).alias(name) for *_, name in cells]).first()
        mass = {(a, t): row[name] for a, t, name in cells}
        sums_lang = {a: sum(mass[a, t] * c[t] for t in topics) for a in langs}
        b = {a: want_lang[a] / sums_lang[a] if sums_lang[a] else 0.0 for a in langs}
        sums_topic = {t: sum(mass[a, t] * b[a] for a in langs) for t in topics}
        c = {t: want_topic[t] / sums_topic[t] if sums_topic[t] else 0.0 for t in topics}
    return wide.select(F.col("source").alias("mix_source"), factor().alias("mix_factor")), b, c, first["tokens"] or 0.0


def sample_mix(docs: DataFrame, classified: DataFrame, targets: MixTargets = MixTargets()) -> DataFrame:
    """The documents to train on: the columns of ``docs`` plus topic, n_tokens, rate and copies.

    ``classified`` holds doc_id, source, mix_lang, topic and n_tokens of the same rows and fixes the
    rates; ``docs`` holds at least those columns. A document's rate is its expected number of copies, so
    that the mix has about ``token_share`` of all tokens at the target marginals; rates over 1 repeat
    documents. The draw is a hash of doc_id: repeated rows share it. Null source is a source, null or
    other languages are one class, null text has no tokens; a source without tokens has rate 0.
    """
    factors, b, c, tokens = rake(classified, targets)
    joined = docs.join(factors, F.col("source").eqNullSafe(F.col("mix_source")))
    rate = F.lit(tokens * targets.token_share) * F.col("mix_factor") * pick(F.col("mix_lang"), b) * pick(F.col("topic"), c)
    drawn = joined.withColumn("rate", F.round(rate, 6)).withColumn(
        "copies", (F.floor("rate") + F.when(fraction_of("mix", F.col("doc_id")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("bigint"))
    return drawn.where(F.col("copies") > 0).drop("mix_source", "mix_factor", "mix_lang")


def mix_documents(docs: DataFrame, targets: MixTargets = MixTargets()) -> DataFrame:
    """``sample_mix`` of whole documents; input columns named like an added one are replaced."""
    slim = store(classify(docs.select("doc_id", "source", "lang", "text"), targets).drop("text", "lang"))
    return sample_mix(classify(docs, targets), slim, targets)


def op4_source_mix(docs: DataFrame, targets: MixTargets = MixTargets()) -> DataFrame:
    """One row per drawn document: doc_id, source, lang class, topic, tokens, rate and copies."""
    slim = store(classify(docs.select("doc_id", "source", "lang", "text"), targets).drop("text", "lang"))
    slim = slim.withColumn("language", F.col("mix_lang"))
    return sample_mix(slim, slim, targets).select("doc_id", "source", "language", "topic", "n_tokens", "rate", "copies")


def _sql(targets: MixTargets = MixTargets()) -> str:
    topic = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    langs = ", ".join(f"'{k}'" for k, _ in targets.languages)
    shares = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in targets.language_shares().items())
    steps = f"""
slim AS MATERIALIZED (SELECT doc_id, source, CASE WHEN lang IN ({langs}) THEN lang ELSE '{REST_LANGUAGE}' END AS language,
  CASE {topic} ELSE '{REST_TOPIC}' END AS topic,
  CAST(len(list_filter(string_split_regex(t, '{GAP_CLASS}+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (SELECT coalesce(source, '\x01') AS s, language AS l, topic AS k, sum(n_tokens)::DOUBLE AS n FROM slim GROUP BY ALL),
ts AS MATERIALIZED (SELECT s, x / sum(x) OVER () AS want FROM (SELECT s, pow(sum(n), {targets.source_temperature}) AS x FROM cells GROUP BY 1)),
tl AS MATERIALIZED (SELECT l, x / sum(x) OVER () AS want FROM (SELECT l, share AS x FROM (VALUES {shares}) v(l, share)
  WHERE l IN (SELECT l FROM cells WHERE n > 0))),
tk AS MATERIALIZED (SELECT k, x / sum(x) OVER () AS want FROM (SELECT k, pow(sum(n), {targets.topic_temperature}) AS x FROM cells GROUP BY 1)),
b0 AS MATERIALIZED (SELECT DISTINCT l, 1.0::DOUBLE AS f FROM cells), c0 AS MATERIALIZED (SELECT DISTINCT k, 1.0::DOUBLE AS f FROM cells)"""
    for i in range(targets.rounds + 1):
        steps += f""",
a{i} AS MATERIALIZED (SELECT s, CASE WHEN m > 0 THEN want / m ELSE 0 END AS f FROM ts JOIN (
  SELECT s, sum(n * b.f * c.f) AS m FROM cells JOIN b{i} b USING (l) JOIN c{i} c USING (k) GROUP BY 1) USING (s))"""
        if i < targets.rounds:
            steps += f""",
b{i + 1} AS MATERIALIZED (SELECT l, CASE WHEN m > 0 THEN coalesce(want, 0) / m ELSE 0 END AS f FROM (
  SELECT l, sum(n * a.f * c.f) AS m FROM cells JOIN a{i} a USING (s) JOIN c{i} c USING (k) GROUP BY 1) LEFT JOIN tl USING (l)),
c{i + 1} AS MATERIALIZED (SELECT k, CASE WHEN m > 0 THEN want / m ELSE 0 END AS f FROM (
  SELECT k, sum(n * a.f * b.f) AS m FROM cells JOIN a{i} a USING (s) JOIN b{i + 1} b USING (l) GROUP BY 1) JOIN tk USING (k))"""
    n = targets.rounds
    return f"""WITH {steps}
SELECT doc_id, source, language, topic, n_tokens, rate, copies FROM (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM (
    SELECT slim.*, round((SELECT sum(n) FROM cells) * {targets.token_share} * a.f * b.f * c.f, 6) AS rate,
      CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS u
    FROM slim JOIN a{n} a ON a.s = coalesce(source, '\x01') JOIN b{n} b ON b.l = language JOIN c{n} c ON c.k = topic))
WHERE copies > 0"""


OP4_SQL = _sql()
