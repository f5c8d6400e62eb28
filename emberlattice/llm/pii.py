"""Personal data: fixed patterns, and more spans by weak supervision.

Labelers (shape, validity, gazetteer, contexts, surroundings) vote on candidate spans. Expectation-
maximisation over the counted vote patterns estimates how reliable each labeler is, and its posterior
trains the span classifier that decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import store

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("name", "masked_email", "local_phone", "id_number", "iban")
LABELERS = ("shape", "valid", "gazetteer", "asked", "denied", "surroundings")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# Possessive runs from the first digit of a run: the leftmost matches, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Given names, endings of domains, and words of the contexts.
GIVEN = frozenset(("Alice Anna Bob Carol Charles Daniel David Emily Emma Frank George Grace Hans Helen Henry Jack James Jane Jean John "
                   "Jose Julia Karl Laura Linda Lisa Lucy Maria Mark Martin Mary Michael Olivia Patricia Paul Peter Pierre Robert Sarah "
                   "Sophie Susan Thomas Tom William").split())
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
ASKED = re.compile(r"(?:call|phone|tel|mobile|fax|contact|mail|reach|write|name is|named|signed|dear|mr|mrs|ms|dr|ssn|social security|"
                   r"passport|account|iban)\W{0,3}(?:\w+\W{1,2}){0,2}$", re.I)
DENIED = re.compile(r"(?:version|isbn|issn|page|figure|fig|table|chapter|order|item|model|part|invoice|price|total|[$€£#])\W{0,3}$", re.I)
NAME = re.compile(r"\b[A-Z][a-z]{1,15} [A-Z][a-z]{1,20}\b")
MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b", re.I)
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
ID_NUMBER = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost e-mail addresses: each @ takes the local characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the fixed patterns, ordered by kind, then start."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(extra kind's place, start, end) of spans worth a vote."""
    for m in NAME.finditer(text):
        first = m[0].split(" ")[0]
        if first in GIVEN or ASKED.search(text, max(0, m.start() - 40), m.start()):
            yield 0, m.start(), m.end()
    if re.search(r"[ \[(]dot[ \])]", text, re.I):
        for m in MASKED.finditer(text):
            yield 1, m.start(), m.end()
    if DIGIT.search(text):
        for kind, pattern in ((2, LOCAL_PHONE), (3, ID_NUMBER), (4, IBAN)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """One vote for each labeler: 1 personal, -1 not, 0 abstains."""
    hit = text[start:end]
    digits = re.sub(r"[^0-9]", "", hit)
    shape = valid = gazetteer = 0
    if kind == 0:
        gazetteer = 1 if hit.split(" ")[0] in GIVEN else -1
        shape = 1 if start and text[start - 1] == " " and text[start - 2:start - 1].islower() else 0
    elif kind == 1:
        ending = re.split(r"[^A-Za-z]+", hit)[-1].lower()
        gazetteer = 1 if ending in ENDINGS else -1
        shape = 1 if re.search(r"[\[(]at[\])]", hit, re.I) else -1
    elif kind == 2:
        shape = 1 if hit.startswith("(") or hit.count("-") == 2 else 0
        valid = 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    elif kind == 3:
        valid = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    else:
        code = re.sub(" ", "", hit)
        valid = 1 if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else -1
    asked = 1 if ASKED.search(text, max(0, start - 40), start) else 0
    denied = -1 if DENIED.search(text, max(0, start - 24), start) else 0
    joined = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "-.+")) or text[end:end + 1].isalnum()
    return shape, valid, gazetteer, asked, denied, -1 if joined else 0


def pattern_of(text: str, kind: int, start: int, end: int) -> str:
    """Kind, votes and a few coarse features as one text; only these enter the classifier."""
    hit = text[start:end]
    length = min((end - start) // 8, 5)
    share = sum(c.isdigit() for c in hit) * 4 // (end - start)
    return ",".join(map(str, (kind, *votes(text, kind, start, end), length, share)))


SPANS = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
EXTRAS = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pattern", pa.string())]))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, extra = [], []
        for text in batch.column(1).to_pylist():
            known = base_spans(text) if text else []
            base.append([(k, a, b, BASE_KINDS[k]) for k, a, b in known])
            new, taken = [], [(a, b) for _, a, b in known]
            for kind, a, b in candidates(text) if text else ():
                if not any(a < d and c < b for c, d in taken):
                    new.append((10 + kind, a, b, EXTRA_KINDS[kind], pattern_of(text, kind, a, b)))
                    taken.append((a, b))
            extra.append(new)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[dict(zip(("rank", "start", "end", "kind"), s)) for s in r] for r in base], SPANS),
             pa.array([[dict(zip(("rank", "start", "end", "kind", "pattern"), s)) for s in r] for r in extra], EXTRAS)],
            names=["doc_id", "base", "extra"])


def estimate_reliabilities(votes_table: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Two-class EM over distinct vote rows: posteriors, P(vote | class) by labeler, class share.

    The start is the share of positive votes, so that class 1 is the one the labelers mean; one added
    count for each cell keeps rare votes finite.
    """
    onehot = np.stack([votes_table == v for v in (-1, 0, 1)], axis=2).astype(float)
    cast = np.maximum((votes_table != 0).sum(1), 1)
    post = 0.5 + 0.45 * votes_table.sum(1) / cast
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        share = (w[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cn,njv->cjv", w, onehot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        loglik = np.einsum("njv,cjv->cn", onehot, np.log(table))
        odds = loglik[1] - loglik[0] + math.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return post, table, share


def train_span_classifier(patterns: list[tuple[str, int]], penalty: float = 1.0, steps: int = 30) -> dict[str, float]:
    """Probability of being personal data for each counted pattern, by logistic regression on EM posteriors."""
    if not patterns:
        return {}
    patterns = sorted(patterns)
    rows = np.array([[int(v) for v in p.split(",")] for p, _ in patterns])
    counts = np.array([n for _, n in patterns], dtype=float)
    target = np.zeros(len(rows))
    for kind in np.unique(rows[:, 0]):
        own = rows[:, 0] == kind
        target[own] = estimate_reliabilities(rows[own, 1:1 + len(LABELERS)], counts[own])[0]
    columns = [np.ones(len(rows))]
    for j in range(rows.shape[1]):
        columns += [(rows[:, j] == v).astype(float) for v in np.unique(rows[:, j])]
    x, w = np.stack(columns, axis=1), np.zeros(len(columns))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + penalty * w
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    scores = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {p: float(s) for (p, _), s in zip(patterns, scores)}


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, base, extra; arrays of (rank, start, end, kind).

    Null text counts as empty; repeated rows each get their spans; other columns are ignored, so their
    names may clash. Extra spans overlap neither base spans nor each other. Candidates are counted over
    all documents by pattern; a pattern has nine small values, so at most 5 * 3^6 * 6 * 5 counts, in
    practice dozens, come to the driver. Nothing is shuffled by document.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base array<struct<rank:int,start:bigint,end:bigint,kind:string>>, "
              "extra array<struct<rank:int,start:bigint,end:bigint,kind:string,pattern:string>>")
    scanned = store(rows.mapInArrow(scan_batches, schema))
    counted = scanned.select(F.explode("extra.pattern").alias("pattern")).groupBy("pattern").count().collect()
    chances = train_span_classifier([(r["pattern"], r["count"]) for r in counted])
    accepted = F.array(*[F.lit(p) for p, s in sorted(chances.items()) if s >= threshold]).cast("array<string>")
    kept = F.filter("extra", lambda e: F.array_contains(accepted, e["pattern"]))
    return scanned.select("doc_id", "base", F.transform(kept, lambda e: F.struct(
        e["rank"].alias("rank"), e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"))).alias("extra"))


def op3_personal_data(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)

    def joined(spans):
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "extra")).alias("spans"))
