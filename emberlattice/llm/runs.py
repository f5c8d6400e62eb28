"""Runs of repeated words, found by exact block convolution at dyadic scales.

Words are numbers. At the scale of blocks of B words, every aligned block is compared with all windows that
start B to 2B-1 words further on: the sum of squared differences of a block and all its windows is one cyclic
correlation, computed exactly modulo a prime by a number-theoretic transform. A sum of zero is an occurrence of
the block; its distance is a seed, extended to both sides. A run of period q in [B, 2B) and at least 3q words
holds a whole aligned block and its occurrence at distance q, so no run is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import sliced, text_of, words_of

PRIME = 15 * 2**27 + 1
_P = np.uint64(PRIME)
_ROOT = 31  # a generator of the numbers modulo PRIME
_LOW = 32
_U = np.uint64
GROUP_WORDS = 1 << 17
MOST_WORDS = 3 << 27  # periods below 2^27 have transforms of at most 2^27 places, which the prime allows


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2p to x mod p: the difference wraps round where x is below p."""
    return np.minimum(x, x - _P)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), dtype=_U)
    done, step = 1, base % PRIME
    while done < count:
        take = min(done, count - done)
        out[done:done + take] = out[:take] * _U(step) % _P
        done += take
        step = step * step % PRIME
    return out


class Transform:
    """The transform of ``size`` places (a power of two) over the rows of a table, and its inverse.

    The forward one leaves its places in bit-reversed order, the inverse takes them so. Products with the fixed
    roots use a rounded quotient instead of a division.
    """

    def __init__(self, size: int):
        self.size = size
        root = pow(_ROOT, (PRIME - 1) // size, PRIME)
        self.stages = []
        for width in (size >> k for k in range(size.bit_length() - 1)):
            steps = _powers(pow(root, size // width, PRIME), width // 2)
            back = _powers(pow(pow(root, -1, PRIME), size // width, PRIME), width // 2)
            self.stages.append((width, *((w, (w << _U(_LOW)) // _P) for w in (steps, back))))
        order = np.zeros(1, dtype=np.int64)
        while len(order) < size:
            order = np.concatenate([order * 2, order * 2 + 1])
        place = np.empty(size, dtype=np.int64)
        place[order] = np.arange(size)
        self.negative = place[-order % size]  # where the place of -k lies, for each k in the transform's order
        self.odd = order % 2 == 1
        self.scale = _U(pow(size, -1, PRIME))

    @staticmethod
    def _times(x: np.ndarray, root: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return _reduced(x * root[0] - ((x * root[1]) >> _U(_LOW)) * _P)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for width, root, _ in self.stages:
            parts = x.reshape(len(x), -1, 2, width // 2)
            a, b = parts[:, :, 0], parts[:, :, 1]
            total, rest = _reduced(a + b), _reduced(a + (_P - b))
            x = np.stack([total, self._times(rest, root)], axis=2).reshape(len(x), -1)
        return x

    def inverse(self, x: np.ndarray) -> np.ndarray:
        for width, _, root in reversed(self.stages):
            parts = x.reshape(len(x), -1, 2, width // 2)
            a, b = parts[:, :, 0], self._times(parts[:, :, 1], root)
            x = np.stack([_reduced(a + b), _reduced(a + (_P - b))], axis=2).reshape(len(x), -1)
        return x * self.scale % _P


_TRANSFORMS: dict[int, Transform] = {}


def _transform(size: int) -> Transform:
    if size not in _TRANSFORMS:
        _TRANSFORMS[size] = Transform(size)
    return _TRANSFORMS[size]


def _values(codes: np.ndarray) -> np.ndarray:
    """Numbers below the prime, distinct and not zero for distinct codes from 1 to PRIME - 1."""
    return codes.astype(_U) * _U(0x9E3779B1) % _P


def block_matches(codes: np.ndarray, block: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks that occur again ``shift`` to ``shift`` + block - 1 places on; shift is 0 or block.

    The window of a block is two blocks long, so its transform is put together from the blocks' own ones. The
    sums are exact modulo the prime. One that is a multiple of the prime without being zero would be a false
    seed, which the extension drops; an occurrence always gives zero.
    """
    count = -(-len(codes) // block)
    values = np.zeros((count + 3) * block, dtype=_U)
    values[:len(codes)] = _values(codes)
    padded = np.zeros((count + 2, 2 * block), dtype=_U)
    padded[:, :block] = values[:(count + 2) * block].reshape(-1, block)
    tf = _transform(2 * block)
    spectrum = tf.forward(padded)
    lead, follow = (spectrum[shift // block + k:][:count] for k in (0, 1))
    window = np.where(tf.odd, _reduced(lead + (_P - follow)), _reduced(lead + follow))
    cross = tf.inverse(spectrum[:count][:, tf.negative] * window % _P)[:, :block]
    squares = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(values * values % _P)])
    squared = (squares[block:] - squares[:-block]) % _P
    starts = np.arange(count) * block
    windows = np.lib.stride_tricks.sliding_window_view(squared[shift:], block)[starts]
    sums = (squared[starts][:, None] + windows + (_P - cross) * _U(2)) % _P
    row, distance = np.nonzero(sums == 0)
    distance += shift
    return starts[row][distance > 0], distance[distance > 0]


class Extender:
    """Common extensions of places of a sequence by prefix fingerprints; never too short, hardly ever too long."""

    def __init__(self, codes: np.ndarray, base: int):
        self.size = len(codes)
        self.powers = _powers(base, self.size + 1)
        terms = _values(codes) * self.powers[:self.size] % _P
        self.sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(terms)]) % _P

    def _equal(self, at: np.ndarray, distance: np.ndarray, length: int) -> np.ndarray:
        one = (self.sums[at + length] + (_P - self.sums[at])) % _P * self.powers[distance] % _P
        return one == (self.sums[at + distance + length] + (_P - self.sums[at + distance])) % _P

    def right(self, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Words from ``at`` that equal those ``distance`` further on."""
        found = np.zeros(len(at), dtype=np.int64)
        for bit in reversed(range(self.size.bit_length())):
            open_ = np.flatnonzero(at + distance + found + (1 << bit) <= self.size)
            hit = open_[self._equal((at + found)[open_], distance[open_], 1 << bit)]
            found[hit] += 1 << bit
        return found

    def left(self, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Words before ``at`` that equal those ``distance`` further on."""
        found = np.zeros(len(at), dtype=np.int64)
        for bit in reversed(range(self.size.bit_length())):
            open_ = np.flatnonzero(at - found - (1 << bit) >= 0)
            hit = open_[self._equal((at - found)[open_] - (1 << bit), distance[open_], 1 << bit)]
            found[hit] += 1 << bit
        return found


def extended(codes: np.ndarray, at: np.ndarray, distance: np.ndarray, block: int, least: int, repeats: int) -> np.ndarray:
    """Rows (start, length, period) of the runs through the seeds, each once."""
    for base in range(1_000_003, PRIME, 7_919):
        ext = Extender(codes, base)
        more = ext.right(at, distance)
        start = at - ext.left(at, distance)
        length = at + distance + more - start
        fits = (more >= block) & (length >= np.maximum(least, repeats * distance))
        rows = np.unique(np.stack([start, length, distance], axis=1)[fits], axis=0)
        # Of one stretch with several periods the smallest divides the others: rows are in its order.
        if len(rows):
            rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
        # A fingerprint that lies makes a run too long; then all is done again with another one.
        if all(np.array_equal(codes[s:s + n - q], codes[s + q:s + n]) for s, n, q in rows.tolist()):
            return rows
    raise AssertionError("no fingerprint tells the words apart")


def runs_in(texts: list[np.ndarray], least: int = 24, repeats: int = 3) -> list[list[tuple[int, int, int]]]:
    """For each text of word codes (from 1): its runs (start, length, period) by start, then period.

    A run is a stretch of ``least`` words or more whose smallest period fits ``repeats`` (3 or more) times and
    that no neighbouring word extends. The texts are joined by words of their own, so blocks of all of them
    go through one transform; larger scales keep only the texts long enough for their periods.
    """
    if repeats < 3 or least < 3:
        raise ValueError("a run has at least 3 words and 3 periods")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(sizes) and sizes.max() > MOST_WORDS:
        raise ValueError(f"a text has more than {MOST_WORDS} words")
    first_block = 1 << (least // 3).bit_length() - 1
    top = max((int(t.max()) for t in texts if len(t)), default=0)
    found: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    block = first_block
    while True:
        live = np.flatnonzero(sizes >= max(least, 3 * block))
        if not len(live):
            break
        parts = [x for k, i in enumerate(live) for x in (texts[i], np.array([top + 1 + k]))]
        codes = np.concatenate(parts).astype(np.int64)
        ends = np.cumsum(sizes[live] + 1)
        seeds = [block_matches(codes, block, shift) for shift in ([0, block] if block == first_block else [block])]
        at, distance = (np.concatenate(x) for x in zip(*seeds))
        if len(at):
            for s, n, q in extended(codes, at, distance, block, least, repeats).tolist():
                k = int(np.searchsorted(ends, s, side="right"))
                found[live[k]].add((s - int(ends[k] - sizes[live[k]] - 1), n, q))
        block *= 2
    out = []
    for runs in found:
        smallest: dict[tuple[int, int], int] = {}
        for s, n, q in runs:
            smallest[s, n] = min(q, smallest.get((s, n), q))
        out.append(sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2])))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside all runs and those of each run's first period that no other run drops, joined by a space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def _groups(texts: Iterator[str], most: int) -> Iterator[list[list[bytes]]]:
    """The texts' words, in lists of texts with about ``most`` words together, at least one text each."""
    group, size = [], 0
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        if group and size + len(words) > most:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    yield group


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3) -> DataFrame:
    """One row per document row: doc_id, n_words, runs (array of start, length, period), collapsed.

    Words lie between ASCII spaces and control spaces and are numbered from 0. A run is a stretch of at least
    ``least`` words and ``repeats`` times its smallest period (words that far apart are identical) that no
    neighbouring word extends; runs come by start, then period, and may overlap. collapsed is the text's words
    joined by one space, without those that a run contains after its first period. Runs never cross
    documents. Null and blank texts have no words, no runs and an empty collapsed text; ids may be null and
    rows may repeat, each is judged by itself. Other columns are ignored, so their names may clash. A text of
    more than 400 million words raises an error.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = 0
            for group in _groups((t.as_py() for t in batch.column(1)), GROUP_WORDS):
                flat = pa.array([w for words in group for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
                cuts = np.cumsum([0, *map(len, group)])
                found = runs_in([flat[a:b] + 1 for a, b in zip(cuts, cuts[1:])], least, repeats)
                texts = [collapsed(words, runs).decode("utf-8", "surrogatepass") for words, runs in zip(group, found)]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                rows = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3)
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(np.diff(cuts)), runs, pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(group)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        detect, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about a tenth of the texts, chosen by the id's CRC-32 h, the words repeat from word a on.

    Where h % 10 = 0 and there are n > 0 words, word i >= a becomes word a + (i - a) % p, with g = h div 10, a = g % n and
    p = 1 + (n - a) div (3 + g % 8), and the words are joined by one space. Texts with a null id stay as they are.
    """
    rows = docs.select("doc_id", text_of().alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    rows = rows.withColumns({"n": F.size("words").cast("long"), "g": F.call_function("div", F.col("h"), F.lit(10))})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.call_function("div", F.col("n") - F.col("a"), F.lit(3) + F.col("g") % 8) + 1)

    def again(word: Column, i: Column) -> Column:
        later = F.get("words", (F.col("a") + F.try_mod(i - F.col("a"), F.col("p"))).cast("int"))
        return F.when(i < F.col("a"), word).otherwise(later)

    planted = F.array_join(F.transform("words", again), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of the documents, some with a planted period, as numbers and digests; see ``periodic_runs``.

    The run reported is the one of greatest length over period, compared as whole numbers; ties: smallest start, then period.
    """
    found = periodic_runs(with_planted_period(docs))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = found.withColumn("best", F.aggregate("runs", none, better))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
