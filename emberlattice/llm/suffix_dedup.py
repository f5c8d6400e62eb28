"""Removal of long repeated byte strings by a sampled suffix order.

The method follows distributed suffix sorting with a difference cover, in the form that a fixed length
allows: sample positions so that two equal strings always have a sampled position at the same offset,
name the blocks at the samples, extend the names, merge the positions between samples, and compare
neighbours. The cover is chosen by content, the smallest fingerprint of every window, and not by
position modulo a period: it has the same property and samples one byte in about 137, where the cover
of a period that still leaves blocks of 128 bytes takes one in 16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import sliced, store, text_of
from emberlattice.llm.shingles import mix

BLOCK = 128
PART = 16
# A block is split when it has more than one in EVEN of all contexts, and more than FEW.
EVEN, FEW = 150, 512
_RNG = np.random.default_rng(1307)
_KEYS = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 20


def sample_cover(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a text and the 64-bit names of the 128-byte blocks there.

    Every string of ``length`` bytes holds the block of the smallest fingerprint among its blocks, the
    leftmost on ties; equal strings choose the same offset. Long texts are taken in chunks.
    """
    width = length - BLOCK + 1
    places, names = [], []
    for start in range(0, max(len(data) - length + 1, 0), _CHUNK):
        chunk = data[start:start + _CHUNK + length - 1]
        grams = np.ndarray((len(chunk) - 7,), "<u8", chunk, 0, (1,)).astype(np.uint64)
        count = len(chunk) - BLOCK + 1
        key = grams[:count] * _KEYS[0]
        for k in range(1, 4):
            key += grams[8 * k:8 * k + count] * _KEYS[k]
        key ^= key >> np.uint64(32)
        key *= _KEYS[4]
        key = (key & ~np.uint64(0xFFFFFF)) | np.arange(count, dtype=np.uint64)
        padded = np.full(-(-count // width) * width, ~np.uint64(0))
        padded[:count] = key
        rows = padded.reshape(-1, width)
        head = np.minimum.accumulate(rows, axis=1).ravel()
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[:count - width + 1], head[width - 1:count])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        at = np.unique((least & np.uint64(0xFFFFFF)).astype(np.int64))
        name = np.zeros(len(at), dtype=np.uint64)
        for k in range(BLOCK // 8):
            name += mix(grams[at + 8 * k]) * _KEYS[k]
        places.append(at + start)
        names.append(mix(name))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(names)[first]


def context_of(data: bytes, at: int, length: int) -> tuple[int, bytes]:
    """Bytes that strings of ``length`` around the block at ``at`` can reach, and how many lie before it."""
    left = min(at, length - BLOCK)
    return left, data[at - left:at + length]


def repeated_offsets(contexts: list[tuple[int, bytes]], length: int) -> np.ndarray:
    """For contexts of one block: which offsets (rows: context, columns: bytes before the block) repeat.

    Offsets stand for the positions between samples. Within an offset, strings are ordered by a 64-bit
    fingerprint of all their bytes and neighbours are compared.
    """
    parts = [string_hashes(contexts[k:k + 256], length) for k in range(0, len(contexts), 256)]
    hashes, valid = (np.concatenate(p) for p in zip(*parts))
    out = np.zeros_like(valid)
    if len(contexts) <= 1024:
        # Few contexts: all offsets at once.
        order = np.argsort(hashes, axis=0, kind="stable")
        ranked, good = np.take_along_axis(hashes, order, axis=0), np.take_along_axis(valid, order, axis=0)
        same = (ranked[1:] == ranked[:-1]) & good[1:] & good[:-1]
        twin = np.zeros_like(valid)
        twin[1:] |= same
        twin[:-1] |= same
        np.put_along_axis(out, order, twin, axis=0)
        return out
    for offset in range(length - BLOCK + 1):
        inside = np.flatnonzero(valid[:, offset])
        column = hashes[inside, offset]
        order = np.argsort(column, kind="stable")
        ranked = column[order]
        same = ranked[1:] == ranked[:-1]
        out[inside[order[1:][same]], offset] = True
        out[inside[order[:-1][same]], offset] = True
    return out


_PLACE_KEYS = _RNG.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_BYTE_KEYS = _RNG.integers(0, 2**64, 256, dtype=np.uint64)


def place_sums(contexts: list[tuple[int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the contexts' bytes, each times a key of its place, and whether the string at an offset lies inside the text.

    The block starts at place ``length - BLOCK`` of every context, so equal bytes around blocks give equal differences of sums.
    """
    reach = length - BLOCK
    grid = np.zeros((len(contexts), reach + length), dtype=np.uint64)
    valid = np.zeros((len(contexts), reach + 1), dtype=bool)
    for i, (left, data) in enumerate(contexts):
        grid[i, reach - left:reach - left + len(data)] = _BYTE_KEYS[np.frombuffer(data, np.uint8)]
        valid[i, max(0, length - (len(data) - left)):left + 1] = True
    grid *= _PLACE_KEYS[:reach + length]
    return np.concatenate([np.zeros((len(contexts), 1), np.uint64), np.cumsum(grid, axis=1, dtype=np.uint64)], axis=1), valid


def string_hashes(contexts: list[tuple[int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the strings at every offset, and whether the string lies inside the text."""
    sums, valid = place_sums(contexts, length)
    reach = length - BLOCK
    offsets = np.arange(reach + 1)
    return mix(sums[:, reach - offsets + length] - sums[:, reach - offsets]), valid


def part_names(contexts: list[tuple[int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """For every part of ``PART`` offsets that a context has strings at: context, part, core, whole, first and last offset.

    core names the bytes that all strings of the part hold, so equal strings have equal cores; whole names the bytes that
    any of the context's strings of the part holds.
    """
    sums, valid = place_sums(contexts, length)
    reach = length - BLOCK
    starts = np.arange(0, reach + 1, PART)
    lasts = np.minimum(starts + PART - 1, reach)
    # The offsets with a string are a single run.
    low, high = valid.argmax(axis=1), reach - valid[:, ::-1].argmax(axis=1)
    first, last = np.maximum(starts, low[:, None]), np.minimum(lasts, high[:, None])
    i, part = np.nonzero((first <= last) & valid.any(axis=1)[:, None])
    first, last = first[i, part], last[i, part]
    core = mix(sums[i, reach - lasts[part] + length] - sums[i, reach - starts[part]])
    return i, part, core, mix(sums[i, reach - first + length] - sums[i, reach - last]), first, last


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def with_hash(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, the MD5 of the text's bytes."""
    text = text_of()
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("h"))


def attach(docs: DataFrame, lists: DataFrame, small: bool) -> DataFrame:
    """Texts of the representatives named in ``lists`` (h, rep, ...), with the other columns."""
    lists = lists.withColumnsRenamed({"h": "_h", "rep": "_rep"})
    lists = F.broadcast(lists) if small else lists
    found = with_hash(docs).join(lists, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_rep")))
    return found.drop("_h", "_rep", "doc_id")


def collected(rows: DataFrame, reps: DataFrame, value: str, most: int) -> tuple[DataFrame, bool]:
    """Values gathered by text (h, rep, list), and whether all lists together are counted to be small."""
    lists = store(rows.groupBy("h").agg(F.sort_array(F.collect_list(value)).alias("list")).join(reps.select("h", "rep"), "h"))
    n = lists.agg(F.sum(F.size("list") + 8)).first()[0] or 0
    return lists, n <= most


def recurring(rows: DataFrame, keys: list[str], found: DataFrame, often: int = 1000, most: int = 50_000) -> DataFrame:
    """Rows of a stored table whose keys are in ``found`` (keys, times), with times, the number of rows of the key.

    Rows of a key met more than ``often`` times stay where they are, and such keys are broadcast; with the bound raised
    for large tables there are at most ``most`` of them. The other rows meet their keys by a shuffle.
    """
    found = found.select(*keys, "times")
    often = max(often, (found.agg(F.sum("times")).first()[0] or 0) // most)
    hot = found.where(F.col("times") > often)
    usual = rows.join(F.broadcast(hot.drop("times")), keys, "left_anti").join(found.where(F.col("times") <= often), keys)
    return usual.unionByName(rows.join(F.broadcast(hot), keys))


def repeated_ranges(docs: DataFrame, length: int = 400, hot_class: int = 32_768, broadcast_values: int = 8_000_000) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (h, rep, copies) and ranges (h, lo, hi) of start positions whose strings repeat."""
    texts = with_hash(docs)
    reps = store(texts.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))

    def name_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [sample_cover(t.encode("utf-8", "surrogatepass"), length) for t in batch.column(1).to_pylist()]
            counts = [len(at) for at, _ in rows]
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), counts)))
            yield pa.RecordBatch.from_arrays(
                [owner, pa.array(np.concatenate([n for _, n in rows]).view(np.int64) if rows else np.zeros(0, np.int64)),
                 pa.array(np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, np.int64))], names=["h", "name", "at"])

    samples = store(texts.select("h", "text").mapInArrow(name_samples, "h binary, name bigint, at bigint"))
    place = F.struct("h", "at")
    # Stored, so that Spark can split a block that very many positions share.
    shared = store(samples.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("name"))
    live, small = collected(samples.join(shared, "name", "left_semi").distinct(), reps, "at", broadcast_values)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hs, names, wide, places, los, his = [], [], [], [], [], []
            for text, h, chosen in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "surrogatepass")
                at, name = sample_cover(data, length)
                for a, n in zip(at.tolist(), name.view(np.int64).tolist()):
                    if a in (keep := set(chosen) if not isinstance(chosen, set) else chosen):
                        left, context = context_of(data, a, length)
                        hs.append(h), names.append(n), places.append(a)
                        wide.append(hashlib.blake2b(context, digest_size=16, salt=left.to_bytes(8, "little")).digest())
                        los.append(a - left), his.append(a - left + len(context) - length)
                    chosen = keep
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs, pa.binary()), pa.array(names, pa.int64()), pa.array(wide, pa.binary()), pa.array(places, pa.int64()),
                 pa.array(los, pa.int64()), pa.array(his, pa.int64())], names=["h", "name", "wide", "at", "lo", "hi"])

    named = store(attach(docs, live, small).select("text", "h", "list").mapInArrow(
        extend, "h binary, name bigint, wide binary, at bigint, lo bigint, hi bigint"))
    times = F.count(F.lit(1)).alias("times")
    strings = store(named.groupBy("name", "wide").agg(F.min(place).alias("first"), F.max(place).alias("last"), times))
    # Every string of a context that occurs twice repeats.
    whole = recurring(named, ["name", "wide"], strings.where("first < last")).select("h", "lo", "hi")
    classes = store(strings.groupBy("name").agg(times).where("times > 1"))
    hot_class = min(hot_class, max(FEW, (classes.agg(F.sum("times")).first()[0] or 0) // EVEN))
    open_ = recurring(strings.select("name", "first"), ["name"], classes).select(
        "first.h", F.struct("first.at", (F.col("times") > hot_class).alias("hot")).alias("sample"))
    wanted, small = collected(open_, reps, "sample", broadcast_values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, h, chosen in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "surrogatepass")
                hot = {s["at"]: s["hot"] for s in chosen}
                at, name = sample_cover(data, length)
                for a, n in zip(at.tolist(), name.view(np.int64).tolist()):
                    if a in hot:
                        left, context = context_of(data, a, length)
                        out.append((n, h, a, left, context, hot[a]))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))],
                names=["name", "h", "at", "left", "context", "hot"])

    contexts = attach(docs, wanted, small).select("text", "h", "list").mapInArrow(
        cut, "name bigint, h binary, at bigint, left int, context binary, hot boolean")
    contexts = store(contexts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows):
            members = list({(h, a): (left, context) for h, a, left, context in rows}.items())
            flags = repeated_offsets([c for _, c in members], length)
            for ((h, a), _), own in zip(members, flags):
                # Offset d is the string that starts d bytes before the block.
                yield from ((h, a - last, a - first) for first, last in runs_of(own))

        def batch_of(rows):
            hs, los, his = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(los, pa.int64()), pa.array(his, pa.int64())], names=["h", "lo", "hi"])

        current, rows, done = None, [], []
        for batch in sliced(batches):
            for name, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if name != current and rows:
                    done.extend(close(rows))
                    rows = []
                current = name
                rows.append(row)
            yield batch_of(done)
            done = []
        yield batch_of(list(close(rows)) if rows else [])

    usual = contexts.where(~F.col("hot")).drop("hot").repartition("name").sortWithinPartitions("name")
    edges = usual.mapInArrow(compare, "h binary, lo bigint, hi bigint")

    # A block in very many contexts is resolved by shuffles instead of inside a task. Its contexts are named again, part by
    # part of the offsets; only parts whose core is in several different contexts are left to compare string by string.
    hot = contexts.where("hot").drop("hot")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            lefts, datas = (batch.column(i).to_pylist() for i in (3, 4))
            i, part, core, body, first, last = part_names(list(zip(lefts, datas)), length)
            owner = pa.array(i)
            at = np.asarray(batch.column(2).to_pylist(), np.int64)[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), pa.array(part.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(body.view(np.int64)),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), batch.column(1).take(owner), pa.array(at)],
                names=["name", "part", "core", "body", "least", "most", "h", "at"])

    by_core, by_body = ["name", "part", "core"], ["name", "part", "core", "body", "least", "most"]
    parts = store(hot.mapInArrow(split, "name bigint, part int, core bigint, body bigint, least int, most int, h binary, at bigint"))
    bodies = store(parts.groupBy(*by_body).agg(F.min(place).alias("first"), F.max(place).alias("last"), times))
    alike = recurring(parts, by_body, bodies.where("first < last")).select(
        "h", (F.col("at") - F.col("most")).alias("lo"), (F.col("at") - F.col("least")).alias("hi"))
    cores = store(bodies.groupBy(*by_core).agg(times).where("times > 1"))
    asked = recurring(bodies.select(*by_core, "first"), by_core, cores).groupBy("first").agg(
        F.collect_set("part").alias("parts")).select("first.*", "parts")

    def hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            rows = [batch.column(k).to_pylist() for k in range(6)]
            hashes, valid = string_hashes(list(zip(rows[3], rows[4])), length)
            for own, chosen in zip(valid, rows[5]):
                own &= np.isin(np.arange(len(own)) // PART, chosen)
            i, d = np.nonzero(valid)
            owner = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.asarray(rows[2], np.int64)[i] - d),
                 pa.array(d.astype(np.int32)), pa.array(hashes[i, d].view(np.int64))], names=["name", "h", "start", "offset", "hash"])

    spots = store(hot.join(asked, ["h", "at"]).select("name", "h", "at", "left", "context", "parts").mapInArrow(
        hash_parts, "name bigint, h binary, start bigint, offset int, hash bigint"))
    spot, by_string = F.struct("h", "start"), ["name", "offset", "hash"]
    twins = store(spots.groupBy(*by_string).agg(F.min(spot).alias("first"), F.max(spot).alias("last"), times).where("first < last"))
    single = recurring(spots, by_string, twins).select("h", F.col("start").alias("lo"), F.col("start").alias("hi"))
    ranges = whole.unionByName(edges).unionByName(alike).unionByName(single)
    return reps, ranges


def remove_repeats(docs: DataFrame, length: int = 400, hot_class: int = 32_768, broadcast_values: int = 8_000_000) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Removed is every byte under a string of ``length`` bytes (129 to 2000) that also starts anywhere else,
    in any document row, on the bytes of the whole UTF-8 texts; overlaps count, and all copies go. kept is
    the remaining bytes. Null text counts as empty; rows that repeat a text of that length repeat its
    strings, so nothing of them is left. Other columns are ignored, so their names may clash.

    Texts themselves never meet in one place. A block in more than ``hot_class`` different contexts, or in
    so many that its task would stand out, is resolved by shuffles of names, then of the strings still open.
    Lists by text are broadcast only up to a counted size of ``broadcast_values`` numbers, else joined by a
    shuffle.
    """
    reps, ranges = repeated_ranges(docs, length, hot_class, broadcast_values)
    lists = ranges.groupBy("h").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("list"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for ranges in batch.column(1).to_pylist():
                spans: list[list[int]] = []
                for r in ranges:
                    lo, hi = r["lo"], r["hi"] + length
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                out.append([x for s in spans for x in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["h", "cuts"])

    cuts = lists.mapInArrow(merged, "h binary, cuts array<bigint>")
    known = store(reps.where("copies > 1").select("h", "copies").join(cuts, "h", "full_outer").select(
        F.col("h").alias("_h"), "cuts", (F.coalesce("copies", F.lit(1)) > 1).alias("copied")))
    size = known.agg(F.sum(F.coalesce(F.size("cuts"), F.lit(0)) + 8)).first()[0] or 0
    side = F.broadcast(known) if size <= broadcast_values else known
    rows = with_hash(docs).join(side, F.col("h") == F.col("_h"), "left").select("doc_id", "text", "cuts", "copied")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, cuts, copied in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                data = text.encode("utf-8", "surrogatepass")
                spans = [0, len(data)] if copied and len(data) >= length else cuts or []
                edges = [0, *spans, len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(apply, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
