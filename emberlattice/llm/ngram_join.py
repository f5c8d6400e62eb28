"""N-gram Jaccard join: grouped prefix join, and the classes of linked documents.

The order of shingles that prefixes need is: not frequent first, then long ones, then by hash. Any total
order gives the same links; this one keeps shared passages and common phrases out of the prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.llm.common import GAP_CLASS, UPPER, discard, sliced, store
from emberlattice.llm.components import components
from emberlattice.llm.shingles import shingle_set

# Words of a set's parity sketch of 2048 bits; folded, they are the sketch of 512 bits that tells sets of
# up to LARGE shingles apart.
SKETCH = [f"s{i}" for i in range(32)]
NARROW, LARGE = 8, 1500
# What tells lists apart: a shingle's fingerprint or a group's number, and which of both it is.
LIST = ["one_group", "token"]
# A shingle is frequent if one document in a thousand holds it. At most so many are told apart; this
# changes the order of shingles only, never the links.
FREQUENT_SHARE, FREQUENT_MOST = 1 / 1000, 1 << 17


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted fingerprints of shingles that about one in a thousand documents holds.

    Every task counts all its shingles and passes on those frequent in its own batch.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4000):
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64),) * 2
            often = counts >= max(2, len(sets) * FREQUENT_SHARE / 2)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))],
                                             names=["token", "n"])

    total = docs.count()
    found = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = found.where(F.col("n") >= max(2, total * FREQUENT_SHARE)).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST)
    rows = found.select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(rows.view(np.uint64))


def describe_sets(docs: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, sid and gid (fingerprints of the set, and of its prefix and size), prefix, sketch."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, sids, gids, prefixes, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = shingle_set(text, width)
                n = len(tokens)
                sizes.append(n)
                sids.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    hot = frequent[at] == tokens
                    tokens = np.concatenate([tokens[~hot], tokens[hot]])
                prefixes.append(tokens[:keep].view(np.int64))
                gids.append(hashlib.blake2b(tokens[:keep].tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest())
                odd = np.bincount((tokens & np.uint64(2047)).astype(np.int64), minlength=2048).astype(np.uint8) & 1
                sketches.append(np.packbits(odd).view(np.int64))
            words = np.stack(sketches) if sketches else np.zeros((0, len(SKETCH)), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()), pa.array(gids, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *[pa.array(words[:, i]) for i in range(len(SKETCH))]],
                names=["doc_id", "text_hash", "n", "sid", "gid", "prefix", *SKETCH])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"doc_id {kind}, text_hash bigint, n bigint, sid binary, gid binary, prefix array<bigint>, "
                           + ", ".join(f"{s} bigint" for s in SKETCH))


def close_enough(percent: int, words: list[str]) -> Column:
    """Exact necessary conditions on sizes and sketches of a pair (columns of a and b).

    Two linked sets differ in at most (1-t)/(1+t) of their joint size, and sketches in no more bits.
    """
    sizes = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in words])
    return sizes & (bits * (100 + percent) <= (100 - percent) * (F.col("a_n") + F.col("b_n")))


def least_shared(percent: int) -> Column:
    """Shingles that two linked sets share in their prefixes at least (columns joint and larger).

    With o common shingles, the k-th of them stands at most n - o places late in a set of n, so the first
    o - ceil(t * larger) + 1 of them lie in both prefixes.
    """
    common = F.ceil(F.lit(percent) * F.col("joint") / F.lit(100 + percent))
    return common - F.ceil(F.lit(percent) * F.col("larger") / F.lit(100)) + 1


def folded() -> list[Column]:
    """The narrow sketch's words: a bit's parity is that of the bits that fall on it."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.col(w) for w in SKETCH[i::NARROW]]).alias(SKETCH[i]) for i in range(NARROW)]


def side(sets: DataFrame, name: str) -> DataFrame:
    """A pair's side: its set id, size and sketch under one name."""
    return sets.select(F.col("sid").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(s).alias(f"{name}_{s}") for s in SKETCH])


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, broadcast_rows: int,
           sketches: DataFrame | None = None, at_once: int = 256) -> DataFrame:
    """The pairs (a, b) of set ids whose exact sets meet the threshold.

    ``sketches`` is given for pairs not yet compared by their whole sketches; it is shuffled for each side.
    A text travels once for each of its pairs, compressed, to where b's text is. b's that many pairs name
    are salted: each part of about ``at_once`` pairs has its own copy of b's text.
    """
    pairs = pairs.select("a", "b").distinct()
    if sketches is not None:
        pairs = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").where(close_enough(percent, SKETCH))
    pairs = store(pairs.select("a", "b"))
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / at_once).alias("parts"))
    salted = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("salt"))
    trips = salted.select(F.col("a").alias("sid"), "b", "salt", "a").unionByName(
        salted.select(F.col("b").alias("sid"), "b", "salt", F.lit(None).cast("binary").alias("a")).distinct())
    trips = store(trips.join(sets.select("sid", "rep", "text_hash"), "sid").select(
        "b", "salt", "a", F.col("rep").alias("_rep"), F.col("text_hash").alias("_hash")))
    # A few dozen bytes a row: broadcast only up to a counted number of rows.
    small = F.broadcast(trips) if trips.count() <= broadcast_rows else trips
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(
        small, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("text_hash") == F.col("_hash"))).select("b", "salt", "a", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            blobs = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["b", "salt", "a", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        hub = np.zeros(0, np.uint64)
        for batch in sliced(batches):
            keep = []
            for a, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tokens = shingle_set(unpacker.decompress(blob).decode("utf-8", "surrogatepass"), width)
                if a is None:
                    hub = tokens
                both = len(np.intersect1d(hub, tokens, assume_unique=True)) if a is not None else 0
                keep.append(a is not None and 100 * both >= percent * (len(hub) + len(tokens) - both))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    packed = texts.mapInArrow(pack, "b binary, salt bigint, a binary, blob binary")
    packed = packed.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return store(packed.mapInArrow(compare, "a binary, b binary"))


def linked_classes(docs: DataFrame, width: int = 4, percent: int = 85, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    Two documents link when 100 * common shingles >= percent * shingles in either. component_id is the
    smallest doc_id reachable over links. Blank and null texts have no shingle and link with nothing;
    equal sets always link, so repeated rows fall together. Null doc_ids take part, and only a class of
    nulls has a null component_id. Other columns are ignored, so their names may clash.

    1. Equal sets become one row; sets with equal prefix and size become a group.
    2. Groups meet in the lists of their prefix shingles, the sets of a group in a list of the group.
       Every set is compared with one hub of its lists, the set whose prefix is shared most; the links
       found give provisional classes. A second round takes hubs from the lists' largest classes.
    3. Pairs of sets of different classes that share a list, or a group, are compared, save pairs inside
       a list's largest class. Members of one class need no further comparison, so thousands of near
       copies cost a pair or two each, and no pair that could join two classes is left out.
    """
    rows, found = classes_of_sets(docs.select("doc_id", "text"), width, percent, broadcast_rows)
    found = found.select(F.col("sid").alias("_sid"), "component_id")
    joined = rows.join(found, rows["sid"] == found["_sid"], "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def rooted(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Sets with the root of their class so far: themselves without a link."""
    if labels is None:
        return members.withColumn("root", F.col("sid"))
    joined = members.join(labels.withColumnRenamed("node", "_node"), F.col("sid") == F.col("_node"), "left")
    return joined.withColumn("root", F.coalesce("root", "sid")).drop("_node")


def mixed_lists(placed: DataFrame) -> DataFrame:
    """Lists that hold several classes: token, the largest class (major) and its most shared set (hub)."""
    best = F.struct("score", "sid")
    classes = placed.groupBy("one_group", "token", "root").agg(F.count(F.lit(1)).alias("k"), F.max(best).alias("top"))
    lists = classes.groupBy("one_group", "token").agg(
        F.max(F.struct("k", "top", "root")).alias("first"), F.count(F.lit(1)).alias("classes"))
    return lists.where("classes > 1").select("one_group", "token", F.col("first.root").alias("major"), F.col("first.top.sid").alias("hub"))


def hub_pairs(places: DataFrame, members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """For every set outside a list's largest class the hub it shares most lists with, if close enough."""
    placed = places.join(members.select("g", "sid", "root", "score"), "g")
    met = placed.join(mixed_lists(placed), LIST).where(F.col("root") != F.col("major"))
    met = met.groupBy(F.col("sid").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    met = met.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").where(close_enough(percent, SKETCH))
    return met.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))


def pairs_across(placed: DataFrame, mixed: DataFrame, words: list[str], percent: int, wanted: Column) -> DataFrame:
    """Pairs of sets of different classes that meet in a list, close enough and sharing enough shingles.

    Pairs inside a list's largest class need no comparison, and no pair is left out but those.
    """
    open_ = store(placed.join(mixed, LIST).drop("hub"))

    def named(name):
        return open_.select(*LIST, "major", *[F.col(c).alias(f"{name}_{c}") for c in ("root", "n", *words)], F.col("sid").alias(name))

    left = named("a").where(F.col("a_root") != F.col("major"))
    # Of two sets outside the largest class only one is the left one: a pair counts once for each list.
    once = (F.col("b_root") == F.col("major")) | (F.col("a") < F.col("b"))
    met = left.join(named("b").withColumnRenamed("major", "_major"), LIST).where(
        (F.col("a_root") != F.col("b_root")) & once & wanted & close_enough(percent, words))
    met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max("one_group").alias("one_group"),
        F.first(F.col("a_n") + F.col("b_n")).alias("joint"), F.max(F.greatest("a_n", "b_n")).alias("larger"))
    return met.where(F.col("one_group") | (F.col("shared") >= least_shared(percent))).select("a", "b")


def classes_of_sets(docs: DataFrame, width: int, percent: int, broadcast_rows: int, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Described document rows, and distinct sets (sid, component_id, rep, text_hash, root)."""
    described = store(describe_sets(docs, frequent_shingles(docs, width), width, percent))
    rows = store(described.select("doc_id", "text_hash", "n", "sid"))
    first = F.struct("doc_id", "text_hash")
    sets = described.where(F.col("n") > 0).groupBy("sid").agg(
        F.min("doc_id").alias("low"), F.min_by(F.struct("doc_id", "text_hash", "n", "gid", "prefix", *SKETCH), first).alias("own"))
    sets = store(sets.select("sid", "low", F.col("own.doc_id").alias("rep"), "own.text_hash", "own.n", "own.gid", "own.prefix",
                             *[f"own.{s}" for s in SKETCH]))
    # The wide rows are needed no more; they would take as much of the shared folder as the sets.
    discard(described)
    groups = sets.groupBy("gid").agg(F.min("sid").alias("leader"), F.count(F.lit(1)).alias("members"))
    # Numbered as written; the numbers are read from the stored table only.
    groups = store(groups.withColumn("g", F.monotonically_increasing_id()))
    leads = groups.withColumn("sid", F.col("leader")).join(sets.select("sid", "n", "prefix"), "sid")
    # A row for each prefix shingle of each group, narrow, shuffled once. In a list ordered by size only
    # rows next to one of a size that a link allows can be in a pair.
    lists = Window.partitionBy("token").orderBy("n")
    postings = leads.select("g", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    near = (100 * F.lag("n").over(lists) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(lists))
    live = store(postings.withColumn("near", near).where("near").select("token", "g"))
    # Lists by shingle, and a list of its own for every group of several sets.
    live = live.withColumn("one_group", F.lit(False))
    places = live.unionByName(groups.where(F.col("members") > 1).select(
        F.col("g").alias("token"), "g", F.lit(True).alias("one_group")))
    # The share of a prefix that other groups hold too: near 1 for a text whose copies were edited.
    shared = live.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    score = leads.join(shared, "g").select("g", (F.col("k") / F.size("prefix")).alias("score"))
    members = sets.select("sid", "gid", "n", *SKETCH).join(groups.select("gid", "g"), "gid").drop("gid")
    members = store(members.join(score, "g", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    # Prefixes are needed no more, and the members have the sketches.
    wide, sets = sets, store(sets.select("sid", "low", "rep", "text_hash"))
    discard(wide)
    links, labels = None, None
    for _ in range(rounds):
        found = verify(hub_pairs(places, rooted(members, labels), members, percent), sets, docs, width, percent, broadcast_rows)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    placed = places.join(rooted(members, labels), "g")
    mixed = mixed_lists(placed)
    usual = placed.where(F.col("n") <= LARGE).select(*LIST, "root", "sid", "n", *folded())
    large = placed.where(100 * F.col("n") > percent * LARGE).select(*LIST, "root", "sid", "n", *SKETCH)
    across = pairs_across(usual, mixed, SKETCH[:NARROW], percent, F.lit(True)).unionByName(
        pairs_across(large, mixed, SKETCH, percent, F.greatest("a_n", "b_n") > LARGE))
    more = verify(across, sets, docs, width, percent, broadcast_rows, members)
    roots = components(links.unionByName(more))
    final = sets.join(roots.withColumnRenamed("node", "_node"), F.col("sid") == F.col("_node"), "left")
    final = final.select("sid", "low", "rep", "text_hash", F.coalesce("root", "sid").alias("root"))
    lowest = final.groupBy("root").agg(F.min("low").alias("component_id"), F.min(F.struct("rep", "text_hash")).alias("kept"))
    return rows, final.join(lowest, "root").select("sid", "component_id", "kept")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, broadcast_rows: int = 200_000) -> DataFrame:
    """The documents without near copies: of each class of linked documents the first row stays.

    First is the smallest doc_id (null before all), then the smallest hash of the text. Texts without
    words stay, all of them. Of rows equal in doc_id and text one stays. Columns are those of ``docs``.
    """
    rows, found = classes_of_sets(docs.select("doc_id", "text"), width, percent, broadcast_rows)
    found = found.select(F.col("sid").alias("_sid"), "kept")
    joined = rows.where(F.col("n") > 0).join(found, rows["sid"] == found["_sid"])
    marked = joined.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.struct("doc_id", "text_hash").eqNullSafe(F.col("kept"))).alias("stays"))
    marked = store(marked.where(~F.col("stays") | (F.col("copies") > 1)).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "stays"))
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))

    def small(df):
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    kept = hashed.join(small(marked), same, "left_anti")
    again = marked.where("stays")
    if again.limit(1).count():
        kept = kept.unionByName(hashed.join(small(again.select("_doc", "_hash")), same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]))
    return kept.drop("_text_hash")


def op9_ngram_join(docs: DataFrame) -> DataFrame:
    return linked_classes(docs)


OP9_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP_CLASS}+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT doc_id, b FROM reach JOIN edges ON other = a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""
