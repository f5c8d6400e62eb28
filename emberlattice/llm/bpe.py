"""Byte-pair encoding of a corpus with chunks that documents share encoded once.

Texts are cut where a rolling hash of the last bytes says so, so equal passages give equal chunks wherever they
stand. A chunk that occurs more than once is encoded once for the whole corpus; its ids travel to the
documents that hold it. A document's other text is encoded in place. At every joint the text between the next
safe places on both sides is encoded again, until the ids there agree with those of the neighbours.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import discard, sliced, store, text_of

WINDOW = 32  # bytes that the rolling hash sees
LEAST_CHUNK = 128
MEAN_BITS = 9  # a cut every 512 bytes, besides the least length
_TABLE = np.random.default_rng(4211).integers(0, 2**32, 256, dtype=np.uint32)
_STEP = 0x9E3779B1
_BATCH_CHARS = 1 << 20
# White space after something else: a pre-token of a byte-level tokenizer never reaches from the one to the other.
# Characters that some libraries count as white space and others do not stand on neither side.
_SOLID = re.compile("[^\\s\u180e\u200b\ufeff]")
_BLANK = (" ", "\t", "\n", "\r")
SAFE = re.compile(f"(?<={_SOLID.pattern})(?=[{''.join(_BLANK)}])")
# The text up to the next safe place, without a look back at every character; empty at the end of a text.
_HOLLOW = "[\\s\u180e\u200b\ufeff]"
_STRETCH = re.compile(f"{_HOLLOW}*+(?:{_SOLID.pattern}++(?:(?![{''.join(_BLANK)}]){_HOLLOW}++)?+)*+")


def default_tokenizer() -> str:
    """The vocabulary file of the query, where the machine keeps its public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer_of(content: str):
    """The tokenizer of a file's content, without truncation and padding, one thread a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(content)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cut_places(data: bytes) -> list[int]:
    """Places between the chunks of a text, 0 and its length left out; always between two characters.

    The hash of a window of bytes is made by doubling. A place is a cut where the hash ends in zeros and the one
    before did not, so that a stretch of one byte has no cuts, and at least ``LEAST_CHUNK`` bytes after the last.
    """
    if len(data) <= LEAST_CHUNK:
        return []
    raw = np.frombuffer(data, np.uint8)
    value, span, factor = _TABLE[raw], 1, _STEP
    while span < WINDOW:
        value[span:] = value[span:] + value[:-span] * np.uint32(factor)
        span, factor = 2 * span, factor * factor % 2**32
    mixed = value ^ (value >> np.uint32(15))
    hit = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - MEAN_BITS) == 0
    # The cut lies after the window's last byte, where the next byte starts a character.
    cut = np.flatnonzero(hit[1:-1] & ~hit[:-2] & ((raw[2:] & 0xC0) != 0x80)) + 2
    out, last = [], 0
    for place in cut.tolist():
        if place - last >= LEAST_CHUNK:
            out.append(place)
            last = place
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text; none for an empty one."""
    edges = [0, *cut_places(data), len(data)]
    return list(zip(edges, edges[1:])) if data else []


def _encode_all(tok, texts: list[str]) -> list[np.ndarray]:
    """Ids of texts, in batches of bounded size."""
    out, batch, size = [], [], 0
    for text in [*texts, None]:
        if batch and (text is None or size + len(text) > _BATCH_CHARS):
            out += [np.array(e.ids, dtype=np.uint32) for e in tok.encode_batch_fast(batch, add_special_tokens=False)]
            batch, size = [], 0
        if text is not None:
            batch.append(text)
            size += len(text)
    return out


@lru_cache(maxsize=2)
def bytes_of_ids(content: str) -> tuple[list[bytes], np.ndarray]:
    """The bytes of text behind each id, and how many they are.

    A byte-level token has one character for every byte: printable bytes stand for themselves, the others, in
    order, for the characters from 256 on. An added token stands for itself.
    """
    tok = tokenizer_of(content)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    added = tok.get_added_tokens_decoder()
    vocab = tok.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = token.encode("utf-8") if i in added else bytes(byte_of[c] for c in token)
    return out, np.array([len(b) for b in out], dtype=np.int64)


def stretches_of(text: str) -> list[str]:
    """The stretches between the safe places of a text, as ``SAFE.split`` gives them."""
    parts = _STRETCH.findall(text)
    if text:
        parts.pop()
    return parts


def byte_places(text: str, places: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 bytes of a text, given as numbers of characters."""
    if text.isascii():
        return places
    sizes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (sizes > 0x7F).astype(np.int64) + (sizes > 0x7FF) + (sizes > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])[places]


class Stretches:
    """Encodes pieces stretch by stretch between safe places, each distinct stretch once while it is remembered.

    What is remembered is bounded: beyond ``most`` characters a new batch begins with the stretches met most often,
    at most half of that and only those met again.
    """

    def __init__(self, content: str, most: int = 3_000_000):
        self.tok, self.most = tokenizer_of(content), most
        self.id_bytes = bytes_of_ids(content)[1]
        self.known: dict[str, int] = defaultdict(count().__next__)  # a new stretch gets the next number
        self.chars, self.ids = 0, np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each stretch in ``ids``
        self.met = np.zeros(0, np.int64)  # how often since the last forgetting

    def _forget(self) -> None:
        names = list(self.known)
        order = np.argsort(-self.met, kind="stable")
        sizes = np.fromiter(map(len, names), np.int64, len(names))[order]
        keep = np.sort(order[(np.cumsum(sizes) <= self.most // 2) & (self.met[order] > 1)])
        names = [names[k] for k in keep.tolist()]
        self.known = defaultdict(count(len(names)).__next__, zip(names, range(len(names))))
        self.chars = sum(map(len, names))
        starts, self.lengths = self.starts[keep], self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = self.ids[np.repeat(starts - self.starts, self.lengths) + np.arange(self.lengths.sum())]
        self.met = np.zeros(len(names), np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Encode new stretches. Those with a safe place at both ends go through the tokenizer in a row."""
        row, alone = [], []
        for k, part in enumerate(fresh):
            (row if part[:1] in _BLANK and _SOLID.match(part[-1:]) else alone).append(k)
        starts, lengths = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        ids, end = [self.ids], len(self.ids)
        for k, got in zip(alone, _encode_all(self.tok, [fresh[k] for k in alone])):
            starts[k], lengths[k] = end, len(got)
            ids.append(got)
            end += len(got)
        for at in range(0, len(row), 50_000):
            some = row[at:at + 50_000]
            parts = [fresh[k] for k in some]
            text = "".join(parts)
            got = _encode_all(self.tok, [text])[0]
            edges = np.concatenate([[0], np.cumsum(self.id_bytes[got])])
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            cuts = np.concatenate([[0], np.searchsorted(edges, byte_places(text, np.cumsum(sizes)))])
            starts[some], lengths[some] = end + cuts[:-1], np.diff(cuts)
            ids.append(got)
            end += len(got)
        self.chars += sum(map(len, fresh))
        self.ids = np.concatenate(ids)
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.chars > self.most:
            self._forget()
        places, sizes, before = [], [], len(self.known)
        for text in texts:
            parts = stretches_of(text)
            places.extend(map(self.known.__getitem__, parts))
            sizes.append(len(parts))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        at = np.array(places, dtype=np.int64)
        met = np.bincount(at, minlength=len(self.known))
        met[:before] += self.met
        self.met = met
        width = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(width)])
        start = self.starts[at] - ends[:-1]
        flat = self.ids[np.repeat(start, width) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
        return [flat[a:b] for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def pieces_of(content: str) -> Stretches:
    """The stretches that a worker remembers from one task to the next."""
    return Stretches(content)


class Piece:
    """A stretch of a text with its own ids and the byte places where each id starts."""

    def __init__(self, start: int, end: int, ids: np.ndarray, lengths: np.ndarray):
        self.start, self.end, self.ids = start, end, ids
        self.edges = start + np.concatenate([[0], np.cumsum(lengths[ids])])

    def between(self, start: int, end: int) -> np.ndarray | None:
        """The ids from byte ``start`` to ``end``; None where an id crosses one of them."""
        a, b = np.searchsorted(self.edges, (start, end))
        fits = a < len(self.edges) and b < len(self.edges) and self.edges[a] == start and self.edges[b] == end
        return self.ids[a:b] if fits else None


def safe_places(text: str) -> np.ndarray:
    """Byte places of a text where every encoding starts a new id, whatever stands further on both sides."""
    parts = stretches_of(text)
    return byte_places(text, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1])


class Joints:
    """The windows around the joints of a text's pieces.

    At first a window reaches from the second safe place before its joint to the second after it.
    """

    def __init__(self, data: bytes, text: str, pieces: list[Piece]):
        self.data, self.pieces = data, pieces
        self.starts = np.array([p.start for p in pieces])
        safe = safe_places(text)
        self.marks = np.concatenate([[0], safe[(safe > 0) & (safe < len(data))], [len(data)]])
        self.windows = self._joined([(int(np.searchsorted(self.marks, p.start, side="right")) - 2,
                                      int(np.searchsorted(self.marks, p.start)) + 1) for p in pieces[1:]])

    def _joined(self, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Windows inside the text as places in ``marks``, those that overlap as one."""
        out: list[tuple[int, int]] = []
        for a, b in sorted((max(a, 0), min(b, len(self.marks) - 1)) for a, b in windows):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def text_of(self, window: tuple[int, int]) -> str:
        return self.data[self.marks[window[0]]:self.marks[window[1]]].decode("utf-8", "surrogatepass")

    def _own(self, start: int, end: int) -> np.ndarray | None:
        """Ids that a single piece has from ``start`` to ``end``, None where none has."""
        piece = self.pieces[int(np.searchsorted(self.starts, start, side="right")) - 1]
        return piece.between(start, end) if end <= piece.end else None

    def repaired(self, encode, lengths: np.ndarray) -> np.ndarray:
        """Ids of the whole text.

        A window agrees with its neighbours if its first and its last stretch between safe places have the ids that a
        piece has there. Where they do not, or no single piece holds the stretch, the window grows to the next
        safe place on that side; in the end it is the text. Ids between two windows come from the piece there.
        """
        marks, last = self.marks, len(self.marks) - 1
        done: dict[tuple[int, int], np.ndarray] = {}
        windows = self.windows
        while any(w not in done for w in windows):
            grown = []
            for a, b in windows:
                if (a, b) not in done:
                    lo, hi = int(marks[a]), int(marks[b])
                    whole = Piece(lo, hi, encode(self.text_of((a, b))), lengths)
                    left = a == 0 or _same(whole.between(lo, int(marks[a + 1])), self._own(lo, int(marks[a + 1])))
                    right = b == last or _same(whole.between(int(marks[b - 1]), hi), self._own(int(marks[b - 1]), hi))
                    if left and right:
                        done[a, b] = whole.ids
                    else:
                        a, b = (a if left else a - 1), (b if right else b + 1)
                grown.append((a, b))
            windows = self._joined(grown)
        out, at = [], 0
        for a, b in windows:
            out += [self._between(at, int(marks[a])), done[a, b]]
            at = int(marks[b])
        return np.concatenate([*out, self._between(at, len(self.data))])

    def _between(self, lo: int, hi: int) -> np.ndarray:
        ids = self._own(lo, hi) if lo < hi else np.zeros(0, np.uint32)
        if ids is None:
            raise AssertionError("a safe place lies inside an id")
        return ids


def _same(a: np.ndarray | None, b: np.ndarray | None) -> bool:
    return a is not None and b is not None and np.array_equal(a, b)


def packing(ids: int) -> str:
    """The narrowest little-endian type for that many different ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def assembled(rows: list[tuple[str, list[tuple[int, int, bytes]]]], pieces: Stretches, lengths: np.ndarray) -> list[np.ndarray]:
    """Ids of each text, given the ids (little-endian, 32 bits) of some of its chunks (start, end, ids).

    What lies between known chunks is encoded by ``pieces``; windows around joints go through the tokenizer itself.
    """
    tok = pieces.tok
    plans, todo = [], []
    for text, known in rows:
        data = text.encode("utf-8", "surrogatepass")
        stretches, at = [], 0  # (start, end, ids or the number of the text to encode)
        for start, end, ids in sorted(known):
            if at < start:
                stretches.append((at, start, len(todo)))
                todo.append(data[at:start].decode("utf-8", "surrogatepass"))
            stretches.append((start, end, np.frombuffer(ids, "<u4")))
            at = end
        if at < len(data):
            stretches.append((at, len(data), len(todo)))
            todo.append(text if at == 0 else data[at:].decode("utf-8", "surrogatepass"))
        plans.append((text, data, stretches))
    fresh = pieces.encode(todo)
    out, joints = [], {}
    for k, (text, data, stretches) in enumerate(plans):
        ids = [fresh[i] if isinstance(i, int) else i for _, _, i in stretches]
        if len(ids) > 1:
            joints[k] = Joints(data, text, [Piece(a, b, i, lengths) for (a, b, _), i in zip(stretches, ids)])
        out.append(ids[0] if len(ids) == 1 else np.zeros(0, np.uint32))
    # The first windows of all texts go through the tokenizer together, each text of a window once.
    texts = list({j.text_of(w): None for j in joints.values() for w in j.windows})
    memo = dict(zip(texts, _encode_all(tok, texts)))
    for k, j in joints.items():
        out[k] = j.repaired(lambda t: memo[t] if t in memo else _encode_all(tok, [t])[0], lengths)
    return out


def encode_corpus(docs: DataFrame, tokenizer: str, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    ``tokenizer`` is the path of a byte-level tokenizer file; truncation and padding are off and no special tokens are
    added, while a special token's string inside a text becomes that token. The ids are those of the whole text. Its file is
    read once on the driver and broadcast; its size is that of a vocabulary.

    Chunks that stand in the corpus more than once, in one text or several, are encoded once; 128-bit digests tell
    chunks and texts apart. Null text counts as empty and gives no ids; ids may be null and rows may repeat. Other
    columns are ignored, so their names may clash. The places of the chunks to encode are broadcast only if
    counted to weigh at most ``broadcast_bytes``, else joined by a shuffle. The ids known of a text are joined to it by a
    shuffle, where texts travel compressed and ids in two bytes if the vocabulary allows; a chunk that very many texts
    hold is one row on its side of the join, and equal texts count once there.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of()
    texts = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("h"),
                        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            owner, starts, ends, digests = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for a, b in chunks_of(data):
                    owner.append(i), starts.append(a), ends.append(b), digests.append(digest_of(data[a:b]))
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                 pa.array(digests, pa.binary())], names=["h", "key", "start", "end", "digest"])

    places = store(texts.select("h", "key", "text").mapInArrow(cut, "h binary, key string, start bigint, end bigint, digest binary"))
    place = F.struct("h", "key", "start", "end")
    shared = places.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    todo = store(shared.select("first.*", "digest").groupBy("h", "key").agg(
        F.collect_list(F.struct("start", "end", "digest")).alias("chunks")))

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(content.value)
        packed = packing(len(pieces.id_bytes))
        for batch in sliced(batches):
            digests, texts = [], []
            for text, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for c in chunks:
                    digests.append(c["digest"]), texts.append(data[c["start"]:c["end"]].decode("utf-8", "surrogatepass"))
            ids = [i.astype(packed).tobytes() for i in pieces.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.binary())], names=["digest", "ids"])

    weight = todo.agg(F.sum(F.size("chunks") * 48 + 64)).first()[0] or 0
    side = F.broadcast(todo) if weight <= broadcast_bytes else todo
    # Rows that repeat both id and text encode the same chunks: one of them counts.
    encoded = texts.join(side, ["h", "key"]).select("text", "chunks").mapInArrow(encode_chunks, "digest binary, ids binary")
    known = store(encoded.dropDuplicates(["digest"]))
    held = places.groupBy("h", "start").agg(F.first("end").alias("end"), F.first("digest").alias("digest"))
    lists = store(held.join(known, "digest").groupBy("h").agg(F.collect_list(F.struct("start", "end", "ids")).alias("known")))
    for table in (places, todo, known):
        discard(table)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            small = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], names=["doc_id", "h", "small"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(content.value)
        table, lengths = bytes_of_ids(content.value)
        packed = packing(len(lengths))
        for batch in sliced(batches, 500):
            rows = [(zlib.decompress(small).decode("utf-8", "surrogatepass"),
                     [(c["start"], c["end"], np.frombuffer(c["ids"], packed).astype("<u4").tobytes()) for c in known or []])
                    for small, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            ids = assembled(rows, pieces, lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                 pa.array([decoded(i, table) for i in ids], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    # What is known of all texts grows with the corpus, so this join shuffles at any size; texts travel compressed.
    travel = texts.select("doc_id", "h", "text").mapInArrow(squeeze, f"doc_id {kind}, h binary, small binary")
    return travel.join(lists.hint("merge"), "h", "left").select("doc_id", "small", "known").mapInArrow(
        encode, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def decoded(ids: np.ndarray, table: list[bytes]) -> str:
    """The text behind ids; bytes that are no UTF-8 become the replacement character."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def op11_shared_chunk_bpe(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them; see ``encode_corpus``."""
    made = encode_corpus(docs, tokenizer or default_tokenizer())
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
