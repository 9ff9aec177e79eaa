"""Token ids in patched frame-of-reference blocks (operator 8).

A segment is one self-contained file image: a magic number, counts, the documents' keys and lengths, an index of block
starts, then blocks of 128 ids. A block holds its minimum, a bit width that the percentile asked for fits, the low ids
packed at that width, and an exception list (position, value) for those that do not fit. Segments are stored as rows of
a Parquet table, so that writing them needs no more than Spark's own file access and commits, on any store.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import MEMO, Memo, Splitter, byte_alphabet, once
from .common import whole_texts, written

BLOCK = 128
MAGIC = b"QPF1"
#: Ids after which a segment is closed (a longer document gets a segment of its own length).
SEGMENT_IDS = 1 << 18
_BITS = np.concatenate([[0], np.repeat(np.arange(1, 17), 1 << np.arange(16))]).astype(np.uint8)  # of numbers of 16 bits
#: What the library's byte-level pre-tokenizer cuts, with the commonest alternative first: no two can begin alike but the
#: last ones, so the order of the others does not matter.
PIECES = r""" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Blocks of ``ids`` (unsigned 32-bit) behind an index of their starts."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = grid - low[:, None]
    high = rest >> 16
    need = np.where(high > 0, 16 + _BITS[high], _BITS[rest & 0xFFFF]) if high.any() else _BITS[rest]  # bits of each value; 0 for 0
    width = np.sort(need, axis=1)[:, int(percentile * (BLOCK - 1))] if blocks else np.empty(0, np.uint8)
    odd = need > width[:, None]
    n_odd = odd.sum(axis=1)
    rest = np.where(odd, 0, rest).astype(np.uint64)
    sizes = 6 + 16 * width.astype(np.int64) + 5 * n_odd
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.empty(starts[-1], np.uint8)
    begin = starts[:-1]
    body[begin[:, None] + np.arange(4)] = low.view(np.uint8).reshape(-1, 4)
    body[begin + 4], body[begin + 5] = width, n_odd
    # 128 values at width w fill 2 w words of 64 bits; one pass for each position, over all blocks of a width
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out = np.zeros((2 * w, len(at)), np.uint64)
        values = np.ascontiguousarray(rest[at].T)
        for k in range(BLOCK if w else 0):
            word, bit = divmod(k * w, 64)
            out[word] |= values[k] << np.uint64(bit)
            if bit + w > 64:
                out[word + 1] |= values[k] >> np.uint64(64 - bit)
        body[(begin[at] + 6)[:, None] + np.arange(16 * w)] = np.ascontiguousarray(out.T).view(np.uint8).reshape(len(at), 16 * w)
    block, where = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    tail = begin[block] + 6 + 16 * width[block].astype(np.int64)
    body[tail + nth] = where
    body[(tail + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = (grid[block, where] - low[block]).view(np.uint8).reshape(-1, 4)
    return struct.pack("<II", n, blocks) + starts.astype(np.uint32).tobytes() + body.tobytes()


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (default: all), found by the index."""
    n, blocks = struct.unpack_from("<II", data)
    starts = np.frombuffer(data, np.uint32, blocks + 1, 8).astype(np.int64) + 8 + 4 * (blocks + 1)
    last = blocks if last is None else min(last, blocks)
    count = max(0, last - first)
    if not count:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    begin = starts[first:last]
    low = np.ascontiguousarray(raw[begin[:, None] + np.arange(4)]).view(np.uint32)[:, 0]
    width, n_odd = raw[begin + 4], raw[begin + 5]
    out = np.empty((count, BLOCK), np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if not w:
            out[at] = 0
            continue
        words = np.ascontiguousarray(raw[(begin[at] + 6)[:, None] + np.arange(16 * int(w))]).view(np.uint64).T.copy()
        mask, values = np.uint64((1 << int(w)) - 1), np.empty((BLOCK, len(at)), np.uint32)
        for k in range(BLOCK):
            word, bit = divmod(k * int(w), 64)
            v = words[word] >> np.uint64(bit)
            if bit + int(w) > 64:
                v = v | (words[word + 1] << np.uint64(64 - bit))
            values[k] = v & mask
        out[at] = values.T
    block = np.repeat(np.arange(count), n_odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd, dtype=np.int64) - n_odd, n_odd)
    tail = begin[block] + 6 + 16 * width[block].astype(np.int64)
    late = raw[(tail + n_odd[block] + 4 * nth)[:, None] + np.arange(4)]
    out[block, raw[tail + nth]] = np.ascontiguousarray(late).view(np.uint32).reshape(-1)
    return (out + low[:, None]).reshape(-1)[: n - first * BLOCK if last == blocks else count * BLOCK]


def segment(keys: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float) -> bytes:
    """One file image; a null key is kept by a flag."""
    known = np.array([k is not None for k in keys], np.uint8)
    head = MAGIC + struct.pack("<I", len(keys)) + np.array([k or 0 for k in keys], np.int64).tobytes()
    return head + known.tobytes() + np.array(lengths, np.uint32).tobytes() + pack(ids, percentile)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    (n,) = struct.unpack_from("<I", data, 4)
    keys, known = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n)
    lengths = np.frombuffer(data, np.uint32, n, 8 + 9 * n)
    return [int(k) if f else None for k, f in zip(keys, known)], lengths, unpack(data[8 + 13 * n :])


class LibraryCodec:
    """The tokenizers library, asked once for each distinct pre-token; special strings are cut out as the library does."""

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer

        model = Tokenizer.from_str(spec).model
        shown = dict(enumerate(byte_alphabet()))
        self.special = {x["content"]: np.uint32(x["id"]).tobytes() for x in json.loads(spec)["added_tokens"]}
        self.split = Splitter(PIECES, list(self.special))

        space, tokenize = shown[32], model.tokenize

        def ids_of(piece: str) -> bytes:
            if piece in self.special:
                return self.special[piece]
            plain = piece.isascii() and piece.isprintable()  # only a space is then shown as another sign
            form = piece.replace(" ", space) if plain else piece.encode("utf-8").decode("latin-1").translate(shown)
            return array("I", [t.id for t in tokenize(form)]).tobytes()

        self.ids_of = Memo(ids_of, 2 * MEMO).__getitem__

    def pieces(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.special):
            return [t for k, p in enumerate(self.split.cut(text)) for t in ([p] if k % 2 else self.split.find(p))]
        return self.split.find(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.ids_of, self.pieces(text)))


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 0, percentile: float = 0.9) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write all ids in ascending key order as segments; returns the table.

    Columns: part, seg (order of the segments), part_start (ids before it in its part), n_ids, data (the file image).
    Keys are dealt by range, with the text's hash as a second key, so that one repeated key does not fill one task.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = once(("library", vocabulary), lambda: LibraryCodec(spec.value))
        part, seg, done = TaskContext.get().partitionId(), 0, 0
        end = np.uint32(end_id).tobytes()
        keys: list = []
        held: list[bytes] = []
        size = 0

        def close():
            ids = np.frombuffer(b"".join(held), np.uint32)
            data = segment(keys, [len(h) // 4 for h in held], ids, percentile)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "part_start": pa.array([done], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                data = codec.encode(text.as_py())
                keys.append(key.as_py())
                held.append(data + end)
                size += len(data) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    seg, done = seg + 1, done + size
                    keys, held, size = [], [], 0
        if keys:
            yield close()

    ordered = whole_texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("doc_id"), F.col("h"))
    ordered = ordered.sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, seg int, part_start long, n_ids long, data binary"), "ids", "none")


def read_ids(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read segments back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if asked for."""
    import pyarrow as pa

    # one row for each part of the table, as many as there were tasks
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0), batch.column(1)):
                keys, lengths, ids = read_segment(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw, begins = ids.tobytes(), ends - lengths
                cut = [raw[4 * a : 4 * b] for a, b in zip(begins, ends)]
                cols = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(begins + start.as_py(), pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array([crc32(c) for c in cut], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def ids_file(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts hold the end id alone; rows with a null key come first; rows with equal keys follow each other in
    the order of their texts' hashes, each with its own start; an empty table gives no rows; extra columns are ignored.
    """
    return read_ids(write_ids(docs, vocabulary, end_id))
