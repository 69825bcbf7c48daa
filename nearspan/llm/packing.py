"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's ids and an end
id are cut into whole windows and a rest; the rest goes to the open window that
it fits best. When none has room, the fullest is filled up with the head of the
rest and emitted, so that no window is emitted with a gap. At the end of the
partition the open windows are merged: their pieces are concatenated and cut
again into whole windows, and the last, partial one into sequences whose lengths
are powers of two, which need no padding. Memory is a few windows and one slice
of texts; nothing is shuffled or sent to one task.

Sequence ids hold the partition's number in their upper half and are the same
when a partition is computed again. Null texts are empty (only the end id); null
ids, repeated rows, empty tables and other columns of any name are fine: each
row is a document of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, small_batches, strings
from .pretokens import ChunkValues, Library, vocabulary_path

CAPACITY = 1024
OPEN_WINDOWS = 32
#: Pre-tokens, and chunks of them, whose ids a worker keeps.
CACHE_ENTRIES = 300_000
SLICE_BYTES = 2 << 20

#: One piece: index of its document, start in the document, length.
Piece = tuple[int, int, int]


class IdBytes:
    """Ids of whole texts as little-endian 32-bit words, each distinct pre-token
    encoded once by the library."""

    def __init__(self, vocabulary: str, pattern: str, entries: int = CACHE_ENTRIES):
        self.library = Library(vocabulary)
        self.chunks = ChunkValues(pattern, self.measure, b"".join, entries)

    def measure(self, piece: str) -> bytes:
        ids = self.library.piece(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def words(self, text: str) -> bytes:
        # a text with a special token's string is left to the library as a whole
        if not self.library.by_piece or any(s in text for s in self.library.special):
            return np.asarray(self.library.encode(text), "<u4").tobytes()
        return self.chunks.value(text)


class Packer:
    """Takes documents' lengths in order, gives windows as they are closed."""

    def __init__(self, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS):
        self.capacity, self.most = capacity, windows
        self.open: list[tuple[int, list[Piece]]] = []  # room left, pieces

    def add(self, doc: int, length: int) -> Iterator[list[Piece]]:
        start = 0
        while length - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        while (rest := length - start) > 0:
            fits = [k for k, (room, _) in enumerate(self.open) if room >= rest]
            if fits:
                best = min(fits, key=lambda k: self.open[k][0])
            elif len(self.open) < self.most:
                self.open.append((self.capacity, []))
                best = len(self.open) - 1
            else:
                best = min(range(len(self.open)), key=lambda k: self.open[k][0])
            room, pieces = self.open[best]
            size = min(room, rest)
            pieces.append((doc, start, size))
            start += size
            if room == size:
                del self.open[best]
                yield pieces
            else:
                self.open[best] = (room - size, pieces)

    def close(self) -> Iterator[list[Piece]]:
        """Merges what is open: whole windows first, then powers of two."""
        pieces = [p for _, own in sorted(self.open, key=lambda w: w[0]) for p in own]
        self.open = []
        total = sum(p[2] for p in pieces)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
        pieces.reverse()
        for size in sizes:
            window = []
            while size:
                doc, start, length = pieces.pop()
                used = min(size, length)
                window.append((doc, start, used))
                size -= used
                if used < length:
                    pieces.append((doc, start + used, length - used))
            yield window


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    folder: str | None = None,
    capacity: int = CAPACITY,
    windows: int = OPEN_WINDOWS,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """A row for each piece: ``(id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids])``. Each id of each document lies in one piece;
    pieces of a sequence follow each other without gaps from offset 0."""
    import public_tokenizers

    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)
    path, pattern = vocabulary_path(vocabulary, folder), public_tokenizers.PATTERN
    kind = docs.schema[id_col].dataType
    fields = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    schema = f"id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields) + ", ids binary" * keep_ids
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encode, packer = held(IdBytes, path, pattern), Packer(capacity, windows)
        sequence = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # documents with ids in open windows: id, ids, number of ids, ids not yet emitted
        at = 0
        id_type = None

        def emit(closed):
            nonlocal sequence
            rows = []
            for window in closed:
                offset = 0
                for doc, start, length in window:
                    own = waiting[doc]
                    ids = memoryview(own[1])[4 * start : 4 * (start + length)]
                    rows.append((own[0], start, length, zlib.crc32(ids), own[2], sequence, offset, bytes(ids) if keep_ids else None))
                    offset += length
                    own[3] -= length
                    if not own[3]:
                        del waiting[doc]
                sequence += 1
            columns = list(zip(*rows)) if rows else [[]] * 8
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            names = ["id", *(n for n, _ in fields)]
            if keep_ids:
                arrays, names = [*arrays, pa.array(columns[7], pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in slices(batches, "text", SLICE_BYTES):
            id_type = batch.schema.field("id").type
            closed = []
            for key, words in zip(batch.column("id").to_pylist(), map(encode.words, strings(batch, "text"))):
                n = len(words) // 4 + 1
                waiting[at] = [key, words + end, n, n]
                closed += packer.add(at, n)
                at += 1
            yield emit(closed)
        if at:
            yield emit(packer.close())

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
