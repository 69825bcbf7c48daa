"""Byte-level BPE encoding and decoding by a monoid tree reduction.

Encodings of byte strings form a monoid: ``join(encode(x), encode(y))`` is
``encode(x + y)``. A pre-token's leaves are its single bytes, which encode
themselves; all longer encodings come from joins of neighbours, level by level up
the tree. A join re-encodes a window of tokens about the seam, merging by ranks,
and lets it grow until the tokens outside are proven to stay.

The proof: a sequence of tokens is the encoding of its bytes if and only if each
pair of neighbours is the encoding of the pair's bytes. The window is an
encoding itself, and so are both outer parts; only the two pairs at the
window's ends can be new, and those that are get encoded and compared. If the two
tokens at the seam stay, no pair is new. A window that takes in everything is
right at once. Texts are trees too, whose upper nodes join
pre-tokens, over whose ends no merge reaches.

A worker keeps the ids of pre-tokens, and of chunks of them, in bounded caches,
so that it goes through the tree of each frequent one once. Decoding
concatenates the tokens' bytes pair by pair, level by level.

Null texts are empty (no tokens); null ids, repeated rows, empty tables, very
long texts and other columns of any name are fine: one result for each row.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, small_batches, strings
from .pretokens import ChunkValues, Kept, read_ranks, vocabulary_path

#: Pre-tokens, and windows of a few tokens, whose ids a worker keeps.
CACHE_ENTRIES, WINDOW_ENTRIES = 300_000, 500_000
#: Tokens of windows that are kept, at most.
KEPT_TOKENS = 4
SLICE_BYTES = 2 << 20


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.ones = {i: (i,) for i in ranks.values()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.windows = Kept(lambda ids: tuple(self.merge(ids)), WINDOW_ENTRIES)
        self.joins = 0
        self.chunks = ChunkValues(pattern, lambda piece: self.encode_piece(piece.encode("utf-8", "surrogatepass")), lambda parts: list(chain.from_iterable(parts)), entries)

    def merge(self, ids) -> list[int]:
        """The encoding of the bytes of some tokens: from single bytes, the
        neighbours of the least rank are merged first, the leftmost of equals."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        ranks, n = self.ranks, len(raw)
        stop = list(range(1, n + 1))  # where the part that begins here ends, 0 if none does
        before = list(range(-1, n - 1))
        queue = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
        heapify(queue)
        while queue:
            _, k, end = heappop(queue)
            middle = stop[k]
            if not middle or middle >= n or stop[middle] != end:
                continue  # one of its parts has been merged since
            stop[k], stop[middle] = end, 0
            if end < n:
                before[end] = k
                if (r := ranks.get(raw[k : stop[end]])) is not None:
                    heappush(queue, (r, k, stop[end]))
            if (p := before[k]) >= 0 and (r := ranks.get(raw[p:end])) is not None:
                heappush(queue, (r, p, end))
        out, k = [], 0
        while k < n:
            out.append(ranks[raw[k : stop[k]]])
            k = stop[k]
        return out

    def window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        return self.windows[ids] if len(ids) <= KEPT_TOKENS else tuple(self.merge(ids))

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both parts' bytes, from the parts' encodings."""
        self.joins += 1
        seam = a[-1], b[0]
        window = self.windows[seam]
        if window == seam:
            return a + b
        left = right = 1
        while True:
            first, last = window[0], window[-1]
            # a pair of one part's own tokens stays, as the part is an encoding
            left_holds = left == len(a) or first == a[-left] or self.windows[pair := (a[-left - 1], first)] == pair
            right_holds = right == len(b) or last == b[right - 1] or self.windows[pair := (last, b[right])] == pair
            if left_holds and right_holds:
                return a[: len(a) - left] + window + b[right:]
            if not left_holds:
                left = min(2 * left, len(a))
            if not right_holds:
                right = min(2 * right, len(b))
            window = self.window(a[len(a) - left :] + b[:right])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Neighbours are joined, level by level; what is left over at a level's
        end goes up as it is. The depth is the logarithm of the length."""
        if not piece:
            return ()
        leaves = list(map(self.single.__getitem__, piece))
        # of two bytes the window is everything
        ids = iter(leaves)
        parts = list(map(self.windows.__getitem__, zip(ids, ids)))
        self.joins += len(parts)
        if len(leaves) % 2:
            parts.append(self.ones[leaves[-1]])
        while len(parts) > 1:
            last = parts[-1:] if len(parts) % 2 else []
            own = iter(parts)
            parts = list(map(self.join, own, own)) + last
        return parts[0]

    def encode(self, text: str) -> list[int]:
        """Ids of the text; those of its pre-tokens follow each other."""
        return self.chunks.value(text)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ``ids``, neighbours concatenated up the tree."""
        parts = list(map(self.bytes.__getitem__, ids))
        while len(parts) > 1:
            last = parts[-1:] if len(parts) % 2 else []
            own = iter(parts)
            parts = list(map(add, own, own)) + last
        return parts[0] if parts else b""


def _tree(path: str, pattern: str) -> TreeBPE:
    return TreeBPE(read_ranks(path), pattern)


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    folder: str | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """``(id, ids array<int> or null, n_tokens, ids_sha256, decoded_sha256)``:
    ids of the whole text, digests of the ids in decimal with one space between
    and of the bytes decoded from the ids. ``keep_ids=False`` leaves ids out."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    path, pattern = vocabulary_path(vocabulary, folder), public_tokenizers.PATTERN
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encode(batches):
        tree = held(_tree, path, pattern)
        decimal = [str(i) for i in range(max(tree.bytes) + 1)]
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, n, written, decoded = [], [], [], []
            for own in map(tree.encode, strings(batch, "text")):
                ids.append(own if keep_ids else None)
                n.append(len(own))
                written.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tree.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``(id, decoded binary)`` of every row; null ids decode to no bytes."""
    import public_tokenizers

    path, pattern = vocabulary_path(vocabulary, folder), public_tokenizers.PATTERN
    kind = rows.schema[id_col].dataType.simpleString()

    def decode(batches):
        tree = held(_tree, path, pattern)
        for batch in batches:
            out = [tree.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "decoded"])

    own = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(decode, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
