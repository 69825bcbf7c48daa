"""Suffix-array dedup: removes what repeats an earlier byte string of a given length.

A window is a string of ``length`` bytes (100) within a text. Each byte of a
window that also starts earlier - in a smaller id, or before in the text - is
removed; windows are judged on the input. Hashes bring texts together, suffix
arrays decide:

1. A window's anchor is its 32-byte gram of the least hash; it depends on the
   window's bytes alone. Windows that follow each other with one anchor form a
   segment. A segment that looks like an earlier one (128 bits of two hashes)
   claims to repeat it; claims of segments that follow each other are one. They
   are found in each map task first, so that a task deals one of each kind, and
   between tasks by anchor. Different segments of one anchor may share windows.
2. The bytes that claims are about are fetched once, from both sides, and so
   are the bytes of an anchor's different segments. They are dealt to shards, by
   place in the claimed text or by anchor. The shard's suffix array is made by
   induced sorting, and the permuted common prefixes show which windows are
   equal. Only what they show is removed: no hash removes a byte.
3. Each document's spans are joined and cut out.

Nothing is gathered without bound. A claimed text with many copies goes to
shards of ``SALTED`` copies each, every one with the claimed text; what a task
holds of a long shard is cut into suffix arrays, again each with the claimed
text. An anchor of more than ``CROWDED`` different segments (about the edges of
a very common line) is too coarse: the windows of its segments make claims one
by one, by their own hashes, which spread. All this follows exact counts over all
texts and changes the way, not the result.

Null texts are empty. Rows without an id take no part: nothing is removed. Ids
have to be numbers. Rows of one id with equal texts are one document; with
different texts they are documents in the order of the texts' checksums. Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches, strings
from .near_duplicates import mix
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
#: Bytes of text hashed at a time, and rows gathered before equal segments are put together.
PIECE_BYTES, FLUSH_ROWS = 1 << 20, 200_000
#: Bytes of segments in one suffix array, and of a claimed text in one shard.
SHARD_BYTES, CHUNK_BYTES = 2 << 20, 4096
#: Copies of a claimed segment in one shard.
SALTED = 4096
#: Different segments of an anchor up to which they meet in a shard; each has at most 168 bytes.
CROWDED = 4096

_RNG = np.random.default_rng(77)
_VALUES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 1 for x in _RNG.integers(1 << 40, 1 << 62, 2)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in _BASES:
            inverse = pow(base, -1, 1 << 64)
            _POWERS.append(tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE_BYTES + 2 * LENGTH + 8, x, np.uint64)]) for x in (base, inverse)))
    return _POWERS[which]


class _Hashes:
    """Hashes of all substrings of a buffer by two independent polynomials."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for which in (0, 1):
            up, _ = _powers(which)
            self.sums.append(np.r_[np.uint64(0), np.cumsum(_VALUES[which][data] * up[: len(data)])])

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _powers(which)
        return mix((self.sums[which][end] - self.sums[which][start]) * down[start] + (end - start).astype(np.uint64))

    def all(self, which: int, width: int) -> np.ndarray:
        """Of all substrings of a width, by place."""
        _, down = _powers(which)
        sums = self.sums[which]
        n = len(sums) - width
        return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, single: bool = False) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other in ``data`` and end at ``ends``: anchor,
    other hash, start and end of each segment, and how far from its start its
    anchor is. The windows of all segments are all windows. With ``single``, each window is a segment with its own hash."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < length:
        return none
    n, grams = len(data) - length + 1, length - GRAM + 1
    begins = np.r_[0, ends[:-1]]
    steps = np.zeros(len(data) + 2, np.int64)
    whole = ends - begins >= length
    np.add.at(steps, begins[whole], 1)
    np.add.at(steps, ends[whole] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(steps)[:n] > 0)
    if not len(at):
        return none
    hashes = _Hashes(data)
    if single:
        return hashes.of(0, at, at + length), hashes.of(1, at, at + length), at, at + length, np.zeros(len(at), np.int64)
    gram = hashes.all(0, GRAM)
    # the least hash of each window and its leftmost place, in one word
    key = gram >> np.uint64(24) << np.uint64(24) | np.arange(len(gram), dtype=np.uint64)
    anchor = (least_in_windows(key, grams)[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
    fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]])]
    first, last = at[fresh], at[np.r_[fresh[1:], True]]
    return gram[anchor[first]], hashes.of(1, first, last + length), first, last + length, anchor[first] - first


def pieces(texts: list[bytes], length: int = LENGTH, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of a bounded size: bytes, ends of their parts, each part's text
    and its place there. Long texts are cut so that each window is in one part."""
    parts, size = [], 0

    def done():
        data = np.frombuffer(b"".join(texts[k][a:b] for k, a, b in parts), np.uint8)
        return data, np.cumsum([b - a for _, a, b in parts]), np.array([k for k, _, _ in parts]), np.array([a for _, a, _ in parts])

    for k, text in enumerate(texts):
        for a in range(0, max(0, len(text) - length + 1), most - length):
            b = min(len(text), a + most - 1)
            if size + b - a > most and parts:
                yield done()
                parts, size = [], 0
            parts.append((k, a, b))
            size += b - a
    if parts:
        yield done()


#: A place that repeats, or is, the place (a, b, origin) of id, tag and start; a
#: segment by anchor (a, at origin from its start) and other hash (b); such segments
#: of an anchor that has too many.
CLAIM, SEGMENT, MANY = 0, 1, 2
_NAMES = ["kind", "a", "b", "id", "tag", "start", "stop", "origin"]
_ROW = "kind int, " + ", ".join(f"{n} long" for n in _NAMES[1:])


def _rows(*parts: tuple, names: list[str] = _NAMES) -> pa.RecordBatch:
    """Parts of (kind, other columns) as one batch."""
    kinds = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.concatenate([p[k] for p in parts])) for k in range(1, len(names)))], names)


def _merged(keys: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Spans with those of equal keys that touch put together: keys, start, stop."""
    order = np.lexsort((start, *keys[::-1]))
    keys, start, stop = [k[order] for k in keys], start[order], stop[order]
    if not len(start):
        return [*keys, start, stop]
    own = np.zeros(len(start), bool)
    own[0] = True
    for k in keys:
        own[1:] |= k[1:] != k[:-1]
    group = np.cumsum(own) - 1
    # places of later groups lie beyond all of earlier ones
    far = int(stop.max() - min(0, start.min())) + 1
    reach = np.maximum.accumulate(stop + group * far)
    fresh = own | np.r_[True, start[1:] + group[1:] * far > reach[:-1]]
    return [*(k[fresh] for k in keys), start[fresh], reach[np.r_[fresh[1:], True]] - group[fresh] * far]


def _claims(place: list[np.ndarray], stop: np.ndarray, head: list[np.ndarray]) -> tuple:
    """Rows of claims (of places id, tag, start, to such heads) and of their
    heads to themselves, those that follow each other put together."""
    key, tag, start = place
    rid, rtag, away, key, tag, begin, end = _merged([head[0], head[1], start - head[2], key, tag], start, stop)
    own = _merged([head[0], head[1]], head[2], head[2] + stop - start)
    none = (CLAIM, *(np.zeros(0, np.int64) for _ in range(7)))
    return (CLAIM, rid, rtag, key, tag, begin, end, begin - away) if len(key) else none, (CLAIM, own[0], own[1], own[0], own[1], own[2], own[3], own[2]) if len(key) else none


class _Found:
    """Segments of a task's texts: one of each kind, and claims of the others."""

    def __init__(self, most_rows: int):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.most = 0, most_rows

    def add(self, anchor, other, key, tag, start, stop, origin) -> Iterator[pa.RecordBatch]:
        self.held.append((anchor, other, key, tag, start, stop, origin))
        self.size += len(anchor)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        anchor, other, key, tag, start, stop, origin = (np.concatenate([h[k] for h in self.held]) for k in range(7))
        self.held, self.size = [], 0
        order = np.argsort(anchor)
        by = anchor[order]
        same = by[1:] == by[:-1]
        several = np.flatnonzero(np.r_[False, same] | np.r_[same, False])  # rows whose anchor is not alone
        some = order[several]
        order[several] = some[np.lexsort((start[some], tag[some], key[some], other[some], anchor[some]))]
        anchor, other, key, tag, start, stop, origin = (c[order] for c in (anchor, other, key, tag, start, stop, origin))
        first = np.r_[True, (anchor[1:] != anchor[:-1]) | (other[1:] != other[:-1])]
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        # rows of one place (a document that occurs twice) don't repeat each other
        later = (key != key[head]) | (tag != tag[head]) | (start != start[head])
        of = head[later]
        claims = _claims([key[later], tag[later], start[later]], stop[later], [key[of], tag[of], start[of]])
        yield _rows((SEGMENT, anchor[first].view(np.int64), other[first].view(np.int64), key[first], tag[first], start[first], stop[first], origin[first]), *claims)


def _found(docs: DataFrame, length: int) -> DataFrame:
    """Rows of ``_ROW``: segments, and claims on earlier ones of the task."""

    def run(batches):
        found = _Found(FLUSH_ROWS)
        for batch in slices(batches, "text", 2 * PIECE_BYTES):
            ids = batch.column("id").to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in strings(batch, "text")]
            tags = np.array([zlib.crc32(t) for t in texts], np.int64)
            for data, ends, of, begins in pieces(texts, length, PIECE_BYTES):
                anchor, other, first, stop, origin = segments(data, ends, length)
                part = np.searchsorted(ends, first, side="right")
                shift = begins[part] - np.r_[0, ends[:-1]][part]
                yield from found.add(anchor, other, ids[of[part]], tags[of[part]], first + shift, stop + shift, origin)
        yield from found.flush()

    return docs.mapInArrow(run, _ROW)


def _met(found: DataFrame) -> DataFrame:
    """By anchor: claims of segments on the earliest of their kind, and one
    segment of each kind where an anchor has several. The stream is in order of
    anchor and kind; of the last ones only the earliest place, a count, and at
    most ``CROWDED`` segments are held. ``salt`` numbers shards of copies."""
    names = [*_NAMES, "salt"]

    def run(batches):
        last: list[np.ndarray] | None = None  # all but the row's kind, of the earliest of the last segment's kind
        nth = 0  # rows of that kind before
        waiting: list[list[np.ndarray]] = []  # one segment of each kind of the last anchor
        crowded = False

        def segments_of(rows: list[np.ndarray], kind: int):
            a, _, key, tag, start, stop, origin = rows
            zero = np.zeros(len(a), np.int64)
            return (kind, a, zero, key, tag, start, stop, origin, zero)

        def judge(rows: list[np.ndarray]):
            nonlocal last, nth, waiting, crowded
            kind, a, b, key, tag, start, stop, origin = rows
            claims = kind == CLAIM
            out = [(CLAIM, *(c[claims] for c in (a, b, key, tag, start, stop, origin)), np.zeros(int(claims.sum()), np.int64))]
            seg = [c[~claims] for c in (a, b, key, tag, start, stop, origin)]
            if not len(seg[0]):
                return _rows(*out, names=names)
            known = last is not None
            if known:
                seg = [np.concatenate(x) for x in zip(last, seg)]
            a, b, key, tag, start, stop, _ = seg
            fresh = np.r_[True, a[1:] != a[:-1]]
            first = fresh | np.r_[True, b[1:] != b[:-1]]
            heads = np.flatnonzero(first)
            head = heads[np.cumsum(first) - 1]
            count = np.arange(len(a)) - head
            if known:  # the first kind goes on
                count[: heads[1] if len(heads) > 1 else len(a)] += nth
            later = (key != key[head]) | (tag != tag[head]) | (start != start[head])
            salt, of = count[later] // SALTED, head[later]
            out.append((CLAIM, key[of], tag[of], key[later], tag[later], start[later], stop[later], start[of], salt))
            # the earliest itself, once for each shard of its copies
            shards = np.ones(len(of), bool)
            shards[1:] = (of[1:] != of[:-1]) | (salt[1:] != salt[:-1])
            of, salt = of[shards], salt[shards]
            out.append((CLAIM, key[of], tag[of], key[of], tag[of], start[of], stop[of], start[of], salt))
            last, nth = [c[head[-1:]] for c in seg], int(count[-1])
            # segments of several kinds: of whole anchors at once, of the last as it goes on
            if known:
                heads = heads[1:]
            if len(heads):
                group = np.cumsum(fresh)[heads]
                goes_on = known & (group == 1)
                ended = group < group[-1]
                if (waiting or crowded) and not goes_on.all():
                    mine = [c[heads[goes_on]] for c in seg]
                    out += wait(mine)
                    out += done()
                    heads, group, ended, goes_on = heads[~goes_on], group[~goes_on], ended[~goes_on], goes_on[~goes_on]
                if len(heads):
                    kinds = np.bincount(group)[group]
                    some = ended & (kinds > 1)
                    for which, k in ((some & (kinds <= CROWDED), SEGMENT), (some & (kinds > CROWDED), MANY)):
                        out.append(segments_of([c[heads[which]] for c in seg], k))
                    out += wait([c[heads[~ended]] for c in seg])
            return _rows(*out, names=names)

        def wait(rows: list[np.ndarray]):
            nonlocal waiting, crowded
            if len(rows[0]):
                waiting.append(rows)
            if crowded or sum(len(w[0]) for w in waiting) > CROWDED:
                crowded = True
                out = [segments_of(w, MANY) for w in waiting]
                waiting = []
                return out
            return []

        def done():
            """The last anchor has ended."""
            nonlocal waiting, crowded
            several = sum(len(w[0]) for w in waiting) > 1
            out = [segments_of(w, SEGMENT) for w in waiting] if several else []
            waiting, crowded = [], False
            return out

        for batch in batches:
            if batch.num_rows:
                yield judge([batch.column(c).to_numpy() for c in _NAMES])
        if some := done():
            yield _rows(*some, names=names)

    ordered = found.repartition(F.col("a")).sortWithinPartitions("a", "b", "id", "tag", "start")
    return ordered.mapInArrow(run, f"{_ROW}, salt long")


def equal_windows(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Parts of texts: id, tag, place in the text, bytes. Spans (id, tag, start,
    stop) of the windows of one shard that also start earlier."""
    raw = b"\0".join(parts) + b"\0"
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    plain = np.frombuffer(raw, np.uint8)
    t = np.zeros(len(raw) + 1, np.int32)
    t[:-1] = plain
    t[:-1] += 2
    t[ends - 1] = 1  # after each part
    order = suffix_array(t, 258)
    order = order[1:]  # without the end of all
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(part))  # bytes up to the part's end
    window = left >= length
    shared = permuted_common_prefixes(plain, order, length, window)
    fits = order[window[order]]
    # equal windows are neighbours in the array; a neighbour left out has no window
    joined = np.zeros(len(fits), bool)
    joined[1:] = shared[fits[1:]] >= length
    if not joined.any():
        return [np.zeros(0, np.int64)] * 4
    ranked = np.lexsort((tags, ids))
    fresh = np.r_[False, (ids[ranked][1:] != ids[ranked][:-1]) | (tags[ranked][1:] != tags[ranked][:-1])]
    document = np.empty(len(ids), np.int64)
    document[ranked] = np.cumsum(fresh)
    place = ((document << 40) + starts - begins)[part[fits]] + fits
    heads = (~joined).nonzero()[0]
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.r_[heads, len(fits)]))
    later = np.zeros(len(part), bool)
    later[fits[place > least]] = True
    # runs of windows that touch, by place in the shard
    at = later.nonzero()[0]
    own = part[at]
    first = np.ones(len(at), bool)
    first[1:] = (own[1:] != own[:-1]) | (at[1:] > at[:-1] + length)
    of = own[first]
    start = at[first] - begins[of] + starts[of]
    stop = at[np.r_[first[1:], True]] - begins[of] + starts[of] + length
    return [ids[of], tags[of], start, stop]


def _flat(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, np.ndarray]:
    """What is wanted of a batch's texts, a row each, ``row`` first; what is of
    another text of the id is left out."""
    wanted = batch.column("wanted")
    rows = np.repeat(np.arange(len(wanted)), pa.compute.list_value_length(wanted).to_numpy())
    flat = wanted.flatten()
    out = {"row": rows} | {f.name: flat.field(k).to_numpy() for k, f in enumerate(flat.type)}
    tags = np.array([zlib.crc32(t) for t in texts], np.int64)
    own = out["tag"] == tags[rows]
    return {n: c[own] for n, c in out.items()}


def _gathered(docs: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with what is wanted of them; as much as a text has segments."""
    wanted = asked.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    # always dealt by id: at any size the plan is the same, and the exchange of
    # the texts serves the last join too
    return docs.join(wanted.hint("merge"), "id")


def _single(docs: DataFrame, many: DataFrame, length: int) -> DataFrame:
    """Rows of ``_ROW`` for each window of segments whose anchors are crowded."""

    def run(batches):
        found = _Found(FLUSH_ROWS)
        for batch in slices(batches, "text", PIECE_BYTES):
            ids, texts = batch.column("id").to_numpy(), [t.encode("utf-8", "surrogatepass") for t in strings(batch, "text")]
            w = _flat(batch, texts)
            row, tag, start, stop = _merged([w["row"], w["tag"]], w["start"], w["stop"])
            parts = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
            for data, ends, of, begins in pieces(parts, length, PIECE_BYTES):
                anchor, other, first, last, origin = segments(data, ends, length, single=True)
                part = np.searchsorted(ends, first, side="right")
                shift = begins[part] - np.r_[0, ends[:-1]][part] + start[of[part]]
                yield from found.add(anchor, other, ids[row[of[part]]], tag[of[part]], first + shift, last + shift, origin)
        yield from found.flush()

    return _gathered(docs, many, ["tag", "start", "stop"]).mapInArrow(run, _ROW)


def _dealt(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Bytes of texts by shard (route); those of the claimed text first (rest 0)."""

    def fetch(batches):
        for batch in slices(batches, "text", PIECE_BYTES):
            ids, texts = batch.column("id").to_numpy(), [t.encode("utf-8", "surrogatepass") for t in strings(batch, "text")]
            w = _flat(batch, texts)
            claim = w["kind"] == CLAIM
            row, tag, a, b, salt, away, start, stop = _merged([w[n][claim] for n in ("row", "tag", "a", "b", "salt")] + [(w["start"] - w["origin"])[claim]], w["start"][claim], w["stop"][claim])
            # by the windows' places in the claimed text, in chunks
            first, last = (start - away) // CHUNK_BYTES, np.maximum(start, stop - length) - away
            n = last // CHUNK_BYTES - first + 1
            piece = np.repeat(np.arange(len(row)), n)
            chunk = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(start[piece], chunk * CHUNK_BYTES + away[piece])
            end = np.minimum(stop[piece], (chunk + 1) * CHUNK_BYTES + length - 1 + away[piece])
            row, tag, a, b, salt, away = (c[piece] for c in (row, tag, a, b, salt, away))
            head = (ids[row] == a) & (tag == b) & (away == 0)
            route = np.full(len(row), 1, np.uint64)
            for c in (a, b, salt, chunk):
                route = mix(route ^ c.view(np.uint64)) + np.uint64(1)
            other = [w[n][~claim] for n in ("row", "tag", "start", "stop", "a", "origin")]
            row, tag, begin, end = (np.r_[x, y] for x, y in zip((row, tag, begin, end), other))
            route = np.r_[route.view(np.int64), mix(other[4].view(np.uint64)).view(np.int64)]
            rest = np.r_[~head, np.ones(len(other[0]), bool)]
            which = np.r_[np.full(len(row) - len(other[0]), -1), np.arange(len(other[0]))]
            # claims of a text to one shard whose places overlap are one; segments stay as they are
            row, tag, route, rest, which, begin, end = _merged([row, tag, route, rest, which], begin, end)
            at = np.r_[other[5], -1][which]
            raw = [texts[r][x:y] for r, x, y in zip(row.tolist(), begin.tolist(), end.tolist())]
            arrays = [pa.array(route), pa.array(rest.astype(np.int32)), pa.array(ids[row]), pa.array(tag), pa.array(begin), pa.array(at), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["route", "rest", "id", "tag", "start", "anchor", "bytes"])

    asked = _gathered(docs, asked, ["kind", "tag", "start", "stop", "a", "b", "origin", "salt"])
    return asked.mapInArrow(fetch, "route long, rest int, id long, tag long, start long, anchor long, bytes binary")


def with_company(parts: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Of different segments of one anchor (id, tag, start, anchor, bytes), those
    that can share a window with another: of what a window has beside its
    anchor, half or more is on one side, and that side's bytes must be shared."""
    half = (length - GRAM) // 2
    sides = []
    for *_, at, raw in parts:
        sides.append((raw[at - half : at + GRAM] if at >= half else None, raw[at : at + GRAM + half] if len(raw) >= at + GRAM + half else None))
    many = [{x for x, n in Counter(s[k] for s in sides).items() if n > 1} - {None} for k in (0, 1)]
    return [p for p, (left, right) in zip(parts, sides) if left in many[0] or right in many[1]]


def _decided(dealt: DataFrame, length: int) -> DataFrame:
    """Spans (id, tag, start, stop) that shards' suffix arrays show."""

    def run(batches):
        held: list[tuple[int, int, int, int, bytes]] = []
        # of the route that goes on: where it begins, its claimed text, whether it is an anchor's
        size, own, begin, heads, anchored = 0, None, 0, [], False

        def spans():
            ids, tags, starts, _, parts = zip(*held)
            found = equal_windows(np.array(ids, np.int64), np.array(tags, np.int64), np.array(starts, np.int64), parts, length)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "tag", "start", "stop"])

        def ended():
            nonlocal size
            if anchored:
                kept = with_company(held[begin:], length)
                size -= sum(len(p[4]) for p in held[begin:]) - sum(len(p[4]) for p in kept)
                held[begin:] = kept

        for batch in slices(batches, "bytes", SHARD_BYTES):
            for route, rest, *part in zip(*(batch.column(c).to_pylist() for c in ("route", "rest", "id", "tag", "start", "anchor", "bytes"))):
                if route != own:
                    ended()
                if size >= SHARD_BYTES and (route != own or heads):
                    yield spans()
                    # the texts that more copies of the route are held against
                    held = heads[:] if route == own else []
                    size, begin = sum(len(h[4]) for h in held), 0
                part = tuple(part)
                if route != own:
                    own, heads, begin, anchored = route, [], len(held), part[3] >= 0
                if not rest:
                    heads.append(part)
                held.append(part)
                size += len(part[4])
        ended()
        if held:
            yield spans()

    shards = dealt.repartition(F.col("route")).sortWithinPartitions("route", "rest", "id", "tag", "start")
    return shards.mapInArrow(run, "id long, tag long, start long, stop long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Spans ``(id, tag, start, stop)`` of bytes to remove; they may overlap.
    tag is the checksum of the text that a span is of."""
    return _spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null"), length)


def _spans(rows: DataFrame, length: int) -> DataFrame:
    """The same of rows with an ``id``, ``text`` and other columns, which the
    last step carries along, so that its exchange is the one of ``rows``."""
    small_batches(rows.sparkSession)
    texts = rows.select("id", "text")
    met = materialize(_met(_found(texts, length)), "segments")
    many = met.where(F.col("kind") == MANY)
    asked = met.where(F.col("kind") != MANY)
    if many.limit(1).count():  # else there is nothing to look at window by window
        asked = asked.unionByName(materialize(_met(_single(texts, many, length)), "windows"))
    return _decided(_dealt(rows, asked, length), length)


def cut(raw: bytes, spans: list[tuple[int, int]], characters: bool = False) -> tuple[bytes, int, int]:
    """What is left of ``raw``, bytes removed, maximal removed runs. With
    ``characters``, a character that a span covers in part stays whole."""
    runs: list[list[int]] = []
    for start, stop in sorted(spans):
        stop = min(stop, len(raw))
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        elif start < stop:
            runs.append([start, stop])
    if characters:
        for run in runs:
            while run[0] < run[1] and raw[run[0]] & 0xC0 == 0x80:
                run[0] += 1
            while run[0] < run[1] < len(raw) and raw[run[1]] & 0xC0 == 0x80:
                run[1] -= 1
        runs = [r for r in runs if r[0] < r[1]]
    kept, at = [], 0
    for start, stop in runs:
        kept.append(raw[at:start])
        at = stop
    kept.append(raw[at:])
    return b"".join(kept), sum(b - a for a, b in runs), len(runs)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """All columns of ``docs`` in a struct ``_row``, and ``kept_text`` (null
    unless ``characters``, which keeps it valid), ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` of the bytes left."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = [F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns) if c not in (id_col, text_col)]
    narrow = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *own]
    held = [n for n, c in zip(names, docs.columns) if c not in (id_col, text_col)]
    rows = docs.select(*narrow).where("id is not null")
    spans = _spans(rows, length).groupBy("id").agg(F.collect_list(F.struct("tag", "start", "stop")).alias("spans"))
    rows = rows.join(spans.hint("merge"), "id", "left")
    without = docs.select(*narrow).where("id is null").withColumn("spans", F.lit(None).cast(rows.schema["spans"].dataType))
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, docs.columns) if n in held)

    def run(batches):
        for batch in slices(batches, "text", 2 * PIECE_BYTES):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                some = [(s["start"], s["stop"]) for s in spans if s["tag"] == zlib.crc32(raw)] if spans else []
                kept, removed, runs = cut(raw, some, characters)
                left = None if not characters else text if not removed else kept.decode("utf-8", "surrogatepass")
                out.append((left, len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            added = [pa.array(c, t) for c, t in zip(columns, types)]
            text = batch.column("text") if characters else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), text, *(batch.column(n) for n in held), *added], ["id", "text", *held, "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # a union keeps the names of its first part, which would make the exchange of rows another one
    judged = without.select("id", "text", *held, "spans").unionByName(rows.select("id", "text", *held, "spans")).mapInArrow(
        run, f"id long, text string{kinds}, kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    source = {c: F.col("id").cast(docs.schema[c].dataType) if c == id_col else F.col("text").cast(docs.schema[c].dataType) if c == text_col else F.col(n) for n, c in zip(names, docs.columns)}
    return judged.select(F.struct(*(source[c].alias(c) for c in docs.columns)).alias("_row"), "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256")
