"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles, a MinHash signature of it and the
   keys of the signature's bands. Texts of equal sets are one class; only a
   class's smallest id goes on.
2. Classes that share a band key are candidates. Their signatures are compared
   batch by batch; after each batch the posterior of the similarity, given the
   matches so far, says whether it can still reach the threshold with more than
   the chosen miss probability. What can, links the classes of a bucket loosely:
   a forest of stars, first about the member that is most like all, so that a
   bucket gives about as many loose links as it has members. Their components
   are groups; classes of different groups are no candidates.
3. Loose links are verified on full sets. A set goes where its links are, so a
   group of n near copies moves about n sets; stars of more than ``SALTED``
   links are split. Components of what holds are labels.
4. Only classes of one group with different labels may still be linked unseen.
   Every such pair has a stray, a class without its group's most frequent label.
   Strays, ``STRAYS`` at a time, meet all classes of their group as these pass by
   in blocks of ``HELD``: survivors of the same signature test are verified on
   full sets, unless found links connect them already. Nothing is cut off at any
   size; a group of n classes with s strays moves n (1 + s / ``STRAYS``) sets.
5. Components of all links that hold, and the classes, give each row its component.

Ids have to be numbers. Null and blank texts have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle. Rows without an id take no part (component
null, kept). Rows of one id and different texts have each its own set and, if
it equals another's, that one's class; found links are an id's, so what a near
copy among them links to, all of them do. Repeated rows get the same result. Empty tables give empty results. Only named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, held, materialize, slices, small_batches, strings
from .components import components, spread_join

HASHES, ROWS, BANDS = 128, 4, 22
#: Hashes of a batch in the sequential test, and its miss probability.
BATCH, MISS = 32, 1e-5
#: Rows of a bucket held at a time, or of a group that pass by in one task; links
#: of a star in one task; strays held at a time.
HELD, SALTED, STRAYS = 32_768, 4096, 128
SLICE_BYTES = 2 << 20
WORD_CACHE = 250_000

_RNG = np.random.default_rng(20240)
_ODD = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    out = []
    get = held(_Words).__getitem__
    for own in words:
        n = len(own)
        h = np.fromiter(map(get, own), np.uint64, n)
        if n >= width:
            s = h[: n - width + 1] * _PLACE[0]
            for k in range(1, width):
                s = s + h[k : n - width + 1 + k] * _PLACE[k]
            out.append(np.unique(mix(s)))
        elif n:
            out.append(mix(np.array([(h * _PLACE[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(h)
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, BANDS) and signatures (texts, HASHES) of half bytes."""
    keys, signs = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), HASHES), np.uint8)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[k] for k in full])
        starts = np.cumsum([0, *(len(sets[k]) for k in full)])[:-1]
        least = np.stack([np.minimum.reduceat(x * a, starts) for a in _ODD], axis=1)
        signs[full] = (least >> np.uint64(24)).astype(np.uint8) & 15
        bands = least[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS)
        keys[full] = mix((bands * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[60])
    return keys, signs


@lru_cache
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest matches whose posterior probability of a
    similarity of ``percent`` or more exceeds ``miss``; uniform prior."""
    j = (np.arange(2000) + 0.5) / 2000
    p = j + (1 - j) / 16  # half bytes of different minima agree by chance
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        tail = like[:, j >= percent / 100].sum(axis=1) / like.sum(axis=1)
        found.append(int(np.argmax(tail > miss)))
    return tuple(found)


def survive(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows survive the sequential test, and their matches. a may be one row."""
    alive, matches = np.arange(len(b)), np.zeros(len(b), np.int64)
    for k, least in enumerate(least_matches(percent)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        left = a[:, part] if len(a) == 1 else a[alive, part]
        matches[alive] += (left == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def loose_links(ids: np.ndarray, signs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs that survive: each pivot takes in what is left."""
    left, out, queue = np.arange(len(ids)), [], []
    while len(left) > 1 or (queue and len(left)):
        if not queue:
            queue, left = [left[0]], left[1:]
        pivot = queue.pop()
        found, _ = survive(signs[pivot : pivot + 1], signs[left], percent)
        out += [(int(ids[pivot]), int(ids[k])) for k in left[found]]
        queue += left[found].tolist()
        left = np.delete(left, found)
    return out


def centres(key_starts: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Of each bucket, the member whose signature agrees most with the most
    frequent half bytes of all: what many copies are copies of."""
    out = key_starts.copy()
    for k in np.flatnonzero(sizes > 2):
        own = signs[key_starts[k] : key_starts[k] + sizes[k]]
        counts = np.stack([(own == v).sum(axis=0) for v in range(16)])
        out[k] += int((own == counts.argmax(axis=0)).sum(axis=1).argmax())
    return out


def _unpack(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES // 2)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def text_hash(text: Column) -> Column:
    """Tells the texts of rows with one id apart; of a null text that of an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(strings(batch, "text"), width)
            keys, signs = signatures(sets)
            sums = np.array([[mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s ^ _PLACE[50]).sum(dtype=np.uint64)] if len(s) else [0, 0] for s in sets], np.uint64).reshape(-1, 2)
            packed = (signs[:, : HASHES // 2] << 4 | signs[:, HASHES // 2 :]).tobytes()
            half = HASHES // 2
            arrays = [
                batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)),
                pa.array([packed[k * half : (k + 1) * half] for k in range(len(sets))], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text_hash", "n", "s1", "s2", "sign", "bands"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, n long, s1 long, s2 long, sign binary, bands array<long>")


def _loose(reps: DataFrame, percent: int) -> DataFrame:
    """Loose links (a, b, salt) of classes that share a band key; salt counts
    the parts of a's star."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bucket = first = None  # a bucket longer than what is held: its key and first id
        seen = 0  # its members so far

        def pairs(key, ids, signs, last, long=False):
            nonlocal bucket, first, seen
            out: list[tuple[int, int, int]] = []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            lead = np.repeat(centres(starts, sizes, signs), sizes)
            follow = np.flatnonzero(lead != np.arange(len(key)))
            continued = first is not None and key[0] == bucket
            if continued or long:  # every chunk of a long bucket is joined loosely to its first, which costs time but loses nothing
                to, before = (first, seen) if continued else (int(ids[0]), 0)
                out += [(to, int(x), (before + k) // SALTED) for k, x in enumerate(ids[: sizes[0]]) if int(x) != to]
                seen = before + int(sizes[0])
                follow = follow[follow >= sizes[0]]
            found, _ = survive(signs[lead[follow]], signs[follow], percent) if len(follow) else (follow, None)
            linked = np.zeros(len(key), bool)
            linked[follow[found]] = True
            hit = follow[found]
            begins = np.repeat(starts, sizes)
            out += zip(ids[lead[hit]].tolist(), ids[hit].tolist(), ((hit - begins[hit]) // SALTED).tolist())
            rest = follow[~linked[follow]]
            for s in np.unique(begins[rest]):  # buckets that their centre doesn't hold together
                end = s + sizes[np.searchsorted(starts, s)]
                out += [(a, b, k // SALTED) for k, (a, b) in enumerate(loose_links(ids[s:end], signs[s:end], percent))]
            if not last:
                if first is None or key[-1] != bucket:
                    bucket, first, seen = key[-1], int(ids[starts[-1]]), int(sizes[-1])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["a", "b", "salt"])

        def joined():
            return (np.concatenate([h[k] for h in parts]) for k in range(3))

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append((batch.column("key").to_numpy(), batch.column("rep").to_numpy(), _unpack(batch.column("sign"))))
            key, ids, signs = joined()
            cut = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(len(key) - np.argmax(key[::-1] != key[-1]))
            long = cut == 0 and len(key) >= HELD
            if long:
                cut = len(key)
            if cut:
                yield pairs(key[:cut], ids[:cut], signs[:cut], False, long)
            parts = [(key[cut:], ids[cut:], signs[cut:])] if cut < len(key) else []
        if parts:
            yield pairs(*joined(), True)

    rows = reps.select("rep", "sign", F.explode("bands").alias("key"))
    return rows.repartition(F.col("key")).sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long, salt long")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Full sets (node, set) of the texts of some ids, hashes as words of eight bytes."""

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = [s.tobytes() for s in shingle_sets(strings(batch, "text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    # always dealt by id: at any size the plan is the same
    return texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(run, "node long, set binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) are as similar as ``percent``."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:  # sizes alone rule it out
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, salt), repeated or not, the links (a, b) that hold on full
    sets. a's set is held, those of its b's pass by."""
    once = pairs.where("a <> b").groupBy("a", "b").agg(F.min("salt").alias("salt"))
    asked = once.select(F.col("a").alias("of"), "salt", F.col("b").alias("node"), F.lit(1).alias("turn"))
    asked = asked.unionByName(once.select(F.col("a").alias("of"), "salt", F.col("a").alias("node"), F.lit(0).alias("turn")).distinct())

    def run(batches):
        own, held = None, []
        for batch in slices(batches, "set", SLICE_BYTES):
            found = []
            for of, salt, turn, node, raw in zip(*(batch.column(c) for c in ("of", "salt", "turn", "node", "set"))):
                own_set = np.frombuffer(raw.as_buffer(), np.uint64)
                if (of.as_py(), salt.as_py()) != own:
                    own, held = (of.as_py(), salt.as_py()), []
                if not turn.as_py():
                    held.append(own_set)
                elif any(alike(h, own_set, percent) for h in held):
                    found.append((own[0], node.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = asked.join(sets.hint("merge"), "node").repartition("of", "salt").sortWithinPartitions("of", "salt", "turn", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _strays(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one group with different labels (node,
    group, label), as far as they connect labels."""
    counts = members.groupBy("group", "label").agg(F.count("*").alias("n"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    groups = groups.where("labels > 1").select("group", "n", F.col("most.label").alias("usual"), blocks(F.col("n"), HELD).alias("parts"), blocks(F.col("n") - F.col("most.n"), STRAYS).alias("stray_parts"))
    groups = materialize(groups, "groups")
    total = members.count()
    of = spread_join(members, groups, "group", total)
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    strays = of.where("label <> usual").select("group", "node", "label", F.lit(0).alias("side"), block(1, F.col("stray_parts")).alias("i"), each(F.col("parts")).alias("j"))
    passing = of.select("group", "node", "label", F.lit(1).alias("side"), block(2, F.col("parts")).alias("j"), each(F.col("stray_parts")).alias("i"))

    def run(batches):
        own, held = None, []  # held: node, label, set and signature of strays
        root: dict[int, int] = {}  # of labels that found links connect

        for batch in slices(batches, "set", SLICE_BYTES):
            found = []
            own_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")]
            _, signs = signatures(own_sets)
            for k, (*key, side, node, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "side", "node", "label")))):
                if key != own:
                    own, held, root, roots = key, [], {}, np.zeros(0, np.int64)
                if not side:
                    held.append((node, own_sets[k], signs[k]))
                    roots = np.r_[roots, label]
                    continue
                mine = root.get(label, label)
                other = np.flatnonzero(roots != mine)
                if not len(other):
                    continue
                alive, matches = survive(signs[k][None], np.stack([held[x][2] for x in other]), percent)
                for x in other[alive[np.argsort(-matches, kind="stable")]].tolist():
                    if roots[x] != mine and alike(held[x][1], own_sets[k], percent):
                        found.append((held[x][0], node))
                        new = int(roots[x])
                        root = {a: new if b == mine else b for a, b in root.items()} | {mine: new, label: new}
                        roots[roots == mine] = new
                        mine = new
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = strays.unionByName(passing).join(sets.hint("merge"), "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _named(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Nodes (node, others) with their components under a name."""
    return nodes.join(found.withColumnRenamed("component", name), "node", "left").withColumn(name, F.coalesce(name, "node"))


def links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(node, component) of classes by links that hold on full sets."""
    loose = materialize(_loose(reps, percent), "loose")
    groups = components(loose.select("a", "b"))
    nodes = groups.select("node").unionByName(groups.select(F.col("component").alias("node")).distinct())
    sets = materialize(_sets(docs, nodes, id_col, text_col, width), "sets")
    first = components(_verified(loose, sets, percent))
    members = materialize(_named(_named(nodes, groups, "group"), first, "label"), "members")
    second = materialize(_strays(members, sets, percent), "strays")
    for done in (loose, sets, members):
        discard(done)
    if not second.limit(1).count():
        return first
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, kept, text_hash)`` for every row of
    ``docs``; ``text_hash`` is of the text that the verdict is about."""
    small_batches(docs.sparkSession)
    sketches = materialize(_sketches(docs, id_col, text_col, width), "sketches")
    key = ["s1", "s2", "n"]
    reps = sketches.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    reps = materialize(reps, "classes")
    found = links(docs, reps, id_col, text_col, width, percent)
    named = reps.select(*key, "rep").join(found, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    rows = sketches.select("id", "text_hash", *key).join(named, key, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("component_id"), F.col("id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "text_hash")
