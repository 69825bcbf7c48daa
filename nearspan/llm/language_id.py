"""Language ID by hierarchical discrimination.

A first layer of linear support vector machines predicts the language family;
within it, one-versus-one machines separate the related languages. Features are
relative frequencies of letter trigrams of the whole text, so a prediction is
one table lookup for each position.

The machines are trained on the driver from a bounded sample of labelled texts
(``SAMPLE_PER_LANGUAGE`` of each language, chosen by a hash of the id, each text
once); more than ``MOST_LANGUAGES`` languages are an error, as are machines of
more than ``MOST_MODEL_BYTES``, which are broadcast: a column of 2**16 floats for
each family and each pair of languages of a family. Prediction reads only the
text.

Null texts, empty texts and texts without a letter get ``und`` with score 0, and
so do all texts if no label was given. Null labels teach nothing. Null ids and
repeated rows pass through, one result each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, strings

#: Bounds of the training sample and of the model.
SAMPLE_PER_LANGUAGE = 400
MOST_LANGUAGES, MOST_MODEL_BYTES = 1000, 1 << 30
BINS = 1 << 16
SLICE_BYTES = 2 << 20
UNKNOWN = "und"

#: Families of languages by their codes; other codes are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "sinitic": "wuu yue zh",
    "malayo-polynesian": "id jv ms tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Letters of ASCII fold to 1-26, bytes of other characters to 32-63, all else to 0.
_CLASS = np.zeros(256, np.uint32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 32 + np.arange(128) % 32
_PLAIN_LETTER = re.compile("[A-Za-z]")
_EACH = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return bool(_PLAIN_LETTER.search(text) or _EACH.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def trigram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams of all texts, and where each text's begin. A text is
    padded with two classes 0, so that it has at least as many bins as bytes."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *(len(b) + 2 for b in raw)])[:-1]
    codes = _CLASS[np.frombuffer(b"\0\0".join(raw) + b"\0\0\0\0", np.uint8)]
    grams = codes[:-2] << 12 | codes[1:-1] << 6 | codes[2:]
    return (grams * np.uint32(2654435761)) >> np.uint32(16), starts


@dataclass
class Machine:
    """Positive side against negative side."""

    positive: str
    negative: str
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    families: dict[str, list[str]]
    layer: list[Machine]  # by family, each against the rest; one machine for two families
    pairs: dict[str, list[Machine]]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.families or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bins, starts = trigram_bins(texts)
        sizes = np.diff([*starts, starts[-1] + len(texts[-1].encode("utf-8", "replace")) + 2])

        def margin(m: Machine, rows: np.ndarray | None = None) -> np.ndarray:
            """Of all texts, or of some: only their bins are looked up."""
            if rows is None or len(rows) == len(texts):
                return np.add.reduceat(m.weights[bins], starts, dtype=np.float64)[: len(texts)] / sizes + m.bias
            own = sizes[rows]
            first = np.cumsum(own) - own
            at = np.repeat(starts[rows] - first, own) + np.arange(own.sum())
            return np.add.reduceat(m.weights[bins[at]], first, dtype=np.float64) / own + m.bias

        names = sorted(self.families)
        if len(names) == 1:
            of_family = np.ones((len(texts), 1))
        elif len(names) == 2:
            p = _sigmoid(margin(self.layer[0]))
            of_family = np.stack([p, 1 - p], axis=1)
        else:
            # not divided by their sum, so that a score means the same for any number of families
            of_family = _sigmoid(np.stack([margin(m) for m in self.layer], axis=1))
        chosen = of_family.argmax(axis=1)
        found, score = np.empty(len(texts), object), of_family.max(axis=1)
        for k, family in enumerate(names):
            rows = np.flatnonzero(chosen == k)
            languages = self.families[family]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(languages)))
            for m in self.pairs[family]:
                p = _sigmoid(margin(m, rows))
                votes[:, languages.index(m.positive)] += p
                votes[:, languages.index(m.negative)] += 1 - p
            found[rows] = np.array(languages, object)[votes.argmax(axis=1)]
            if len(languages) > 1:
                score[rows] *= votes.max(axis=1) / (len(languages) - 1)
        lettered = [has_letter(t) for t in texts]
        return (
            [f if ok else UNKNOWN for f, ok in zip(found, lettered)],
            [float(min(1, max(0, s))) if ok else 0.0 for s, ok in zip(score, lettered)],
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(x, -20, 20)))


def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, positive: str, negative: str, rounds: int = 12, cost: float = 10.0) -> Machine:
    """A linear support vector machine with hinge loss, by dual coordinate
    descent over sparse rows; sides are weighted to balance their numbers."""
    weights, bias = np.zeros(BINS, np.float64), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1 for _, v in rows])
    most = np.where(sides > 0, cost * len(rows) / (2 * max(1, (sides > 0).sum())), cost * len(rows) / (2 * max(1, (sides < 0).sum())))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            bins, values = rows[k]
            gap = 1 - sides[k] * (weights[bins] @ values + bias)
            new = min(most[k], max(0.0, alpha[k] + gap / norms[k]))
            if step := (new - alpha[k]) * sides[k]:
                weights[bins] += step * values
                bias += step
                alpha[k] = new
    return Machine(positive, negative, (weights * SCALE).astype(np.float32), bias)


#: Relative frequencies are multiplied by this, to stand beside the bias.
SCALE = 30.0


def train(sample: list[tuple[str, bytes, bytes, int]]) -> Model:
    """sample: language, bins and counts of a text, its number of trigrams."""
    languages = sorted({x[0] for x in sample})
    families: dict[str, list[str]] = {}
    for code in languages:
        families.setdefault(_FAMILY_OF.get(code, code), []).append(code)
    rows = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4") * (SCALE / n)) for _, b, c, n in sample]
    own = np.array([x[0] for x in sample], object)
    kin = np.array([_FAMILY_OF.get(x[0], x[0]) for x in sample], object)
    names = sorted(families)
    first = names[:1] if len(names) == 2 else names if len(names) > 2 else []
    layer = [train_machine(rows, np.where(kin == f, 1, -1), f, "") for f in first]
    pairs: dict[str, list[Machine]] = {f: [] for f in names}
    for family, codes in families.items():
        for a, b in combinations(codes, 2):
            some = np.flatnonzero((own == a) | (own == b))
            pairs[family].append(train_machine([rows[k] for k in some], np.where(own[some] == a, 1, -1), a, b))
    return Model(families, layer, pairs)


def learn(labelled: DataFrame, text: str, lang: str, id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Trains on about ``per_language`` different texts of each language. Rows
    without an id are chosen by their text."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text).cast("string")))
    rows = labelled.select(key.alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if len(counted) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counted:
        return Model({}, [], {})
    families = Counter(_FAMILY_OF.get(r["lang"], r["lang"]) for r in counted)
    machines = len(families) + sum(n * (n - 1) // 2 for n in families.values())
    if machines * BINS * 4 > MOST_MODEL_BYTES:
        raise ValueError(f"{machines} machines are more than are broadcast")
    share = F.lit(0.0)
    for r in counted:
        share = F.when(F.col("lang") == r["lang"], min(1.0, per_language / r["count"])).otherwise(share)

    def featurize(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for code, t in zip(batch.column("lang").to_pylist(), strings(batch, "text")):
                if has_letter(t):
                    bins, n = np.unique(trigram_bins([t])[0].astype("<u2"), return_counts=True)
                    out.append((code, bins.tobytes(), n.astype("<u4").tobytes(), int(n.sum())))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "bins", "counts", "n"])

    sample = rows.where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang").distinct()
    kept = sample.mapInArrow(featurize, "lang string, bins binary, counts binary, n long").limit(2 * per_language * len(counted)).collect()
    return train(sorted((r["lang"], bytes(r["bins"]), bytes(r["counts"]), r["n"]) for r in kept))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``lang_pred`` and ``score`` (columns of
    these names are replaced)."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(own))]  # names may clash or repeat elsewhere
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, own))

    def run(batches):
        for batch in slices(batches, text, SLICE_BYTES):
            found, score = shared.value.predict(strings(batch, text))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    text = names[own.index(text_col)]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, own)))
    found = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, own)), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that is never learned from; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
