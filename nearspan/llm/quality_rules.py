"""Quality rules: a learned decision list, with DataFrame functions only.

Statistics of each text are Spark expressions. From a bounded sample of labelled
texts (``SAMPLE_ROWS``, chosen by a hash of the id) sequential covering learns an
ordered list: each rule is a conjunction of thresholds, grown condition by
condition by information gain on one part of the sample, pruned on the other,
and kept only if it is precise on both; the rows it covers are then set aside.
The list becomes nested conditional expressions over the statistics, so applying
it is a projection without an exchange.

Null texts have no words (all statistics 0, base failed). Labels that are null
or of no document teach nothing; without labels the list is empty and the base
decides alone. Null ids and repeated rows pass through, one result each; empty
tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample and of the list.
SAMPLE_ROWS = 6000
MOST_RULES, MOST_CONDITIONS, THRESHOLDS = 12, 3, 24
#: Least precision of a rule on each part of the sample, and least rows that it covers.
LEAST_PRECISION, LEAST_COVERED = 0.9, 8

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share", "mark_share", "distinct_word_share"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (its columns under their own names) and the statistics, in a
    struct column ``_stats``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if docs.columns else F.struct()
    rows = docs.select(kept.alias("_row"), text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", WORD_GAP), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    rows = rows.withColumn("_n", F.size("_words"))
    # each word is hashed once; windows of three by hash and place, in order of
    # the hash, where equal ones are neighbours
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.greatest(F.col("_n") - 3, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(*(F.get("_hashes", i + k) for k in range(3))).alias("h"), i.alias("i")))
    rows = rows.withColumn("_windows", F.array_sort(windows))
    # how many windows of each place's hash are its neighbours; starts of repeated ones, in order
    same = lambda i, j: F.coalesce(F.get("_windows", i)["h"] == F.get("_windows", j)["h"], F.lit(False))
    repeated = F.filter(F.sequence(F.lit(0), last), lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
    rows = rows.withColumn("_starts", F.when(F.col("_n") >= 3, F.array_sort(F.transform(repeated, lambda k: F.get("_windows", k)["i"]))).otherwise(F.array().cast("array<int>")))
    # a window adds as many words as the next one starts after it, three at most
    gaps = F.zip_with(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), F.slice("_starts", F.lit(1), F.greatest(F.size("_starts") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("_starts") > 0, F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap)).otherwise(F.lit(0))
    # the partition's number, times 0, keeps filters on statistics above this
    # projection: pushed below, they would take the texts apart again for each use
    rows = rows.withColumn("_stats", F.struct(
        (F.col("_n") + F.spark_partition_id() * 0).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_text", WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("double").alias("n_lines"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[A-Z\xC0-\xDE]", ""))).cast("double").alias("n_upper"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "!?;:/\\{}[]=~^_@+", ""))).cast("double").alias("n_marks"),
        F.size(F.array_distinct("_words")).cast("double").alias("n_distinct"),
    ))
    return rows.select("_row", "_stats")


def features(stats: str = "_stats") -> dict[str, Column]:
    s = {c: F.col(f"{stats}.{c}").cast("double") for c in [*COUNTS, "n_lines", "n_upper", "n_marks", "n_distinct"]}
    per = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(F.lit(0.0))
    return {
        "n_words": s["n_words"],
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "word_chars"),
        "distinct_word_share": per("n_distinct", "n_words"),
    }


def base_failed(stats: str = "_stats") -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        own = x[:, FEATURES.index(self.feature)]
        return own > self.threshold if self.above else own <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for c in rule:
        mask &= c.mask(x)
    return mask


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of the largest gain until only bad rows are covered."""
    rule: list[Condition] = []
    rows = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (~bad[rows]).any() and bad[rows].any():
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        best, most = None, 1e-9
        for f, name in enumerate(FEATURES):
            own_values = np.unique(x[rows, f])
            for t in np.unique(np.quantile(x[rows, f], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])):
                # halfway to the next value: as far from both sides as the sample allows
                at = np.searchsorted(own_values, t, side="right")
                t = (own_values[at - 1] + own_values[min(at, len(own_values) - 1)]) / 2
                for above in (True, False):
                    own = rows & Condition(name, above, float(t)).mask(x)
                    p, n = bad[own].sum(), (~bad[own]).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > most:
                            best, most = Condition(name, above, float(t)), gain
        if best is None:
            break
        rule.append(best)
        rows &= best.mask(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops final conditions while that makes the rule no worse on new rows."""

    def worth(r: Rule) -> float:
        own = _covers(r, x)
        p, n = bad[own].sum(), (~bad[own]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def cover(x: np.ndarray, bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """The ordered list of rules for bad rows; what none covers is kept."""
    part = np.random.default_rng(seed).permutation(len(x)) % 3 == 0  # a third prunes
    rules, left = [], np.ones(len(x), bool)
    while len(rules) < MOST_RULES and bad[left & ~part].any():
        grow, prune = left & ~part, left & part
        rule = _prune(_grow(x[grow], bad[grow]), x[prune], bad[prune])
        own = _covers(rule, x) & left
        precise = all(bad[own & rows].sum() >= LEAST_PRECISION * max(1, (own & rows).sum()) for rows in (part, ~part))
        if not rule or not precise or own.sum() < LEAST_COVERED:
            break
        rules.append(rule)
        left &= ~own
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """A list for the rows labelled 0, from at most ``sample_rows`` labelled ids,
    chosen by hash. Of several labels of an id the least counts, of several texts
    the first in order."""
    known = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # the sample is bounded, so sending it to all is, and so is a row an id of it
    sampled = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")
    stats = with_statistics(sampled, "_text")
    of = features()
    rows = stats.where(~base_failed()).select(F.col("_row._label").alias("label"), *(of[f].alias(f) for f in FEATURES)).collect()
    if not rows:
        return []
    rows = sorted(tuple(r) for r in rows)
    x = np.array([r[1:] for r in rows], float)
    return cover(x, np.array([r[0] == 0 for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """True (keep) unless the first rule that fits says otherwise."""
    of = features()
    out = None
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column(of)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``_row`` (the document's columns), the counts, ``base_failed``, ``kept``."""
    stats = with_statistics(docs, text_col)
    failed = base_failed()
    return stats.select("_row", *(F.col(f"_stats.{c}").alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
