import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearspan.llm import language_id, quality_rules
from tests.llm.test_near_duplicates import brute as near
from tests.llm.test_repeats import brute as repeats

#: Enough labels to learn from.
SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(steps[n].schema == steps[""].schema for n in names[:-1])
    rows = {n: {r.doc_id: r for r in x.collect()} for n, x in steps.items() if n != "packing"}
    lettered = {d for d, r in rows[""].items() if r.text and any(map(str.isalpha, r.text))}
    assert rows["language_id"].keys() <= lettered and len(rows["language_id"]) >= 0.97 * len(lettered)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = [d for d, r in rows["language_id"].items() if len(r.text.split()) >= 60 and d in quality]
    good = [d for d in long if quality[d]]
    assert sum(d in rows["quality_rules"] for d in good) >= 0.95 * len(good)
    bad = [d for d in long if not quality[d]]
    assert sum(d in rows["quality_rules"] for d in bad) <= 0.2 * len(bad)
    before = [(d, r.text) for d, r in rows["quality_rules"].items()]
    assert rows["near_duplicates"].keys() == {d for d, (_, c) in near(before, width=5).items() if c == d}
    before = [(d, r.text) for d, r in rows["near_duplicates"].items()]
    want = repeats(before)
    assert rows["repeated_passages"].keys() == want.keys()
    for d, r in rows["repeated_passages"].items():
        removed = want[d][1]
        lost = len((dict(before)[d] or "").encode()) - len((r.text or "").encode())
        assert removed - 6 * want[d][2] <= lost <= removed
    left = {r.doc_id: r.doc_tokens for r in steps["packing"].collect()}
    assert left.keys() == want.keys()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out()), "text", "lang")
    found = language_id.predict(docs, model).where(language_id.held_out()).collect()
    sure = [r for r in found if r.text and len(r.text) > 20]
    assert sum(r.lang == r.lang_pred for r in sure) >= 0.98 * len(sure)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "12 ++ 3", 0.2), (4, "the and of", 0.3), (None, "der die und", 0.1)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "de", "es", "fr") and 0 <= got[4][1] <= 1
    none = language_id.learn(docs.limit(0), "text", "lang")
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}


def test_score_of_many_families():
    names = [f"l{k:03}" for k in range(100)]
    machine = lambda n, bias: language_id.Machine(n, "", np.zeros(language_id.BINS, np.float32), bias)
    scores = []
    for some in (names[:3], names):
        model = language_id.Model({n: [n] for n in some}, [machine(n, 1.0 if n == "l001" else -1.0) for n in some], {n: [] for n in some})
        found, (score,) = model.predict(["clean text"])
        assert found == ["l001"] and score >= corpus_pipeline.LEAST_SCORE
        scores.append(score)
    assert scores[0] == scores[1]


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-1, None, "y"), (-2, "", "y"), (-3, "a b c a b c a b", "y"), (-4, "a b\n\na b\n a b\n \n", "y"), (None, "x \x0b y\x0cz # 😀|", "y"), (-5, " ".join("ab" * 60), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r["_row"].doc_id: tuple(r[c] for c in quality_rules.COUNTS) + (r.base_failed, r.kept) for r in quality_rules.judge(docs, []).collect()}
    for d, t, _ in rows:
        n = brute_counts(t)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert got[d] == (*n, failed, not failed), d
    assert quality_rules.judge(docs.limit(0), []).count() == 0
    assert quality_rules.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")) == []


def test_list_of_rules_as_columns(spark):
    """The conditional expressions say what the rules say, rule by rule, and the
    learned list of the table is one of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = quality_rules.learn(docs.unionByName(docs), labels.unionByName(labels))
    made = [(quality_rules.Condition("n_words", False, 80.0), quality_rules.Condition("upper_share", True, 0.02)), (quality_rules.Condition("distinct_word_share", False, 0.6),)]
    assert learned and learned == quality_rules.learn(docs, labels)
    of = quality_rules.features()
    for rules in (learned, made, []):
        rows = quality_rules.with_statistics(docs).select(*(of[f].alias(f) for f in quality_rules.FEATURES), quality_rules.verdict(rules).alias("kept")).collect()
        x = np.array([[r[f] for f in quality_rules.FEATURES] for r in rows])
        hit = np.zeros(len(x), bool)
        for rule in rules:
            hit |= quality_rules._covers(rule, x)
        assert [r.kept for r in rows] == (~hit).tolist()
        assert rules == [] or hit.any()


def test_learning_from_odd_rows(spark):
    long = "das ist ein langer text " * 40_000
    rows = [(k, f"the cat and the dog number {k} sat on the mat", "en") for k in range(30)] + [(100 + k, f"der hund und die katze nummer {k} sind im haus", "de") for k in range(30)]
    rows += [(200, "le chat et le chien sont dans la maison", "fr")] * 50 + [(None, "el gato y el perro", "es"), (300, long, "de"), (301, None, "en"), (302, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("old"))
    model = language_id.learn(docs, "text", "lang")
    assert sorted(code for own in model.families.values() for code in own) == ["de", "en", "es", "fr"]
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (200, 300)} == {"fr", "de"}
    assert len([r for r in got if r.doc_id == 200]) == 50
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(docs, "text", "lang", most_languages=2)


def test_stages_on_odd_rows(spark):
    """Empty tables, null ids, repeated ids and rows, nulls in any column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("length(text) > 2000 and lang = 'en'").orderBy("doc_id").first().text
    other = " ".join(f"word{k} and the other {k * k}" for k in range(90))
    rows = [(1, text, "en", "a", 1), (1, other, None, None, None), (2, text + " tail", "en", "a", 1), (2, other[::-1], "en", "b", 2), (None, text, "en", "a", 1), (3, None, "en", "a", 0), (1, text, "en", "a", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    kept = corpus_pipeline.near_duplicate(spark, odd, SF).collect()
    # id 2 goes as a whole, with its near copy
    assert sorted(str((r.doc_id, r.text and r.text[:9])) for r in kept) == sorted(str(x) for x in [(1, text[:9]), (1, text[:9]), (1, other[:9]), (None, text[:9]), (3, None)])
    copies = odd.where("text = '%s'" % other).unionByName(spark.createDataFrame([(7, other, "en", "a", 1), (7, other[::-1], "en", "a", 1)], docs.schema))
    # but of id 7, whose one text is an exact copy, the other stays
    assert sorted((r.doc_id, r.text[:9]) for r in corpus_pipeline.near_duplicate(spark, copies, SF).collect()) == [(1, other[:9]), (7, other[::-1][:9])]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        found = stage(spark, odd, SF)
        assert found.count() >= 0 and (name == "packing" or found.schema == odd.schema), name
