import random
import re

import numpy as np
from pyspark.sql import functions as F

from nearspan.llm import components as cc
from nearspan.llm import near_duplicates as nd
from nearspan.llm.components import components
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=4, percent=80):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = nd.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "HELD", 16)
    monkeypatch.setattr(nd, "SALTED", 20)
    monkeypatch.setattr(nd, "STRAYS", 3)
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    base = r.choices(vocabulary, k=120)
    rows = []
    for d in range(150):
        own = base[:]
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            own[r.randrange(120)] = r.choice(vocabulary)
        rows.append((d, " ".join(own)))
    rows += [(200 + k, " ".join(r.choices(vocabulary, k=50))) for k in range(20)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "One two", 1), (5, "one\ttwo", 1), (5, "one\ttwo", 1), (None, "one two", 2), (6, "a b c d e", 3), (7, "A b c d e", 3), (8, "a b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (6, 2, 6, True), (7, 2, 6, False), (8, 1, 8, True)], key=str)
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_least_matches_keeps_what_may_reach():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 16, (4000, nd.HASHES), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 16, a.shape, dtype=np.uint8))
    alive, _ = nd.survive(a, b, 80)
    assert len(alive) >= 3998
    assert len(nd.survive(a, rng.permutation(a), 80)[0]) < 10


def test_components(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    root = {n: n for p in links for n in p}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in root.items() if n != c}


def test_long_bucket_is_joined(spark, monkeypatch):
    monkeypatch.setattr(nd, "HELD", 4)
    rows = [(d, " ".join(f"x{k}" for k in range(60)) + f" end{d % 7}") for d in range(40)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(F.col("doc_id"))).collect()
    assert {x.component_id for x in got} == {0}


def test_long_bucket_of_unlike_texts(spark, monkeypatch):
    """A near pair in different chunks of a bucket whose first member is like neither."""
    monkeypatch.setattr(nd, "HELD", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    texts = [" ".join(f"t{d}w{k}" for k in range(60)) for d in range(12)]
    texts[10] = texts[1] + " end"
    _, signs = nd.signatures(nd.shingle_sets(texts, 4))
    packed = signs[:, : nd.HASHES // 2] << 4 | signs[:, nd.HASHES // 2 :]
    reps = spark.createDataFrame([(d, bytearray(x.tobytes()), [7]) for d, x in enumerate(packed)], "rep long, sign binary, bands array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        got = nd.links(docs, reps, "doc_id", "text", 4, 80).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == [(10, 1)]


def test_many_near_copies_move_few_sets(spark):
    """Ten thousand near copies, none equal: a few loose links and one set each."""
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = r.choices(vocabulary, k=100)
    rows = []
    for d in range(10_000):
        own = base[:]
        own[r.randrange(100)] = f"x{d}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sketches = nd._sketches(docs, "doc_id", "text", 4)
    reps = sketches.select(F.col("id").alias("rep"), "sign", "bands").cache()
    assert nd._loose(reps, 80).select("a", "b").distinct().count() <= 6 * len(rows)
    got = nd.near_duplicates(docs).select("component_id").distinct().collect()
    assert [x.component_id for x in got] == [0]


def test_strays(spark, monkeypatch):
    """All pairs of a group with different labels are compared, in small blocks too."""
    texts = [" ".join(f"t{d % 6}w{k}" for k in range(80)) + f" end{d}" for d in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = nd._sets(docs, docs.select(F.col("doc_id").alias("node")), "doc_id", "text", 4).cache()
    members = spark.createDataFrame([(d, 0, 0 if d < 12 else d) for d in range(30)], "node long, group long, label long")
    for held, strays in ((32_768, 128), (5, 2)):
        monkeypatch.setattr(nd, "HELD", held)
        monkeypatch.setattr(nd, "STRAYS", strays)
        root = {d: 0 if d < 12 else d for d in range(30)}
        for r in nd._strays(members, sets, 80).collect():
            assert r.a % 6 == r.b % 6
            a, b = root[r.a], root[r.b]
            root = {d: min(a, b) if x in (a, b) else x for d, x in root.items()}
        assert set(root.values()) == {0}


def test_group_about_a_text_that_is_not_first(spark):
    """Copies of one text that aren't alike themselves are linked by its star."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = r.choices(vocabulary, k=200)
    rows = [(500, " ".join(base))]
    for d in range(300):
        own = base[:]
        for k in r.sample(range(50), 4):
            own[4 * k] = f"x{d}y{k}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = nd.near_duplicates(docs).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_hub(spark):
    """Links of one node are not one task's, and components are right."""
    links = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(20)]
    found = components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert {(r.node, r.component) for r in found} == {(k, 0) for k in range(1, 3000)} | {(5001 + k, 5000) for k in range(20)}


def _counted(spark, monkeypatch):
    """Counts the rows that joining within tasks makes, as often as it runs."""
    rows = spark.sparkContext.accumulator(0)
    contracted = cc._contracted

    def run(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(cc, "_contracted", lambda links: contracted(links).mapInArrow(run, "a long, b long"))
    return rows


def test_links_are_joined_once(spark, monkeypatch):
    """A group of twice the size makes twice the rows, each but a few times."""
    rows, made = _counted(spark, monkeypatch), []
    for n in (2000, 4000):
        before = rows.value
        links = spark.createDataFrame([(0, k) for k in range(1, n)], "a long, b long").repartition(4)
        assert components(links).where("component = 0").count() == n - 1
        made.append(rows.value - before)
        assert made[-1] <= 3 * n
    assert made[1] <= 2.2 * made[0]


def test_components_beyond_one_task(spark, monkeypatch):
    """Rounds of stars, where links are more than a task can hold."""
    monkeypatch.setattr(cc, "HELD_NODES", 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    rows = _counted(spark, monkeypatch)
    r = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 90)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    root = {n: n for p in links for n in p}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    try:
        got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {n: c for n, c in root.items() if n != c}
    assert rows.value <= 10 * len(links)


def test_components_take_few_stages(spark):
    """What the driver keeps of each stage and broadcast is what fills its memory."""
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 400)], "a long, b long").repartition(8)
    tracker = spark.sparkContext._jsc.sc().dagScheduler()
    before = tracker.nextJobId()
    found = components(links)
    assert tracker.nextJobId() - before <= 6
    assert found.where("component = 0").count() == 400


def test_no_task_has_two_python_steps(spark, monkeypatch):
    """Workers stay when a step is over, each with its memory."""
    plans, materialize = [], cc.materialize
    monkeypatch.setattr(cc, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df, name))
    links = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long").mapInArrow(lambda batches: batches, "a long, b long")
    assert components(links).count() == 9
    for plan in plans:
        steps = ["MapInArrow" in line for line in plan.splitlines() if "MapInArrow" in line or "Exchange" in line]
        assert any(steps) and not any(x and y for x, y in zip(steps, steps[1:]))
