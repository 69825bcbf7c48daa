import hashlib
import random
import time
import zlib

import pytest

from nearspan.llm import common, repeats
from tests.conftest import SF


def brute(rows, length=100):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if first.setdefault(w, (d, s)) != (d, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def judged(docs, **options):
    rows = repeats.remove_repeats(docs, **options).collect()
    return {r["_row"]["doc_id"]: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = judged(docs)
    assert {d: x for d, x in got.items() if x != want[d]} == {}
    assert len(got) == len(want)


@pytest.fixture(scope="module")
def passages():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = [prose(20), prose(60), prose(30) + "\n"]
    rows = []
    for d in range(120):
        parts = [prose(r.randint(1, 40)) for _ in range(4)]
        for _ in range(r.choice([0, 1, 2, 3])):
            p = r.choice(common)
            a = r.randrange(0, 20)
            parts.insert(r.randrange(4), p[a : len(p) - r.randrange(0, 20)])
        rows.append((d, " ".join(parts)))
    rows += [(300, "a" * 700), (301, "ab" * 400), (302, "a" * 250), (303, None), (304, ""), (305, "x" * 99), (306, prose(3000)), (307, "xy" * 60 + prose(40))]
    rows += [(400 + k, rows[k][1]) for k in range(10)]
    return rows


def test_passages(spark, passages):
    assert judged(spark.createDataFrame(passages, "doc_id long, text string").repartition(5)) == brute(passages)


@pytest.mark.parametrize("crowded", [2, 50])
def test_small_bounds(spark, passages, monkeypatch, crowded):
    for name, value in {"PIECE_BYTES": 1000, "FLUSH_ROWS": 50, "SHARD_BYTES": 2000, "CHUNK_BYTES": 64, "SALTED": 3, "CROWDED": crowded}.items():
        monkeypatch.setattr(repeats, name, value)
    assert judged(spark.createDataFrame(passages, "doc_id long, text string").repartition(5)) == brute(passages)


def test_odd_rows(spark):
    long = "é" * 100
    rows = [(None, long, 1), (1, long, 2), (1, long, 2), (2, None, 3), (3, "x" + long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    found = repeats.remove_repeats(docs, characters=True).collect()
    got = sorted(((r["_row"]["doc_id"], r["_row"]["n_removed"], r.kept_text, r.n_removed) for r in found), key=str)
    # in a text of one letter all windows but the first two repeat; a half letter stays whole
    assert got[0][:3] == (1, 2, "") or got[0][3] > 0
    assert (None, 1, long, 0) in got and (2, 3, None, 0) in got
    assert len(got) == 5
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_cut():
    assert repeats.cut(b"abcdef", [(1, 3), (2, 4), (5, 9)]) == (b"ae", 4, 2)
    assert repeats.cut("aéb".encode(), [(2, 4)], characters=True) == ("aé".encode(), 1, 1)


def test_crowded_anchors_and_many_copies(spark, monkeypatch):
    """No anchor and no claimed text brings a shard much together."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(repeats, "CROWDED", 8)
    monkeypatch.setattr(repeats, "SALTED", 10)
    monkeypatch.setattr(repeats, "FLUSH_ROWS", 40)
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choices("abcde", k=r.randint(2, 7))) for _ in range(n))
    passage, copied = prose(40), prose(60)
    rows = [(d, prose(60)) for d in range(10)] + [(10 + d, f"{prose(30)} {passage} {prose(30)}") for d in range(60)] + [(100 + d, copied) for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = docs.select(F.col("doc_id").alias("id"), "text")
        met = repeats._met(repeats._found(texts, 100)).cache()
        assert all(x["count"] <= 8 for x in met.where(F.col("kind") == repeats.SEGMENT).groupBy("a").count().collect())
        many = met.where(F.col("kind") == repeats.MANY)
        assert many.count() > 8
        copies = met.where((F.col("kind") == repeats.CLAIM) & (F.col("id") >= 100)).groupBy("a", "b", "origin", "salt").count().collect()
        assert copies and all(x["count"] <= 11 + 40 for x in copies)
        windows = repeats._met(repeats._single(texts, many, 100))
        assert {x["kind"] for x in windows.collect()} == {repeats.CLAIM}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert judged(docs) == brute(rows)


def test_hashes_decide_nothing(spark, passages, monkeypatch):
    """A claim that is wrong removes no byte."""
    rows = [(1, "the first text has a hundred bytes and more " * 4), (2, "another one of as many bytes, but others too " * 4)]
    texts = spark.createDataFrame(rows, "id long, text string")
    tags = {d: zlib.crc32(t.encode()) for d, t in rows}
    claims = [(repeats.CLAIM, 1, tags[1], d, tags[d], 0, 120, 0, 0) for d in (1, 2)]
    asked = spark.createDataFrame(claims, f"{repeats._ROW}, salt long")
    found = repeats._decided(repeats._dealt(texts, asked, 100), 100).collect()
    assert {r.id for r in found} <= {1, 2} and all(r.id == 1 or brute(rows)[2][1] for r in found)
    want = brute([(d, t[:120]) for d, t in rows])
    assert {r.id for r in found} == {d for d, w in want.items() if w[1]}


def test_crowded_anchor_at_real_bounds(spark):
    """Thousands of texts about one passage, each with other text beside it."""
    r = random.Random(9)
    passage = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(18))[:104]
    rows = [(d, f"{d:08x}{r.getrandbits(200):050x}{passage}{r.getrandbits(200):050x}") for d in range(9000)]
    assert judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_met_in_small_batches(spark, passages, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH_ROWS", 50)
    monkeypatch.setattr(repeats, "small_batches", lambda spark: None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert judged(spark.createDataFrame(passages, "doc_id long, text string").repartition(5)) == brute(passages)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def shuffle_files(spark):
    """Names of the shuffle files on disk that have rows."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(k).getName() for k in range(found.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_written_tables_leave_no_shuffle_files(spark, passages):
    """What is written is not held on disk twice until the driver collects garbage."""
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    before = shuffle_files(spark)
    written = common.materialize(docs.repartition(3, "doc_id"), "cleaned")
    assert sorted(r.doc_id for r in written.collect()) == sorted(d for d, _ in passages)
    repeats.repeated_spans(docs)  # writes its segments
    for _ in range(100):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(name, None) == setting


@pytest.mark.parametrize("others", [[], ["lang", "source", "n_chars"]])
def test_texts_are_dealt_once(spark, others):
    """The last query exchanges the texts for both of its joins at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", *others)
    judged = repeats.remove_repeats(docs)
    rows = judged.collect()
    assert len(rows) == docs.count() and set(rows[0]["_row"].asDict()) == {"doc_id", "text", *others}
    assert "ReusedExchange" in judged._jdf.queryExecution().executedPlan().toString()
