import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from nearspan.llm import ann, chat, queries, url_filter
from tests.conftest import SF


@given(st.text(alphabet="<|im_start>end/s[]INSTY\\lbn\n ", max_size=80), st.text(alphabet="ab\\\n<s>", max_size=6))
def test_escapes_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    formatted, _ = chat.render([(role, text), ("assistant", text)])
    assert chat.parse(formatted) == [(role, text), ("assistant", text)]


def test_events_fold(spark):
    events = [
        (1, 0, 0, "user", None, "hi"), (1, 1, 1, "assistant", "message", "no"), (1, 2, 1, None, "delta", "pe"), (1, 3, 1, None, "regenerate", None), (1, 4, 1, None, "delta", "ye"),
        (1, 5, 1, None, "delta", "s"), (1, 6, 0, None, "edit", "hello"), (1, 7, 2, "user", "message", "x"), (1, 8, 2, None, "delete", None), (2, 0, 0, None, None, None), (None, 0, 0, "user", None, "q"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, turn long, role string, event string, text string").repartition(4)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(log).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "yes")], 2: [("", "")], None: [("user", "q")]}
    assert chat.format_chats(log.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    found = queries.QUERIES[name](spark, SF)
    said = db.execute(queries.ORACLE_SQL[name])
    order = [c[0] for c in said.description]
    assert sorted(order) == sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*order).collect()))) == sorted(map(str, said.fetchall()))


def exact(ids, vectors, asked, k):
    scores = vectors[asked] @ vectors.T
    out = {}
    for q, s in zip(asked, scores):
        rows = np.flatnonzero(ids != ids[q])
        out[ids[q]] = [ids[i] for i in rows[np.lexsort((ids[rows], -s[rows]))[:k]]]
    return out


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = exact(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    got = {}
    for r in queries.op4_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got.keys() == want.keys()
    assert sum(len(set(want[q]) & set(got[q].values())) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_recall_of_a_full_block(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(ann.BLOCK_ROWS, 64)).astype(np.float32)
    ids = np.arange(len(vectors))
    rows = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})).coalesce(1)
    asked = np.flatnonzero(ids % 160 == 0)
    want = exact(ids, vectors.astype(np.float64), asked, 20)
    got = {q: set() for q in want}
    for r in ann.nearest(rows, rows.where("vec_id % 160 = 0"), k=20).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(set(want[q]) & got[q]) for q in want) >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["unit", "clusters"])
def test_recall_of_other_kinds(spark, kind):
    """Several blocks and packs, long vectors, and vectors in tight clusters."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(6000, 256 if kind == "unit" else 48))
    if kind == "unit":
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    else:
        vectors = rng.normal(size=(30, 48))[rng.integers(0, 30, 6000)] + 0.1 * vectors
    vectors = vectors.astype(np.float32)
    ids = np.arange(len(vectors))
    rows = spark.createDataFrame(pa.table({"vec_id": ids, "score": np.zeros(6000), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})).repartition(3)
    asked = np.flatnonzero(ids % 60 == 0)
    want = exact(ids, vectors.astype(np.float64), asked, 20)
    got = {q: set() for q in want}
    for r in ann.nearest(rows, rows.where("vec_id % 60 = 0"), k=20, query_rows=16).collect():
        got[r.query_id].add(r.vec_id)
    assert all(len(g) == 20 for g in got.values())
    assert sum(len(set(want[q]) & got[q]) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_equal_vectors_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(200)] + [(1000 + k, rng.normal(size=3).tolist()) for k in range(50)]
    rows += [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0, None, 2.0]), (2003, [float("nan"), 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0]), (2005, [1.0]), (None, [9.0, 9.0, 9.0]), (7, [1.0, 2.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(vectors, vectors.where("vec_id in (0, 7, 2003, 1000)"), k=5).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 7, 1000, 2003)}
    assert by[2003] == []
    kept = {k: np.array(v) for k, v in rows if k is not None and k < 2000}
    for q in (0, 7, 1000):
        order = sorted((i for i in kept if i != q), key=lambda i: (-float(np.float32(kept[q]).astype(float) @ np.float32(kept[i]).astype(float)), i))
        assert by[q] == order[:5]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.Org", "http://a.org/x", "https://www.example.org/en/12?q", "http://example.org/es/#f", "http://b.com/fr/a", "http://b.com/de/", "x", None, "", "ftp://", "http://bad.net/1", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(100 + k, f"http://bad.net/{k}") for k in range(40)] + [(200 + k, f"http://h{k % 9}.com/{k}") for k in range(200)], "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + k, True) for k in range(40)] + [(200 + k, k == 5) for k in range(200)] + [(1, False), (1, None), (None, True)], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, outcomes, queries.RULES).collect()}
    assert got[0] == ("a.org", "", None, "allow") and got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("www.example.org", "/en/12", "example.org/en/1", "block") and got[3][2:] == ("example.org/es/", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][:2] == got[7][:2] == got[8][:2] == ("", "") and got[10] == ("bad.net", "/1", None, "block")
    assert got[11][:2] == ("b:", "//c/d")
    assert url_filter.filter_urls(pages.limit(0), outcomes.limit(0), queries.RULES).count() == 0


def test_lower_quantile(spark):
    """Paulson's approximation against draws from the distribution."""
    rng = np.random.default_rng(0)
    cases = [(3.0, 9.0), (20.5, 60.0), (1.5, 4.0), (40.0, 2.0), (0.8, 30.0), (300.0, 700.0)]
    rows = spark.createDataFrame(cases, "a double, b double")
    got = {(r.a, r.b): r.q for r in rows.select("a", "b", url_filter.lower_quantile(url_filter.F.col("b"), url_filter.F.col("a")).alias("q")).collect()}
    for a, b in cases:
        assert abs(got[a, b] - np.quantile(rng.beta(a, b, 200_000), 1 - url_filter.CONFIDENCE)) < 0.012, (a, b, got[a, b])


def test_reputation_of_odd_rows(spark):
    """Ports, repeated pages and outcomes, clashing columns, no labels."""
    pages = spark.createDataFrame([(k, f"http://bad.co.uk:81/{k}", "a", "b") for k in range(30)] * 2 + [(100 + k, f"http://fine{k}.co.uk/", "a", "b") for k in range(60)], "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([(k, True) for k in range(30)] * 2 + [(k, False) for k in range(30)] + [(100 + k, False) for k in range(60)], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, outcomes, []).collect()}
    assert all(got[k] == ("bad.co.uk:81", None, "block") for k in range(30)) and all(got[100 + k][2] == "allow" for k in range(60))
    assert pages.select(url_filter.domain_of(url_filter.host_of(url_filter.F.col("url"))).alias("d")).where("d = 'bad.co.uk'").count() == 60
    none = url_filter.filter_urls(pages, outcomes.limit(0), [("block", "co.uk")]).collect()
    assert len(none) == 120 and {(":" in r.host, r.rule, r.verdict) for r in none} == {(True, None, "allow"), (False, "co.uk", "block")}
    assert {r.verdict for r in url_filter.filter_urls(pages, outcomes.limit(0), []).collect()} == {"allow"}


def test_chat_log_of_odd_rows(spark):
    """The query's log: repeated rows, nulls, ties, long texts, clashing columns."""
    long = "word </s> \\ " * 50_000
    rows = [(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", long, "y"), (1, None, "user", None, "z"), (None, 3, "assistant", "", "z"), (None, 3, "assistant", "ab", "z"), (None, 2, None, "[INST]", "z"), (2, 5, "assistant", "éß", "q")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, event string").repartition(3)
    chats = chat.format_chats(queries.chat_log(messages))
    got = {r.conv_id: chat.parse(r.formatted) for r in chats.collect()}
    assert got == {1: [("user", ""), ("user", "a"), ("user", "a"), ("assistant", long)], None: [("", "[INST]"), ("assistant", ""), ("assistant", "ab")], 2: [("assistant", "éß")]}
    loss = {r.conv_id: "".join(chat.unescape(r.formatted[s["start"] : s["end"]]) for s in r.loss_spans) for r in chats.collect()}
    assert loss == {1: long, None: "ab", 2: "éß"}
    kinds = {r.event for r in queries.chat_log(messages).select("event").distinct().collect()}
    assert kinds == {"message", "delta", "regenerate", "edit"}
    assert chat.read_back(chat.format_chats(queries.chat_log(messages.limit(0)))).count() == 0
