import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearspan.llm.bpe import TreeBPE, decode_ids, encode_texts
from nearspan.llm.packing import Packer, pack
from nearspan.llm.pretokens import BEYOND, LATIN, Splitter, read_ranks
from nearspan.llm.token_counts import count_tokens

ODD = [None, "", " ", "\n\n \n", "a" * 5000, "don't  stop’s  x\x1cy\x85z \U0001f600中文 12½3", "<|endoftext|>", "x<|endoftext|> y", "'s 's''t",
       "ab" * 3000 + "!" * 999, "İıƻŉ ªºµ"]
RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = TreeBPE(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, "twice", "y"), (3, "twice", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_fast_pattern_equals_pattern():
    split = Splitter(P.PATTERN)
    r = random.Random(1)
    chars = [chr(c) for c in range(0x250)]
    for _ in range(3000):
        text = "".join(r.choices(chars, k=12)) + "".join(r.choices(" \t\n'sta1.", k=12))
        assert not BEYOND.search(text)
        assert LATIN.findall(text) == split.whole.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinrst", max_size=60)))
def test_tree_equals_library(text):
    tree = TREE
    tree.chunks.pieces.clear(), tree.chunks.chunks.clear()
    ids = tree.encode(text)
    assert ids == library.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\u2003\x1ca'sé1.", max_size=25))
def test_white_space(text):
    ids = TREE.encode(text)
    assert ids == library.encode_ordinary(text)


def test_tree_on_long_pieces():
    tree, r = TREE, random.Random(2)
    for text in ["a" * 3000, "the" * 900, "ab" * 1500, "=" * 2001, *("".join(r.choices("aeinrst", k=n)) for n in (50, 500, 3000))]:
        assert tree.encode(text) == library.encode_ordinary(text)


def test_join_looks_at_what_is_new():
    """If the tokens at the seam stay, no other pair is encoded again."""
    tree = TreeBPE(RANKS, P.PATTERN)
    looked = []

    class Counted(type(tree.windows)):
        def __getitem__(self, ids):
            looked.append(ids)
            return super().__getitem__(ids)

    tree.windows = Counted(tree.windows.make, tree.windows.entries)
    a, b = (tuple(library.encode_ordinary(x)) for x in ("zqjx", "#qzj"))
    assert len(a) > 1 and len(b) > 1 and tree.merge(a + b) == [*a, *b]
    assert tuple(tree.join(a, b)) == a + b
    assert looked == [(a[-1], b[0])]


def test_join_at_every_place():
    """Any two parts' encodings give the whole's, however far the seam's merges reach."""
    r = random.Random(7)
    for alphabet, n in ((b"a", 40), (b"ab", 30), (b"aeinrst", 40), (b"=- ", 50), (bytes(range(256)), 20)):
        for _ in range(6):
            raw = bytes(r.choices(alphabet, k=n))
            whole = TREE.merge([TREE.single[x] for x in raw])
            for k in range(1, n):
                a, b = (tuple(TREE.merge([TREE.single[x] for x in part])) for part in (raw[:k], raw[k:]))
                assert list(TREE.join(a, b)) == whole


def test_whole_table_comes_from_joins(spark):
    """Every pre-token of two bytes or more is made by joins, one for each byte
    but the first, and the whole table's digests are the library's."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_texts(rows).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = {d: library.encode_ordinary(t) for d, t in texts.items()}
    assert got == {d: (len(ids[d]), digest(" ".join(map(str, ids[d])).encode()), digest(t.encode())) for d, t in texts.items()}
    tree = TreeBPE(RANKS, P.PATTERN, entries=10**9)
    assert all(tree.encode(t) == ids[d] for d, t in texts.items())
    assert tree.joins == sum(len(p.encode()) - 1 for p in tree.chunks.pieces)
    assert tree.joins > 10_000


def test_encode_texts(spark, docs):
    got = encode_texts(docs)
    rows = got.collect()
    want = sorted((str(d), hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in docs.collect())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = {r.doc_id: bytes(r.decoded) for r in decode_ids(got.where("doc_id = 5")).collect()}
    assert back[5] == ODD[5].encode()
    assert encode_texts(docs.limit(0)).count() == 0


def test_count_tokens(spark, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = count_tokens(docs, entries=5).collect()
    want = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert count_tokens(docs.limit(0)).count() == 0


def test_pack(spark, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = pack(docs.repartition(2), keep_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= 1024
    for d, t, _ in docs.collect():
        if d == 3:
            continue  # several rows have this id
        own = sorted(by_doc[d], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(r.doc_tokens == len(ids) for r in own)
    assert sum(r.length for r in by_doc[3]) == sum(len(library.encode(t or '', add_special_tokens=False).ids) + 1 for d, t, _ in docs.collect() if d == 3)
    assert pack(docs.limit(0)).count() == 0


def test_packer_is_bounded():
    r, packer = random.Random(3), Packer(capacity=64, windows=4)
    total = put = 0
    for doc in range(500):
        n = r.randint(1, 200)
        total += n
        for window in packer.add(doc, n):
            put += sum(p[2] for p in window)
            assert sum(p[2] for p in window) == 64
        assert len(packer.open) <= 4
    put += sum(p[2] for w in packer.close() for p in w)
    assert put == total


def test_other_vocabularies(spark, docs):
    import sentencepiece

    other = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for name, encode in (("word_bpe_49k.json", lambda t: other.encode(t, add_special_tokens=False).ids), ("piece_bpe_32k.model", pieces.encode)):
        want = sorted(len(encode(t or "")) for _, t, _ in docs.collect())
        assert sorted(r.n_tokens for r in count_tokens(docs, vocabulary=name).collect()) == want
