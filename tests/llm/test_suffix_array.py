import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nearspan.llm import suffix_array as module
from nearspan.llm.suffix_array import permuted_common_prefixes, suffix_array


def check(s: bytes):
    t = np.r_[np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0]
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    got = suffix_array(t, 257)
    assert got.tolist() == want
    shared = permuted_common_prefixes(t.astype(np.uint16), got)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode), st.text("abc", max_size=12).map(lambda x: (x * 9).encode())))
def test_small(s):
    check(s)


def test_longer():
    rng = np.random.default_rng(1)
    check(b"a" * 300)
    check(b"ab" * 200 + b"a")
    check(bytes(rng.integers(97, 100, 1500).astype(np.uint8)))
    word = [bytes(rng.integers(97, 123, 5).astype(np.uint8)) for _ in range(30)]
    check(b" ".join(word[k] for k in rng.integers(0, 30, 300)))


def test_many_names(monkeypatch):
    """Steps of few and of many buckets."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(module, "STEP", 3)
    word = [bytes(rng.integers(97, 123, 6).astype(np.uint8)) for _ in range(60)]
    check(b" ".join(word[k] for k in rng.integers(0, 60, 250)))
    check(b" ".join(word[:9]) * 25)
    check(bytes(rng.integers(0, 256, 900).astype(np.uint8)) * 2)
    for text in (b"abcacbabc" * 60, b"a" * 200 + b"b" + b"a" * 200):
        check(text)


def test_common_prefixes_up_to_a_length():
    t = np.r_[np.frombuffer(b"abcd" * 3000, np.uint8).astype(np.int64), 0]
    order = suffix_array(t, 257)
    assert np.array_equal(np.minimum(permuted_common_prefixes(t.astype(np.uint16), order), 100), np.minimum(permuted_common_prefixes(t.astype(np.uint16), order, 100), 100))


def test_whole_shard_of_prose():
    """A megabyte of text that repeats, checked by neighbours' order."""
    rng = np.random.default_rng(3)
    word = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(20_000)]
    text = b" ".join(word[k] for k in rng.zipf(1.3, 60_000) % 20_000)
    text += text[:300_000]
    t = np.r_[np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0]
    order = suffix_array(t, 257)
    assert np.array_equal(np.sort(order), np.arange(len(t)))
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t))
    a, b = order[:-1], order[1:]
    assert ((t[a] < t[b]) | (t[a] == t[b]) & (np.r_[rank, -1][a + 1] < np.r_[rank, -1][b + 1])).all()


def test_a_level_is_induced_once(monkeypatch):
    """Substrings are sorted by themselves; only the order of all suffixes is induced."""
    calls = {"levels": 0, "induced": 0}
    whole, induce = module.suffix_array, module._induce

    def counted(*a):
        calls["levels"] += 1
        return whole(*a)

    def induced(*a):
        calls["induced"] += 1
        return induce(*a)

    monkeypatch.setattr(module, "suffix_array", counted)
    monkeypatch.setattr(module, "_induce", induced)
    rng = np.random.default_rng(5)
    t = np.r_[rng.integers(1, 5, 4000), 0]
    t[2000:3000] = t[:1000]
    got = module.suffix_array(t, 5)
    assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert calls["levels"] > 2 and calls["induced"] == calls["levels"]


def test_substrings_of_many_words():
    """Substrings longer than a word, equal up to a word's end, and some that others begin with."""
    down = bytes(range(250, 100, -1))
    check(b"".join(down[a:] + down[:b] for a in (0, 3, 60) for b in (6, 7, 8, 13, 14, 15, 140, 149)) * 2)
    check(b"zyxwvuab" * 9 + b"zyxwvuaa" * 9 + b"zyxwvua" * 9 + b"zyxwvuaaaaaaaaab" * 5 + b"zyxwvuaaaaaaaaaa0" * 5)
    check(bytes([255] * 20 + [0] * 20) * 8 + bytes([255, 254] * 30))


def test_bytes_are_short_symbols(monkeypatch):
    """A text's symbols are numbered anew, in a byte each, up to 255 kinds."""
    types, induce = [], module._induce
    monkeypatch.setattr(module, "_induce", lambda t, *a: types.append(t.dtype) or induce(t, *a))
    check(b"the words of a text, of the text's words")
    assert types[-1] == np.uint8
    for kinds, dtype in ((254, np.uint8), (255, np.uint16), (256, np.uint16)):
        check(bytes(range(256 - kinds, 256)) * 3 + bytes(range(255, 255 - kinds, -1)))
        assert types[-1] == dtype
