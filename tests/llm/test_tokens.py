import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattiq.llm import castore, packing, tokens

TEXTS = ["", " ", "a  b", "Straße ÉCOLE ×÷ it's don't x's", "日本語 と 漢字", "<|startoftext|> a<|endoftext|>b", "İstanbul ΣΑΣ ς KÅ", "a b\x0bc\x85d", "x" * 3000, "foo!!bar... 12,3 |", "éé. ŸŸ", "ﬁ ﬂ.", "​ a", "%%% a%%% A### --", "a\tb\r\nc"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4")


def encoded(enc, texts):
    flat, cuts = enc.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_words_equal_whole_texts(plain):
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    for _ in range(2):  # the second time from the cache
        assert encoded(enc, TEXTS) == [ids_of(plain, t).tolist() for t in TEXTS]


def test_byte_level_vocabulary_is_encoded_text_by_text():
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    enc, other = tokens.WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    assert encoded(enc, TEXTS[:6]) == [other.encode(t, add_special_tokens=False).ids for t in TEXTS[:6]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    enc = tokens.encoder(tokens.tokenizer_path())
    other = Tokenizer.from_file(tokens.tokenizer_path()) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = other
    assert encoded(enc, texts) == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_caches_change_nothing(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    for t in TEXTS * 2:
        assert encoded(enc, [t]) == [ids_of(plain, t).tolist()]


def test_store_round_trip(spark, odd_docs, no_docs, plain):
    store = castore.write_store(odd_docs)
    assert store.verify() >= 1
    got = castore.read_store(store, with_ids=True).collect()
    want = {}
    for r in odd_docs.collect():
        want.setdefault(r["doc_id"], []).append(np.append(ids_of(plain, r["text"]), 2).astype("<u4").tobytes())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == sorted((i is None, i or 0, x) for i, v in want.items() for x in v)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in ordered]
    assert keys == sorted(keys)
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)
    # the long text that stands three times has its chunks stored once
    assert store.chunks().count() == store.chunks().select("digest").distinct().count() < sum(r["n_chunks"] for r in got)
    empty = castore.write_store(no_docs)
    assert castore.read_store(empty).collect() == [] and empty.verify() == 0


def test_hot_chunks_are_salted(spark, odd_docs, monkeypatch):
    store = castore.write_store(odd_docs)
    want = sorted(map(repr, castore.read_store(store).collect()))
    monkeypatch.setattr(castore, "HOT_ROWS", 2)
    assert sorted(map(repr, castore.read_store(store).collect())) == want


def test_store_notices_changes(spark, odd_docs):
    from pyspark.sql import functions as F

    store = castore.write_store(odd_docs)
    broken = store.chunks().withColumn("data", F.concat(F.lit(b"\x07\x00").cast("binary"), F.expr("substring(data, 3)"))).cache()
    broken.count()
    store.chunks = lambda: broken
    with pytest.raises(Exception, match="digest"):
        castore.read_store(store).collect()


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 40_000, 20_000)
    cut = lambda x: {tuple(c) for c in np.split(x, castore.boundaries(len(x), castore.marks(x).tolist())[:-1])}
    a, b = cut(body), cut(np.concatenate([rng.integers(0, 40_000, 333), body]))
    assert len(a & b) >= 0.9 * len(a)
    sizes = [len(c) for c in a]
    assert max(sizes) <= castore.MAX_IDS and sorted(sizes)[1] >= castore.MIN_IDS


def plain_best_fit(lengths, capacity):
    rooms, n = [], 0
    for k in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= k]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room, n = capacity, n + 1
        rooms.append(room - k)
    return n, sorted(rooms)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_runs_equal_one_piece_after_another(lengths):
    counts = {}
    for k in lengths:
        counts[k] = counts.get(k, 0) + 1
    runs, n = packing.best_fit_runs(counts, 40)
    place, order = {}, sorted(lengths, reverse=True)
    for pos, k in enumerate(order):
        r = runs[np.searchsorted(runs[:, 0], pos, side="right") - 1]
        assert r[1] == k
        d = pos - r[0]
        place.setdefault(int(r[2] + d // r[3]), []).append((int(r[4] + d % r[3] * k), k))
    for items in place.values():
        at = 0
        for offset, k in sorted(items):
            assert offset == at
            at += k
        assert at <= 40
    want, rooms = plain_best_fit(lengths, 40)
    assert n == len(place) == want
    assert sorted(40 - sum(k for _, k in v) for v in place.values()) == rooms


def test_tree_finds_the_tightest_room():
    tree = packing.RoomTree(40)
    for r in (3, 17, 40):
        tree.set(r, True)
    assert [tree.tightest(k) for k in (1, 3, 4, 17, 18, 40)] == [3, 3, 17, 17, 40, 40]
    tree.set(40, False)
    assert tree.tightest(18) == -1


def test_packing_rows(odd_docs, no_docs, plain):
    got = packing.pack_documents(odd_docs, with_ids=True)
    rows = got.collect()
    want = []
    for r in odd_docs.collect():
        ids = np.append(ids_of(plain, r["text"]), 1).astype("<u4")
        want += [(r["doc_id"] is None, r["doc_id"] or 0, k // 4096, k, ids[k : k + 4096].tobytes()) for k in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], bytes(r["ids"])) for r in rows) == sorted(want)
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4 for r in rows)
    whole = {r["sequence_id"]: r for r in packing.sequences(got).collect()}
    for r in rows:
        s = bytes(whole[r["sequence_id"]]["ids"])
        assert s[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(r["n_tokens"] for r in whole.values()) == sum(r["length"] for r in rows)
    assert len(whole) == plain_best_fit([r["length"] for r in rows], 4096)[0]
    assert packing.pack_documents(no_docs).collect() == []


def test_chunks_met_lately_are_not_sent_again(monkeypatch):
    """Frequent digests stay through any number of generations; memory holds two of them; a forgotten one is sent again."""
    monkeypatch.setattr(castore, "MEMORY", 10)
    met = castore._Met()
    sent = []
    for k in range(500):
        sent += [d for d in (b"hot", k.to_bytes(2, "big")) if met.add(d)]
        assert len(met.now) <= 10 and len(met.before) <= 10
    assert sent.count(b"hot") == 1 and len(sent) == 501
    assert met.add((3).to_bytes(2, "big")) and not met.add((499).to_bytes(2, "big"))
