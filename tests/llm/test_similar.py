import numpy as np

import corpus_pipeline as pipeline
from lattiq.llm import similar, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text, size=5):
    words = text.encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or {tuple(words)}


def _rows(texts):
    return [(k, t, "en", "a", len(t)) for k, t in texts]


def test_stage_equals_brute_force_by_shingles(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for g in range(40):
        words = rng.choice(vocabulary, 200).tolist()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 8):
            other = list(words)
            for at in rng.integers(0, 200, edits):
                other[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(other))
    sets = [brute_sets(t) for t in texts]
    best = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if best[a] < best[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    best[b], changed = best[a], True
    docs = spark.createDataFrame(_rows(enumerate(texts)), DOCS)
    assert sorted(r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, docs, "").collect()) == sorted(set(best))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs, 3).collect()) == sorted(set(best))


def test_different_texts_without_or_with_one_id_stay(spark):
    one, two, three = ("one " + "alpha beta gamma delta " * 9, "two " + "red green blue white black " * 9, "three " + "rain snow wind sun fog hail " * 9)
    rows = _rows([(None, one), (None, two), (None, two), (5, two), (5, three), (5, three), (None, "quite another text of a few words")])
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted([("None", one), ("5", two), ("5", three), ("None", rows[-1][1])])
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs).collect()) == want


def test_similar_sets_lie_within_the_radius():
    """Sets of Jaccard similarity 0.8, of 5 shingles and of 1,000: their fingerprints differ in RADIUS bits at most."""
    rng = np.random.default_rng(3)
    for both, own in ((4, 1), (8, 1), (80, 10), (800, 100)):
        for _ in range(400):
            h = rng.integers(0, 1 << 64, both + 2 * own, np.uint64)
            a, b = np.sort(h[: both + own]), np.sort(np.append(h[:both], h[both + own :]))
            if len(np.union1d(a, b)) * similar.SIMILARITY > both:
                a = np.sort(h[:both])  # one set within the other
                b = np.sort(h[: both + own])
            assert similar.similar(a, b) == (len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)))
            if similar.similar(a, b):
                assert ((similar.fingerprint(a) ^ similar.fingerprint(b)) & (2**64 - 1)).bit_count() <= similar.RADIUS


def test_shards_equal_brute_force_for_any_blocks():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    sets = [np.unique(np.append(rng.choice(base, 60 - e, replace=False), rng.integers(0, 1 << 64, e, np.uint64))) for e in rng.integers(0, 20, 90)]
    fps, nodes = np.array([similar.fingerprint(x) for x in sets]), np.arange(len(sets))
    want = list(range(len(sets)))
    for _ in sets:
        for a in nodes:
            for b in nodes:
                if want[a] > want[b] and similar.similar(sets[a], sets[b]):
                    want[a] = want[b]

    def components(links):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = np.ones(len(sets), bool)
    assert components(list(similar.shard_links(nodes, fps, sets, every, every))) == want
    low = nodes < 40
    links = list(similar.shard_links(nodes, fps, sets, low, ~low))
    assert all(low[a] != low[b] for a, b in links)
    for part in (low, ~low):
        own = nodes[part]
        links += [(own[0] * 0 + a, b) for a, b in similar.shard_links(own, fps[part], [sets[k] for k in own], part[part], part[part])]
    assert components(links) == want


def test_fingerprints_alone_find_the_nearest_copies(spark, monkeypatch):
    """Without any shared minima, what lies within three bits is found by the fingerprints' own bands and BK-trees, and checked."""
    whole = similar.candidates
    monkeypatch.setattr(similar, "candidates", lambda keys, rows: whole(keys.limit(0), rows))
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        words = [f"g{g}x{x}" for x in rng.integers(0, 9999, 900)]
        texts += [" ".join(words), " ".join([*words[:-1], "edited"])]
    bits = [similar.fingerprint(similar.shingles(t.encode())) & (1 << 64) - 1 for t in texts]
    close = {k for k in range(0, 12, 2) if (bits[k] ^ bits[k + 1]).bit_count() <= simhash.RADIUS}
    assert len(close) >= 3
    docs = spark.createDataFrame(_rows(enumerate(texts)), DOCS)
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert got == set(range(12)) - {k + 1 for k in close}
