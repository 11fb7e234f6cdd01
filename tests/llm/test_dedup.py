import hashlib

import numpy as np
import pytest
import xxhash

from lattiq.llm import common, embeddings, exact, simhash


def fold(x):
    return (x or "").encode().lower()


def components(ids, links):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def brute_fingerprint(raw):
    words = raw.split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_exact_equals_grouping_by_text(odd_docs, block):
    got = exact.exact_dedup(odd_docs, block).collect()
    rows = [(r["doc_id"], fold(r["text"])) for r in odd_docs.collect()]
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    sha = {hashlib.sha256(t).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(sha)


def test_exact_blocks_common_to_batches(spark, monkeypatch):
    """A block reaches the sort once a task; forgotten ones are sent again and change no group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, "same head. " + ("tail" if k % 4 else f"own {k}")) for k in range(40)] + [(99, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        cut = exact.arrow_map(docs, exact._cutter(11), exact._CUT).collect()
        assert sum(f["block"] == b"same head. " for r in cut for f in r["fresh"]) == 1
        for limit in (1, 2048):
            monkeypatch.setattr(exact, "RECENT_BLOCKS", limit)
            got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_dedup(docs, 11).collect()}
            alike = [k for k in range(40) if k % 4]
            assert got == {99: (99, 1)} | {k: (39, len(alike)) if k % 4 else (k, 1) for k in range(40)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_staged_tables_are_deleted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * (k % 5)) for k in range(20)], "doc_id long, text string")
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert exact.text_names(docs, 8).count() == 20
    links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 100 != 99], "a long, b long")
    assert {(r["node"], r["component"]) for r in common.components(links, "path").collect()} == {(k, k // 100 * 100) for k in range(300) if k % 100}
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "lattiq" / spark.sparkContext.applicationId).iterdir())
    assert len(left) == 2 and left[0] == "identity" and left[1].startswith("path-round")


def test_exact_empty_and_stage(odd_docs, no_docs):
    assert exact.exact_dedup(no_docs).collect() == []
    kept = exact.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({fold(r["text"]) for r in odd_docs.collect()})
    assert exact.keep_one(no_docs).collect() == []


def test_fingerprint_equals_brute_force(odd_docs):
    for r in odd_docs.collect():
        raw = fold(r["text"])[:4000]
        assert simhash.fingerprint(raw) == brute_fingerprint(raw)


def test_simhash_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = {r["doc_id"]: simhash.fingerprint(fold(r["text"])) for r in docs.collect()}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = components(list(fp), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(int(r["fingerprint"], 16) == fp[i] and len(r["fingerprint"]) == 16 for i, r in got.items())


def test_simhash_links_survive_small_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12).tolist()
    values = {b for b in base} | {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (40, 2))}
    rows = [(v, k) for k, v in enumerate(sorted(values))]
    df = spark.createDataFrame(rows, "fp long, node long")
    links = [(a, b) for x, a in rows for y, b in rows if a < b and (x ^ y).bit_count() <= 3]
    want = components([k for _, k in rows], links)
    for size in (4, 2048):
        got = common.components(simhash.fingerprint_links(df, 3, size), "t").collect()
        have = {k: k for _, k in rows} | {r["node"]: r["component"] for r in got}
        assert have == want


def test_bktree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    values = list(dict.fromkeys((rng.integers(0, 1 << 12, 400)).tolist()))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in empty} == {3, 4, 7} and {r["component_id"] for r in empty} == {3}
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns
    assert simhash.keep_one(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(3).permutation(n)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df, "chain").collect()}
    assert got == {k: 0 for k in range(1, n)}


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:40] + 0.08 * rng.normal(size=(40, 16)), x[:10], 3 * x[:5], 2 * x[5:10], 1e-30 * x[10:12]]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0] * 3, 1), (905, [], 1), (906, [float("inf")] + [1.0] * 15, 1), (0, x[0].tolist(), 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = embeddings.embedding_dedup(df, margin=embeddings.MARGIN_SAFE, block_rows=block).collect()
    assert len(got) == len(rows) + len(odd)
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows] + [(0, x[0].astype(np.float64))]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    want = components(sorted(set(ids)), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    links = sorted((i, int(n)) for i, n in zip(ids, near.sum(axis=1)))
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] < 900) == links
    assert all(r["component_id"] == want.get(r["vec_id"], r["vec_id"]) and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert all(r["n_links"] == 0 for r in got if r["vec_id"] >= 900)


def test_vectors_of_each_length_link_among_themselves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for length, n in ((8, 90), (3, 60), (1, 5)):
        x = rng.normal(size=(n, length))
        x = np.concatenate([x, x[: n // 3] + 0.02 * rng.normal(size=(n // 3, length))])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        np.fill_diagonal(near, False)
        for v, k in zip(x, near.sum(axis=1)):
            want[len(rows)] = int(k)
            rows.append((len(rows), v.tolist(), 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for block in (64, 4096):  # several cells a length, or one
        got = embeddings.embedding_dedup(df, margin=embeddings.MARGIN_SAFE, block_rows=block).collect()
        assert {r["vec_id"]: r["n_links"] for r in got} == want


@pytest.mark.parametrize("dim, margin", [(8, None), (16, None), (64, None), (16, 0.02)])
def test_links_found_from_one_home_count_at_both_ends(spark, monkeypatch, dim, margin):
    """Pairs of cosine 0.951 to 0.965 at the query's own margin, and at a narrow one that loses many: n_links and
    components are those of the pairs found, and at the query's margin they are nearly all."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(700, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.965, (700, 1))
    x = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * side, x[:30]])
    held = []
    fit = embeddings.spherical_kmeans
    monkeypatch.setattr(embeddings, "spherical_kmeans", lambda *a: held.append(fit(*a)) or held[-1])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embeddings.embedding_dedup(df, **({} if margin is None else {"margin": margin})).collect()
    u = embeddings._unit(x)
    s = u @ held[0].T
    assert len(held[0]) > 20
    home, best = np.argmax(s, axis=1), s.max(axis=1)
    dealt = s >= best[:, None] - (embeddings.MARGIN if margin is None else margin)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    meets = dealt[:, home]  # [y, x]: y is dealt to the home of x
    found = near & (meets | meets.T)
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == list(enumerate(found.sum(axis=1).tolist()))
    assert {r["vec_id"]: r["component_id"] for r in got} == components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(found))])
    assert found.sum() >= (0.97 if margin is None else 0.5) * near.sum() and (margin is None or found.sum() < near.sum())


def test_embeddings_clashing_columns(spark):
    df = spark.createDataFrame([(k, [1.0, k / 100], 1, 2, [3], "x") for k in range(20)], "vec_id long, embedding array<double>, node int, copies int, cells array<int>, e string")
    assert sorted(r["n_links"] for r in embeddings.embedding_dedup(df).collect()) == [19] * 20


def test_embeddings_recall_and_empty(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = v.toPandas()
    x = np.stack(pdf["embedding"]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = embeddings.embedding_dedup(v).toPandas().set_index("vec_id").loc[pdf["vec_id"]]
    assert got["n_links"].sum() >= 0.99 * near.sum()
    assert (got["n_links"].to_numpy() <= near.sum(axis=1)).all()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.embedding_dedup(empty).collect() == []


def test_forest_keeps_components():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(rng.integers(2, 60)), int(rng.integers(0, 80))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        x, y = common.forest(a, b)
        got = {k: k for k in range(n)} | dict(zip(x.tolist(), y.tolist()))
        assert got == components(range(n), list(zip(a.tolist(), b.tolist())))
