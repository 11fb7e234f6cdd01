from collections import Counter

import corpus_pipeline as pipeline
from lattiq.llm import exact, mixing, packing, quality, queries

SF = "/root/testdata/sf0.001"


def brute_sets(text, size=5):
    words = text.encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or {tuple(words)}


def fold(x):
    return (x or "").encode().lower()


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns

    before, after = kept["quality"]
    model = quality.fit(quality.features(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np

    good = [r["doc_id"] for r in before if model.score(np.array([quality.statistics(r["text"] or "")]))[0] >= quality.THRESHOLD]
    assert sorted(r["doc_id"] for r in after) == sorted(good)

    before, after = kept["exact_dedup"]
    largest = {}
    for r in before:
        largest[fold(r["text"])] = max(largest.get(fold(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())

    before, after = kept["near_dedup"]
    sets = {r["doc_id"]: brute_sets(r["text"] or "") for r in before}
    best = {i: i for i in sets}
    for _ in sets:
        changed = False
        for a in sets:
            for b in sets:
                if best[b] < best[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    best[a], changed = best[b], True
        if not changed:
            break
    assert sorted(r["doc_id"] for r in after) == sorted(set(best.values()))

    before, after = kept["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(spark.createDataFrame(before)).collect()}
    assert Counter(r["doc_id"] for r in after) == Counter({i: n for i, n in plan.items() if n})

    before, after = kept["packing"]
    pieces = Counter((r["doc_id"], r["piece"]) for r in after)
    docs_in = Counter(r["doc_id"] for r in before)
    assert all(pieces[(i, 0)] == n for i, n in docs_in.items()) and set(i for i, _ in pieces) == set(docs_in)
    rooms = Counter()
    for r in after:
        rooms[r["sequence_id"]] += r["length"]
    assert max(rooms.values()) <= packing.CAPACITY


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    shown = lambda d: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert shown(pipeline.run(spark, SF)) == shown(docs)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, no_docs):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns


def test_registered_queries(spark):
    names = sorted(queries.queries(), key=lambda n: int(n.split("_")[0][2:]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
    assert exact.BLOCK_BYTES and pipeline.ORACLE_SQL is None
    for n in names:
        assert queries.queries()[n](spark, SF).count() > 0
