import numpy as np
import pytest

from lattiq.llm import langid, quality
from lattiq.llm.common import load

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    got = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert len(got) > 40
    assert (got["predicted"] == got["quality"]).mean() >= 0.95
    assert got[got["quality"] == 1]["predicted"].mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_quality_keeps_plain_prose(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    prose = [
        (1, "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness."),
        (2, "The committee met on 12 May 2021 in Geneva. Its report (42 pages) was published by the UN; see chapter 3 for details."),
        (3, "Write to jane.doe@example.com or call +1 (555) 010-7788. The office is open from 9:00 to 17:30."),
        (4, "Das Haus am See wurde im Jahre 1890 gebaut. Es hat zwölf Zimmer und einen großen Garten."),
    ]
    bad = [(11, "BUY NOW!! CLICK!! HERE!! FREE!! WIN!! " * 20), (12, "a$$$ b%%% c&&& d*** " * 30), (13, "foo | bar | baz | qux | " * 30), (14, "spam " * 200)]
    stats = quality.features(docs)
    model = quality.fit(stats, labels)
    rows = spark.createDataFrame(prose + bad, "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in quality.scores(quality.features(rows), model).collect()}
    assert [got[k] for k, _ in prose] == [1] * len(prose)
    assert [got[k] for k, _ in bad] == [0] * len(bad)


def test_quality_density_equals_the_formula():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    cov = np.eye(d) + 0.3
    low = np.linalg.cholesky(cov)
    m = quality.Model(np.array([np.zeros(d), np.ones(d)]), np.array([np.linalg.inv(low), np.linalg.inv(low)]), np.array([np.log(0.25), np.log(0.75)]) - np.log(np.diag(low)).sum())
    x = rng.normal(size=(20, d))
    dens = lambda v, mu: np.exp(-0.5 * (v - mu) @ np.linalg.inv(cov) @ (v - mu))
    want = [0.75 * dens(v, np.ones(d)) / (0.75 * dens(v, np.ones(d)) + 0.25 * dens(v, np.zeros(d))) for v in x]
    assert np.allclose(m.score(x), want)


def test_quality_fit_equals_plain_python(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    model = quality.fit(quality.features(docs), labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    import zlib

    known = [(texts[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] in (0, 1)]
    x, y = np.array([quality.statistics(t) for t, _ in known]), np.array([k for _, k in known])
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    n = np.bincount(y)
    both = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    for k in (0, 1):
        assert np.allclose(model.means[k], x[y == k].mean(axis=0))
        shrunk = (1 - quality.SHRINK_POOLED - quality.SHRINK_UNIT) * covs[k] + quality.SHRINK_POOLED * both + quality.SHRINK_UNIT * np.trace(both) / len(both) * np.eye(len(both))
        assert np.allclose(model.factors[k] @ shrunk @ model.factors[k].T, np.eye(len(both)), atol=1e-6)
        assert np.isclose(model.terms[k], np.log(n[k] / n.sum()) - 0.5 * np.linalg.slogdet(shrunk)[1])


def test_classes_of_code_points_beyond_the_table_and_within():
    kinds = {"a": quality.LOWER, "É": quality.UPPER, "7": quality.DIGIT, ".": quality.MARK, "#": quality.SYMBOL, "\u3000": quality.SPACE, "日": quality.LOWER, "한": quality.LOWER, "Ａ": quality.UPPER, "\ufffd": quality.SYMBOL, "\ue000": quality.SYMBOL, "😀": quality.SYMBOL, "𝐀": quality.UPPER, "𠀀": quality.LOWER, "𝟗": quality.DIGIT}
    assert quality.classes("".join(kinds)).tolist() == list(kinds.values())
    assert quality.statistics("\ufffd" * 50) == quality.statistics("#" * 50)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r["score"] == 0.5 and r["held_out"] is not None for r in got)
    assert quality.classify(no_docs, labels).collect() == []
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality.keep_good(no_docs, labels).collect() == []


def test_language_held_out(spark):
    docs = load(spark, SF, "documents")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got["lang_pred"] == got["lang"]).mean() >= 0.98
    assert got["score"].between(0, 1).all()


def brute_bits(counts, raw):
    """Code length by walking the contexts byte by byte."""
    total = 0.0
    padded = langid.LEAD + raw
    for k in range(langid.ORDER, len(padded)):
        bits = 0.0
        for order in range(langid.ORDER, -2, -1):
            if order < 0:
                bits += 8
                break
            ctx, sym = padded[k - order : k], padded[k]
            seen = {g[-1]: 0 for g in counts if g[langid.ORDER - order : langid.ORDER] == ctx}
            for g, n in counts.items():
                if g[langid.ORDER - order : langid.ORDER] == ctx:
                    seen[g[-1]] += n
            if not seen:
                continue
            n = sum(seen.values())
            if sym in seen:
                bits -= np.log2(seen[sym] / (n + len(seen)))
                break
            bits -= np.log2(len(seen) / (n + len(seen)))
        total += bits
    return total


def test_code_lengths_equal_brute_force():
    texts = {"x": [b"banana bandana", b"nab a ban"], "y": [b"cacao coca", "ça va".encode()]}
    counts, plain = {}, {}
    for name, ts in texts.items():
        g, n = np.unique(np.concatenate([langid.grams(langid.LEAD + t) for t in ts]), return_counts=True)
        counts[name] = (g, n.astype(float))
        plain[name] = {int(k).to_bytes(4, "big"): int(c) for k, c in zip(g, n)}
    model = langid.build(counts)
    for raw in (b"banana", b"cacao ban", b"zzz", "çç b".encode(), b"\x00\x00\x00\x01"):
        bits = model.bits(langid.grams(langid.LEAD + raw)).sum(axis=0)
        assert bits == pytest.approx([brute_bits(plain[k], raw) for k in model.languages], rel=1e-5)


def test_language_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in langid.predict(odd_docs).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[7]["lang_pred"] == "und"
    assert all(r["held_out"] is not None for r in got.values())
    assert langid.predict(no_docs).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}
