import gzip

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import annotate, graph, metrics, stats, synthetic
from lattiq.plans import ORACLES, QUERIES
from lattiq.session import cut
from lattiq.sources import readers


@pytest.mark.parametrize("points", ["uniform", "clumped", "line", "same"])
def test_neighbours_equal_brute_force(spark, points):
    rng = np.random.default_rng(4)
    n = 300
    xy = {"uniform": rng.random((n, 2)), "clumped": np.concatenate([rng.normal(0, 0.01, (n - 20, 2)), rng.normal(50, 20, (20, 2))]), "line": np.column_stack([np.arange(n) * 1.0, np.zeros(n)]), "same": np.zeros((n, 2))}[points]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "spot long, x double, y double")
    got = {}
    for r in graph.knn(df, 5).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for i in range(n):
        want = [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:5]
        assert [j for _, j in sorted(got[i])] == want


def test_neighbours_on_a_lattice(spark):
    """Cells a whole number wide have spots on their far edges, which tie with spots inside."""
    rng = np.random.default_rng(1)
    xy = np.array([(x, y) for x in range(17) for y in range(17)], float)
    ids = rng.permutation(len(xy))
    df = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, xy)], "spot long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for k in (1, 4, 6):
        got = {}
        for r in graph.knn(df, k).collect():
            got.setdefault(r["i"], []).append((r["rank"], r["j"]))
        for a in range(len(xy)):
            want = [int(ids[b]) for b in np.lexsort((ids, d[a])) if b != a][:k]
            assert [j for _, j in sorted(got[int(ids[a])])] == want


def test_candidates_stay_few_as_spots_grow(spark, monkeypatch):
    """Rows that the ranking reads a spot, on a normal cloud: no more on the larger table."""
    kept = graph._around
    seen = []

    def around(points, cell):
        near = kept(points, cell)
        right = graph._celled(cloud, cell).select("cx", "cy")
        seen.append(near.join(right, ["cx", "cy"]).count())
        return near

    monkeypatch.setattr(graph, "_around", around)
    rng = np.random.default_rng(2)
    for n in (1000, 4000):
        seen.clear()
        cloud = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 1, (n, 2)))], "spot long, x double, y double")
        graph.knn(cloud, 6).count()
        assert sum(seen) < 250 * n


def test_neighbours_of_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "spot long, x double, y double")
    assert sorted((r["i"], r["j"], r["d"]) for r in graph.knn(df, 6).collect()) == [(1, 2, 5.0), (2, 1, 5.0)]
    assert graph.knn(df.limit(1), 6).collect() == [] and graph.knn(df.limit(0), 6).collect() == []


def test_radius_join(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((200, 2))
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "spot long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    assert graph.within_radius(df, df, 0.07).count() == (d <= 0.07).sum()


def test_hops_and_components(spark):
    e = [(0, 1), (1, 2), (2, 3), (5, 6)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in e] + [(b, a, 1.0) for a, b in e], "i long, j long, w double")
    nodes = spark.createDataFrame([(k, "c") for k in (0, 1, 2, 3, 5, 6, 9)], "i long, comp string")
    hops = graph.hop_distance(df, spark.createDataFrame([(0,)], "i long"))
    assert {r["i"]: r["hops"] for r in hops.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r["i"]: r["component"] for r in graph.connected_labels(df, nodes).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5, 9: 9}
    parts = {r["i"]: r["part"] for r in graph.split_components(df, nodes, 2).collect()}
    assert parts[0] == "c_cc0" and parts[5] == "c_cc1" and parts[9] == "c"


@pytest.mark.parametrize("name", ["hop_distance", "profile_by_distance"])
def test_hop_queries_stop_where_their_sql_does(spark, tmp_path, name):
    """Spots on a line, the widest spaced at one end, so that the other is over 30 hops away."""
    x = np.cumsum(1 + np.arange(300) / 100)
    rows = [(k, [float(v), 0.0, 1.0], k % 6) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and max(r[0 if name == "profile_by_distance" else 1] for r in got) == 30


def line_of_spots(spark, tmp_path):
    """300 spots on a line, the widest spaced at one end, so that the other is over 30 hops away; its folder and a connection to it."""
    x = np.cumsum(1 + np.arange(300) / 100)
    rows = [(k, [float(v), 0.0, 1.0], k % 6) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return str(tmp_path), con


def plain_hops(spark, folder):
    """A search in plain Python over the edges and sources that the other queries return."""
    near = {}
    for r in QUERIES["gaussian_edges"](spark, folder).collect():
        near.setdefault(r["i"], []).append(r["j"])
    front = [r["i"] for r in QUERIES["boundary_quantile"](spark, folder).where("is_boundary").collect()]
    hops = dict.fromkeys(front, 0)
    while front:
        step = {j for i in front for j in near[i]} - hops.keys()
        hops |= dict.fromkeys(step, hops[front[0]] + 1)
        front = list(step)
    return hops


def test_hop_distance_reaches_all_spots(spark, tmp_path):
    folder, con = line_of_spots(spark, tmp_path)
    got = [tuple(r) for r in QUERIES["hop_distance"](spark, folder).select("i", "hops").collect()]
    want = plain_hops(spark, folder)
    assert sorted(got) == sorted(want.items()) and len(got) == 300 and max(want.values()) > 30
    assert sorted(con.sql(ORACLES["hop_distance"]).select("i", "hops").fetchall()) == sorted(got)


def test_profile_by_distance_counts_all_spots(spark, tmp_path):
    folder, con = line_of_spots(spark, tmp_path)
    got = sorted(tuple(r) for r in QUERIES["profile_by_distance"](spark, folder).select("bin", "mean_x", "n").collect())
    assert sum(n for _, _, n in got) == 300 and len(got) > 31
    assert got == sorted(con.sql(ORACLES["profile_by_distance"]).select("bin", "mean_x", "n").fetchall())


def test_hops_up_to_a_number(spark):
    df = spark.createDataFrame([(a, a + 1) for a in range(6)], "i long, j long")
    hops = graph.hop_distance(df, spark.createDataFrame([(0,)], "i long"), 4)
    assert {r["i"]: r["hops"] for r in hops.collect()} == {k: k for k in range(5)}


@pytest.mark.parametrize("convention", ["sym", "row", "raw"])
def test_conventions(spark, convention):
    w = np.array([[0, 2, 1], [2, 0, 0], [1, 0, 0]], float)
    df = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(3) for j in range(3) if w[i, j]], "i long, j long, w double")
    wt, lap = np.zeros((3, 3)), np.zeros((3, 3))
    for r in graph.adjacency(df, convention).collect():
        wt[r["i"], r["j"]], lap[r["i"], r["j"]] = r["wt"], r["l"]
    deg = w.sum(1)
    assert np.allclose(wt.sum(1), 1)
    want = {"sym": np.eye(3) - w / np.sqrt(np.outer(deg, deg)), "row": np.eye(3) - w / deg[:, None], "raw": np.diag(deg) - w}[convention]
    assert np.allclose(lap, want)


def test_gradient_equals_numpy(spark):
    t = np.array([0.0, 0.5, 2.0, 2.5, 4.0])
    x = np.array([1.0, 3.0, 2.0, 5.0, 4.0])
    df = spark.createDataFrame([("r", k, float(a), 0, 0.0, float(b), 0.0) for k, (a, b) in enumerate(zip(t, x))], "run_id string, t_idx int, t double, node long, h double, d double, r double")
    m = metrics.invasion_metrics(df, 2.5).first()
    assert m["peak_velocity"] == pytest.approx(np.gradient(x, t).max())
    assert m["auc_d"] == pytest.approx(np.trapezoid(x, t)) and m["t_peak"] == 2.5 and m["invasion_time"] == 0.5


def test_interpolation_equals_numpy(spark):
    t, x, g = [0.0, 1.0, 4.0], [0.0, 2.0, 8.0], [-1.0, 0.0, 0.5, 3.0, 4.0, 9.0]
    a = spark.createDataFrame([(1, b, c) for b, c in zip(t, x)], "k int, t double, x double")
    b = spark.createDataFrame([(1, c) for c in g], "k int, t double")
    got = {r["t"]: r["x"] for r in metrics.interpolate(a, b, "k").collect()}
    assert [got[c] for c in g] == pytest.approx(np.interp(g, t, x).tolist())


def test_permutation_test(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    rows = [("a", float(v), float(v + 0.1 * rng.normal())) for v in x] + [("b", float(v), float(rng.normal())) for v in x] + [("c", 1.0, 2.0)]
    got = {r["g"]: r for r in stats.permutation_spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g", permutations=500).collect()}
    assert got["a"]["p"] < 0.01 and got["b"]["p"] > 0.01 and got["c"]["p"] is None


def test_matrix_market(spark, tmp_path):
    rows = [(1, 1, 2.0), (3, 2, 1.5), (2, 2, 7.0)]
    readers.write_matrix_market(spark.createDataFrame(rows, "i long, j long, value double"), f"{tmp_path}/m.mtx", 3, 2)
    assert sorted(map(tuple, readers.read_matrix_market(spark, f"{tmp_path}/m.mtx").collect())) == sorted(rows)
    with gzip.open(f"{tmp_path}/g.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate pattern general\n% note\n2 2 1\n2 1\n")
    assert [tuple(r) for r in readers.read_matrix_market(spark, f"{tmp_path}/g.mtx.gz").collect()] == [(2, 1, 1.0)]


def test_ragged_matrix(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\tc1\tc2\tc3\nCluster_Number\t1\t2\t2\ng1\t0\t5\ng2\t1\t0\t3\t9\n")
    labels, counts = readers.read_labelled_matrix(spark, str(tmp_path / "c.txt"))
    assert {r["cell"]: r["label"] for r in labels.collect()} == {"c1": "1", "c2": "2", "c3": "2"}
    assert sorted(map(tuple, counts.collect())) == [("c1", "g2", 1.0), ("c2", "g1", 5.0), ("c3", "g2", 3.0)]
    (tmp_path / "d.txt").write_text("\tc1\ng1\t0\n")
    with pytest.raises(ValueError):
        readers.read_labelled_matrix(spark, str(tmp_path / "d.txt"))


def test_positions_with_and_without_header(spark, tmp_path):
    body = "b1,1,0,0,10,20\nb2,0,0,1,11,21\n"
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\n" + body)
    for f in ("a.csv", "b.csv"):
        assert [tuple(r) for r in readers.read_positions(spark, str(tmp_path / f)).collect()] == [("b1", 20.0, 10.0)]


def test_csv_header_names_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456), (2, 2.0)], "id long, v double")
    readers.write_table(df, f"{tmp_path}/t", "csv", 2)
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/t", "id long, v double").collect())) == [(1, 0.12), (2, 2.0)]
    assert readers.header_of(spark, f"{tmp_path}/t") == ["id", "v"]
    assert readers.to_jsonable({("a", "b"): np.arange(3), "x": list(range(6000))}) == {"a|b": [0, 1, 2], "x": "<6000 values>"}
    assert readers.latex_table(df, ["id", "v"], 1).first()[0] == r"1 & 0.1 \\"
    m = readers.match_names(spark.createDataFrame([("Umod",), ("LRP2",), ("lrp2",)], "gene string"), spark.createDataFrame([("UMOD",), ("Lrp2",), ("x",)], "gene string"))
    assert sorted(map(tuple, m.collect())) == [("LRP2", "Lrp2"), ("Umod", "UMOD")]
    assert sorted(map(tuple, readers.subsample(df, 1, "id").collect())) == sorted(map(tuple, readers.subsample(df, 1, "id").collect()))


def test_synthetic_tissue_is_stable_and_sane(spark):
    t = synthetic.cell_types(synthetic.zones(synthetic.hex_grid(spark, 20)))
    a, b = t.collect(), t.repartition(3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 400
    share = {r["zone"]: r["n"] for r in t.groupBy("zone").agg(F.count("*").alias("n")).collect()}
    assert all(120 <= n <= 147 for n in share.values())
    noisy = synthetic.inject_errors(t, 0.3).agg(F.avg((F.col("type") != F.col("noisy")).cast("double"))).first()[0]
    assert 0.2 < noisy < 0.4
    e = spark.createDataFrame([(a, b, 1.0) for a in range(40) for b in range(40) if a != b], "i long, j long, w double")
    kept = {(r["i"], r["j"]) for r in synthetic.drop_edges(e, 0.3).collect()}
    assert all((b, a) in kept for a, b in kept) and 0.6 < len(kept) / 1560 < 0.8


def test_votes_and_agreement(spark):
    n = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 11)], "i long, j long")
    lab = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b")], "j long, label string")
    assert {r["i"]: r["label"] for r in annotate.vote(n, lab).collect()} == {1: "b", 2: "a"}
    same = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "p string, q string")
    r = annotate.agreement(same, "p", "q").first()
    assert r["ari"] == pytest.approx(1) and r["nmi"] == pytest.approx(1) and r["concordance"] == 0


@pytest.mark.parametrize("t, df, p", [(0.0, 5, 1.0), (2.0, 10, 0.07338803), (-2.5, 30, 0.01811), (12.0, 3, 0.00124656), (0.5, 1, 0.70483276)])
def test_student(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, rel=2e-3)


def test_spearman_with_p(spark):
    rows = [("a", float(k), float(k * k)) for k in range(12)] + [("b", float(k), float(k * 7 % 12)) for k in range(12)] + [("c", 1.0, 1.0)]
    got = {r["g"]: r for r in stats.spearman_test(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g").collect()}
    assert set(got) == {"a", "b"} and got["a"]["rho"] == pytest.approx(1) and got["a"]["p"] < 1e-9 and 0.05 < got["b"]["p"] <= 1


def test_scaling_scores_and_clusters(spark):
    v = spark.createDataFrame([(1, "g1", 2.0), (2, "g1", 4.0), (1, "g2", 5.0), (2, "g2", 5.0)], "spot long, gene string, value double")
    s = {(r["spot"], r["gene"]): r["value"] for r in annotate.scaled(v, 2).collect()}
    assert s[(2, "g1")] == pytest.approx(0.5**0.5) and s[(1, "g2")] == 0.0
    m = spark.createDataFrame([("z1", "g1"), ("z2", "g2")], "zone string, gene string")
    sc = annotate.marker_scores(v, m)
    assert {(r["spot"], r["zone"]): r["score"] for r in sc.collect()} == {(1, "z1"): -1.5, (1, "z2"): 1.5, (2, "z1"): -0.5, (2, "z2"): 0.5}
    c = spark.createDataFrame([(1, "k"), (2, "k")], "spot long, cluster string")
    assert [tuple(r) for r in annotate.cluster_labels(sc, c).collect()] == [("k", "z2")]


def test_cut_without_a_shared_folder(spark, monkeypatch):
    """In local mode a table is cut to a folder of the application where spark.checkpoint.dir is empty."""
    monkeypatch.setattr(type(spark.conf), "get", lambda *_: "")
    assert cut(spark.range(3), "own").count() == 3
