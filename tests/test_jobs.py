"""The jobs: two runs over growing input, reruns, failures half-way, odd rows, SQL, and their command lines."""

import datetime
import math
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from jobs import queries, sample_features, trajectory_feed  # noqa: E402

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    left, right = oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert left == right and len(left) > 20


def test_jobs_import_nothing_of_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if m.startswith('lattiq.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def event(k, day, user, value):
    ts = None if day is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, minutes=k)
    return (k, ts, user, "x", value, None)


FIRST = [event(k, k % 5, k % 31, k % 7 / 3) for k in range(200)] + [event(900, None, 1, 1.0), event(901, 1, None, 1.0), event(902, 1, 1, None), event(903, 1, 1, float("nan"))]
#: Later events, some of days that were there before.
SECOND = [event(300 + k, 3 + k % 9, k % 17, 1 + k % 5 / 2) for k in range(150)]


def plain_days(events):
    g = defaultdict(list)
    for _, ts, user, _, value, _ in events:
        if ts and user is not None and value is not None and not math.isnan(value):
            g[ts.date(), user % 15].append(value)
    return {k: (len(v), round(sum(v) / len(v), 9), min(v), max(v)) for k, v in g.items()}


def days(spark, out):
    rows = trajectory_feed.read_daily(spark, out).collect()
    assert len({(r.day, r.node) for r in rows}) == len(rows)
    return {(r.day, r.node): (r.n, round(r["mean"], 9), r.low, r.high) for r in rows}


def add(spark, rows, folder):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_feed_takes_only_what_is_new(spark, tmp_path):
    events, out, mark = (f"file://{tmp_path}/{x}" for x in ("events", "out", "mark"))
    before = dict(spark.conf.getAll)
    add(spark, FIRST, events)
    assert trajectory_feed.run(spark, events, out, mark) == {"batches": 1, "events": 204, "left_out": 4, "days": 5}
    assert days(spark, out) == plain_days(FIRST)
    add(spark, SECOND, events)
    assert trajectory_feed.run(spark, events, out, mark) == {"batches": 1, "events": 150, "left_out": 0, "days": 9}
    assert days(spark, out) == plain_days(FIRST + SECOND)
    untouched = sorted(os.listdir(tmp_path / "out/daily/day=2024-01-01"))
    assert trajectory_feed.run(spark, events, out, mark)["batches"] == 0
    assert days(spark, out) == plain_days(FIRST + SECOND) and untouched == sorted(os.listdir(tmp_path / "out/daily/day=2024-01-01"))
    assert dict(spark.conf.getAll) == before
    top = {}
    for (_, node), (_, mean, _, _) in plain_days(FIRST + SECOND).items():
        top[node] = max(top.get(node, 0), mean)
    assert {r.node: round(r.highest, 9) for r in trajectory_feed.read_nodes(spark, out).collect()} == top


@pytest.mark.parametrize("step", ["partial_sums", "daily_means", "node_trajectories"])
def test_feed_survives_a_failure_at_any_step(spark, tmp_path, monkeypatch, step):
    events, out, mark = (f"file://{tmp_path}/{x}" for x in ("events", "out", "mark"))
    add(spark, FIRST, events)
    trajectory_feed.run(spark, events, out, mark)
    add(spark, SECOND, events)
    with monkeypatch.context() as m:
        def fail(*_):
            raise RuntimeError("lost")

        m.setattr(trajectory_feed, step, fail)
        with pytest.raises(Exception, match="lost"):
            trajectory_feed.run(spark, events, out, mark)
    assert trajectory_feed.run(spark, events, out, mark)["events"] == 150
    assert days(spark, out) == plain_days(FIRST + SECOND)


def test_feed_of_several_batches(spark, tmp_path):
    events, out, mark = (f"file://{tmp_path}/{x}" for x in ("events", "out", "mark"))
    for k in range(0, 200, 50):
        add(spark, FIRST[k : k + 50], events)
    assert trajectory_feed.run(spark, events, out, mark, {"files_per_trigger": 1})["batches"] == 4
    assert days(spark, out) == plain_days(FIRST[:200])


DOCS = [(k, f"The cat-{k % 4} sat, sat on «mat» (mat {k % 3})!\nIt's THE end...", "en", "a" if k % 3 else "b/ü", 0) for k in range(40)]
ODD = [(100, None, "en", "a", 0), (101, "", None, None, 0), (102, " ,. !! ", "en", "c", 0), (103, "cat " * 5000, "en", "a", 0), (5, "mat the sat", "en", "a", 0), (5, "mat the sat", "en", "a", 0)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(docs, least=3):
    c, units = Counter(), defaultdict(set)
    for k, text, _, source, _ in docs:
        units[source or "none"].add(k)
        for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")):
            w = re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w)
            if w:
                c[source or "none", k, w] += 1
    seen = Counter(w for _, _, w in c)
    return {k: n for k, n in c.items() if seen[k[2]] >= least}, {s: len(u) for s, u in units.items()}


def test_features_of_growing_input(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for n, docs in enumerate((DOCS, DOCS + ODD, DOCS + ODD, DOCS[:6])):  # grown, again, and fewer: nothing old stays
        path = f"file://{tmp_path}/docs{n}"
        spark.createDataFrame(docs, DOC).repartition(3).write.parquet(path)
        done = sample_features.run(spark, path, out)
        counts, units = plain_counts(docs)
        assert done["units"] == sum(units.values()) and (done["counts"] or 0) == sum(counts.values())
        matrix = sample_features.read(spark, out, "matrix").collect()
        assert {(r["sample"], r.unit, r.feature): r["count"] for r in matrix} == counts and len(matrix) == len(counts)
        totals = Counter()
        for (s, k, _), c in counts.items():
            totals[s, k] += c
        assert all(r.value == pytest.approx(math.log1p(1e4 * r["count"] / totals[r["sample"], r.unit])) for r in matrix)
        summary = {r["sample"]: r for r in sample_features.read(spark, out, "summary").collect()}
        assert {s: r.n_units for s, r in summary.items()} == units
        assert all(summary[s].n_empty == n - len({k for t, k in totals if t == s}) for s, n in units.items())
        ranks = defaultdict(list)
        for r in sample_features.read(spark, out, "variable").collect():
            ranks[r["sample"]].append((r.rank, -r.score, r.feature))
        assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in ranks.values())


def test_features_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"file://{tmp_path}/docs")
    assert sample_features.run(spark, f"file://{tmp_path}/docs", f"file://{tmp_path}/out")["samples"] == 0


def test_command_lines(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    add(spark, FIRST, f"file://{tmp_path}/events")
    spark.createDataFrame(DOCS, DOC).write.parquet(f"file://{tmp_path}/docs")
    own = tmp_path / "config.json"
    own.write_text('{"nodes": 4, "threshold": 0.5, "files_per_trigger": 8}')
    for args in (["trajectory_feed", "--events", "events", "--out", "one", "--checkpoint", "mark", "--config", str(own)], ["sample_features", "--documents", "docs", "--out", "two"]):
        done = subprocess.run([sys.executable, "-m", f"jobs.{args[0]}", *[a if a[0] in "-/" else f"file://{tmp_path}/{a}" for a in args[1:]]], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "read" in done.stderr, done.stderr[-2000:]
    assert trajectory_feed.read_nodes(spark, f"file://{tmp_path}/one").count() == 4
    assert sample_features.read(spark, f"file://{tmp_path}/two", "summary").count() == 2


def _shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.length())}


def test_features_are_shuffled_a_few_times_only(spark, tmp_path):
    """Once by feature and once by unit, besides sums of them; not once for each table that needs them."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, 200)), "en", f"s{k % 3}", 0) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int").write.parquet(str(tmp_path / "documents"))
    before = set(_shuffled_rows(spark))
    sample_features.run(spark, str(tmp_path / "documents"), str(tmp_path / "out"))
    moved = sum(n for k, n in _shuffled_rows(spark).items() if k not in before)
    assert moved < 3 * sample_features.read(spark, str(tmp_path / "out"), "matrix").count()


def test_counts_stay_with_their_unit(spark, tmp_path):
    """A unit is one row in every shuffle, so that fewer rows move than the matrix has; each count moved twice before."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, 200)), "en", f"s{k % 3}", 0) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int").write.parquet(str(tmp_path / "documents"))
    before = set(_shuffled_rows(spark))
    sample_features.run(spark, str(tmp_path / "documents"), str(tmp_path / "out"))
    moved = sum(n for k, n in _shuffled_rows(spark).items() if k not in before)
    assert moved < sample_features.read(spark, str(tmp_path / "out"), "matrix").count()


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_units_over_several_pieces(monkeypatch, piece):
    """Rows of one unit lie in several batches and pieces; words are those of plain Python."""
    odd = ["", " ,. !! ", "The cat-1 SAT\x0bon «Mat»\x1c(mat)! x", "a\tb\r\nb --b- 'B'", "ÄÖ äö [İ]", "!!! a!b !"]
    docs = sorted((("a", "b", "c")[k % 3], k % 7, odd[k * 5 % 6] + f" w{k % 4}" * (k % 3)) for k in range(60))
    schema = pa.schema([("sample", pa.string()), ("unit", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in docs[k : k + 4]], schema) for k in range(0, 60, 4)]
    monkeypatch.setattr(sample_features, "PIECE", piece)
    rows = [r for b in sample_features._count_words([*batches, batches[0].slice(0, 0)]) for r in b.to_pylist()]
    got = {(r["sample"], r["unit"]): dict(zip(r["features"].split(" "), r["counts"])) if r["counts"] else {} for r in rows}
    want, _ = plain_counts([(k, text, None, s, 0) for s, k, text in docs], 1)
    assert len(got) == len(rows) == 21 and {(s, k, w): n for (s, k), c in got.items() for w, n in c.items()} == want
    assert all(r["total"] == sum(r["counts"]) for r in rows)


@pytest.mark.parametrize("least", [1, 2, 3, 4, 6])
def test_rare_features_of_any_bound(spark, least):
    rng = np.random.default_rng(least)
    docs = [sorted({f"w{int(x)}" for x in rng.zipf(1.6, int(rng.integers(0, 30))) if x < 500}) for _ in range(80)]
    seen = Counter(w for d in docs for w in d)
    rows = [(f"s{k % 3}", k, " ".join(d), [len(w) for w in d], sum(map(len, d))) for k, d in enumerate(docs)]
    from pyspark.sql import functions as F

    from lattiq.operators import samples
    from lattiq.session import cut

    units = cut(spark.createDataFrame(rows, "sample string, unit long, features string, counts array<long>, total long").repartition(3).select(F.monotonically_increasing_id().alias("row"), "*"))
    left = samples.without_rare(units, cut(samples.rare_places(units, least)), 3)
    got = {(r.unit, r.feature): (r["count"], r.value) for r in samples.normalise(left).collect()}
    kept = {k: [w for w in d if seen[w] >= least] for k, d in enumerate(docs)}
    total = {k: sum(map(len, d)) for k, d in kept.items()}
    assert {k: c for k, (c, _) in got.items()} == {(k, w): len(w) for k, d in kept.items() for w in d}
    assert all(v == pytest.approx(math.log1p(1e4 * c / total[k])) for (k, _), (c, v) in got.items())
    assert {r.unit: (r.n_left, r.total_left) for r in left.collect()} == {k: (len(d), total[k]) for k, d in kept.items()}


@pytest.mark.parametrize("piece", [1, 1000])
def test_units_without_a_number(monkeypatch, piece):
    """Rows of a null id are one unit of their sample; ids beyond 2**53 beside them stay apart."""
    rows = [("a", None, "x"), ("a", None, "x y"), ("a", 2**53, "p"), ("a", 2**53 + 1, "q"), ("b", None, "z"), ("b", 0, "z")]
    schema = pa.schema([("sample", pa.string()), ("unit", pa.int64()), ("text", pa.string())])
    monkeypatch.setattr(sample_features, "PIECE", piece)
    got = [tuple(r.values())[:4] for b in sample_features._count_words([pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)]) for r in b.to_pylist()]
    assert got == [("a", None, "x y", [2, 1]), ("a", 2**53, "p", [1]), ("a", 2**53 + 1, "q", [1]), ("b", None, "z", [1]), ("b", 0, "z", [1])]
