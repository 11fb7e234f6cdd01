"""Quality rules: SQL on the given tables, plain Python on odd and random texts."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402

from lattiq.llm import rules  # noqa: E402
from lattiq.llm.queries import oracle_sql, queries  # noqa: E402


def plain(text):
    """The contract's statistics, counted one by one."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base


def held(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text), repr(text)[:80]
        assert not (r.base_failed and r.kept)
    return rows


def test_equals_sql(spark):
    left, right = oracle.compare(spark, oracle.connect("/root/testdata/sf0.001"), queries()["op12_quality_rules"], oracle_sql()["op12_quality_rules"], "/root/testdata/sf0.001")
    assert left == right and {r[3] for r in left} | {r[1] for r in left}


def test_odd_texts(spark):
    held(spark, [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\n x\nx \nx", "    é 𝔘𝔫𝔦 \x0b\x0c\r", "# * $ % & | < > #a#", "a\r\na\r\nb", "\x00 \x1c\x1d \x85"])


def test_random_texts(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", "c", " ", " ", " ", "\n", "#", "ü", "\t", "𝔘"]) for _ in range(r.randrange(400))) for _ in range(300)]
    held(spark, texts)


def test_long_texts_and_copies(spark):
    """One word 300,000 times (all windows equal), and as many different words."""
    held(spark, ["w " * 300_000, " ".join(f"w{i}" for i in range(300_000)), "w " * 300_000])


def test_every_rule_rejects(spark):
    """A text that fails each rule alone, and one that passes all."""
    words = [f"w{i}ord" for i in range(60)]
    good = " ".join(f"{w} the" for w in words)
    texts = {
        None: good,
        "word_length": " ".join(w + "x" * 30 for w in words) + " the a of" * 2,
        "symbols": good + " " + "#" * 40,
        "exclamations": good + "!" * 60,
        "stop_words": " ".join(words),
        "duplicate_lines": good + "\nx y" * 4,
        "bullet_lines": "\n".join(f"- {w} the of" for w in words),
        "ellipsis_lines": "\n".join(f"{w} the of..." for w in words),
    }
    rows = held(spark, list(texts.values()))
    for k, name in enumerate(texts):
        assert rows[k].failed == ([name] if name else []), name
        assert rows[k].kept == (name is None)


def test_table_is_a_parameter_and_no_python_runs(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "x", "y")], "doc_id long, text string, words string, windows string")
    out = rules.quality_rules(docs, (rules.Rule("few", "n_words", 100, None),))
    assert out.first().failed == ["few"] and rules.quality_rules(docs, ()).first().kept
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert rules.quality_rules(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("quality, share", [(1, 0.97), (0, 0.03)])
def test_labelled_documents(spark, quality, share):
    """Of the clean documents long enough to pass, nearly all are kept; of the others nearly none."""
    sf = "/root/testdata/sf0.01"
    d = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).where("n_words >= 50").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(F.col("quality") == quality)
    kept = d.agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert kept >= share if quality else kept <= share
