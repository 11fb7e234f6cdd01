"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is its weight's share of all words, at most CAP times what the source has; what
the cap cuts off is shared again by weight. Within a source, a document's expected number of copies falls with its
length: a document of twice the words has 2^-TILT of the copies, CAP at most, at a level at which the source's expected
words are its target. The whole part of that number is certain, the rest is the document's inclusion probability p.

Each document draws u from a hash of its id and the seed; the source's documents are ranked by the odds of u over the
odds of p, and the first ones make up the sample. Its size is fixed in words, the unit of the targets: ranks are taken
until the next document would exceed what the certain copies leave of the target. What is then open, less than one
document, goes to the documents behind: of each size the first by rank, larger sizes first, again and again until
no document that was left out fits. So a source falls short of its target by less than the smallest document left out.

Ranks are cut into buckets of about BUCKET_ROWS rows. Bucket sums decide which buckets are taken whole, and only the
bucket where a source's target is reached is ordered row by row, so the largest source never meets in one task.

Defined cases: a null or empty text has size zero and is never sampled beyond the certain copies; sources
that are null form one source, last in order; rows that repeat in id, source and size count as one entry with their
number and are taken one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, only, staged

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 20_011
#: Fall of the expected copies with each doubling of a document's words, as a power of two.
TILT = 0.125
BUCKET_ROWS = 4096
#: Plans of up to so many rows are broadcast; larger ones are joined by a shuffle with salted keys.
BROADCAST_ROWS = 50_000
SALTS = 32
#: Rows alike that one row of the result stands for at most before they are dealt out.
ALIKE_ROWS = 100_000


def _filled(parts: DataFrame, by: list[str], tie: list, total) -> DataFrame:
    """parts (limit, weight) with given = min(limit, level * weight), the level being the one at which given adds up to
    total within by. Where limits don't reach the total, they are given whole."""
    everything = Window.partitionBy(*by)
    by_fill = everything.orderBy(F.col("limit") / F.col("weight"), *tie)
    w = parts.withColumn("_before", F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("_open", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("_level", (total(everything) - F.col("_before")) / F.col("_open"))
    # the level is the first at which the part at hand is not filled up; later ones are not either
    w = w.withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.col("_level")))
    w = w.withColumn("_cut", F.first("_fits", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    given = F.least("limit", F.coalesce(F.col("_cut") * F.col("weight"), F.col("limit")))
    return w.withColumn("given", given).drop("_before", "_open", "_level", "_fits", "_cut")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_rows) -> with target: the words each source gives, a double.

    A target is min(cap * size, level * weight) with the one level at which targets sum to all words. The table
    has a row a source, so ordering it in one task is bounded by the number of sources.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.select("source", "source_size", "n_rows", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    w = w.withColumn("limit", F.col("source_size") * F.lit(cap))
    w = _filled(w, [], [F.asc_nulls_last("source")], lambda every: F.sum("source_size").over(every))
    return w.select("source", "source_size", "n_rows", F.col("given").alias("target"))


def size_class():
    """Doublings of a document's words, 0 for the empty text too."""
    return F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(F.lit(0)).cast("int")


def copies_by_class(classes: DataFrame, tilt: float = TILT, cap: float = CAP) -> DataFrame:
    """(source, class, class_size, source_size, target) -> with expected, whole and p: a document's expected copies, the
    certain ones and the inclusion probability of one more. A source has a row a doubling, 64 at most."""
    w = classes.withColumn("limit", F.col("class_size") * F.lit(cap)).withColumn("weight", F.col("class_size") * F.pow(F.lit(2.0), F.col("class") * F.lit(-tilt)))
    full = _filled(w.where("class_size > 0"), ["source"], [F.col("class")], lambda every: F.max("target").over(every))
    # a level beyond every limit comes of rounding: the cap then holds
    expected = F.col("given") / F.col("class_size")
    whole = F.floor(expected + F.lit(1e-9))
    return full.select(*classes.columns, expected.alias("expected"), whole.cast("int").alias("whole"), F.greatest(expected - whole, F.lit(0.0)).alias("p"))


def _joined(rows: DataFrame, table: DataFrame, count: int, extra: str | None = None) -> DataFrame:
    """rows joined with a table of at most a row a source, or a source and value of the column extra; null sources too."""
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    key = lambda d: d.withColumn("_key", F.struct(name, *([F.col(extra)] if extra else []))).drop("source", *([extra] if extra else []))
    kept = rows.withColumn("_key", F.struct(name, *([F.col(extra)] if extra else [])))
    if count <= BROADCAST_ROWS:
        return kept.join(F.broadcast(key(table)), "_key").drop("_key")
    spread = key(table).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return kept.join(spread, ["_key", "_salt"]).drop("_key", "_salt")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of each row."""
    return only(docs, doc_id="long", text="string", source="string").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def uniform(seed: int):
    """u in (0, 1) from 52 bits of the hash of doc_id."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


_PICKS = "source string, doc_id long, size long, extra long"


def _closers(open_: DataFrame) -> DataFrame:
    """Fill what is open (rest) of each source from its candidates (one a size), larger sizes first."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        rest, out = float(pdf["rest"].iloc[0]), []
        for size, n in zip(pdf["size"].tolist(), pdf["n"].tolist()):
            k = min(int(n), int(rest // size))
            rest -= k * size
            out.append(k)
        pdf = pdf.assign(extra=out)
        return pdf[pdf["extra"] > 0][["source", "doc_id", "size", "extra"]]

    return open_.groupBy("source").applyInPandas(fill, _PICKS)


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, tilt: float = TILT) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, expected (copies), copies (int), taken (words)."""
    rows = sized(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = staged(rows.withColumn("class", size_class()), "sizes")
    classes = staged(rows.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("n")).alias("class_size"), F.sum("n").alias("n_rows")), "classes")
    sources = staged(source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size"), F.sum("n_rows").alias("n_rows")), weights, cap), "sources")
    n_plan = classes.count()
    known = _joined(classes.drop("n_rows").withColumn("doc_id", F.lit(0)).withColumn("size", F.lit(0)), sources, n_plan).drop("doc_id", "size")
    plan = copies_by_class(known, tilt, cap)
    plan = staged(known.join(plan.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "expected", "whole", "p"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left").na.fill(0, ["expected", "whole", "p"]).drop("_s", "_c"), "plan")
    wanted = staged(plan.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("class_size"))).alias("rest")), "rest")

    rows = _joined(rows, plan.drop("class_size"), n_plan, "class")
    u = uniform(seed)
    rank = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), rank))
    # documents are drawn about where the rank is 1, so buckets are equal in rank / (1 + rank)
    buckets = F.greatest(F.lit(1.0), F.ceil(F.col("n_rows") / BUCKET_ROWS).cast("double"))
    bucket = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * buckets), buckets - 1).cast("long")
    rows = staged(rows.withColumn("bucket", bucket).drop("n_rows", "class"), "ranks")

    free = _joined(rows.where("rank is not null").select("doc_id", "source", "size", "n", "rank", "bucket"), wanted, n_plan)
    sums = free.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(upto), F.lit(0)))
    over = F.col("before") + F.col("s") > F.col("rest")
    # the first bucket that would exceed the rest; nothing where all buckets are taken
    edges = staged(sums.groupBy("source").agg(F.min(F.when(over, F.struct("bucket", "before"))).alias("edge")).select("source", F.col("edge.bucket").alias("edge_bucket"), F.col("edge.before").alias("before")), "edges")
    here = _joined(free, edges, n_plan)
    inside = here.where("edge_bucket is null or bucket < edge_bucket").select("source", "doc_id", "size", F.col("n").alias("extra"))
    along = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    edge = here.where("bucket = edge_bucket").withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before"))
    edge = staged(edge.withColumn("extra", F.greatest(F.lit(0), F.least("n", F.floor((F.col("rest") - F.col("at")) / F.col("size"))))), "edge")
    # up to the first entry that does not go in whole
    stop = edge.where("extra < n").groupBy("source").agg(F.min("at").alias("stop"))
    edge = _joined(edge, stop, n_plan).withColumn("extra", F.when(F.col("at") <= F.col("stop"), F.col("extra")).otherwise(F.lit(0)).cast("long"))
    took = staged(inside.unionByName(edge.where("extra > 0").select("source", "doc_id", "size", "extra")), "took")

    picked, behind = took, here.where("bucket > edge_bucket").select("source", "doc_id", "size", "n", "rank")
    left = edge.where("extra < n").select("source", "doc_id", "size", (F.col("n") - F.col("extra")).alias("n"), "rank")
    behind = behind.unionByName(left)
    while True:
        spent = picked.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("spent"))
        now = wanted.join(spent.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("rest"))
        behind = staged(_joined(behind, staged(now, "open"), n_plan).where("size <= rest"), "behind")
        if behind.isEmpty():
            break
        # one candidate a size: a source has fewer of them than its open words, less than one document's
        first = behind.groupBy("source", "size").agg(F.min(F.struct("rank", "doc_id", "n")).alias("f"), F.max("rest").alias("rest"))
        more = staged(_closers(first.select("source", "size", F.col("f.doc_id").alias("doc_id"), F.col("f.n").alias("n"), "rest")), "closers")
        picked = staged(picked.unionByName(more), "picked")
        used = more.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_z"), "extra")
        same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z"))
        behind = behind.join(used, same, "left").select("source", "doc_id", "size", (F.col("n") - F.coalesce("extra", F.lit(0))).alias("n"), "rank").where("n > 0")

    extra = picked.groupBy("doc_id", "source", "size").agg(F.sum("extra").alias("extra")).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "extra")
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z"))
    out = rows.join(extra, same, "left").select("doc_id", "source", "size", "source_size", "target", "expected", "whole", "n", F.coalesce("extra", F.lit(0)).alias("extra"))
    # rows alike: the first ones of them get the copies beyond the certain ones
    most = rows.agg(F.max("n")).first()[0] or 1
    if most > ALIKE_ROWS:
        out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE_ROWS))).alias("_from")).repartition("doc_id", "size", "_from")
    else:
        out = out.withColumn("_from", F.lit(0).cast("long"))
    out = out.select("*", F.explode(F.sequence(F.col("_from") + 1, F.least("n", F.col("_from") + ALIKE_ROWS))).alias("_k"))
    copies = (F.col("whole") + F.when(F.col("_k") <= F.col("extra"), 1).otherwise(0)).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, in its own columns."""
    plan = pareto_mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    rows = docs.withColumn("__lattiq_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("__lattiq_n", F.row_number().over(Window.partitionBy("doc_id", "source", "__lattiq_size").orderBy("doc_id")))
    plan = plan.select(F.col("doc_id").alias("__lattiq_d"), F.col("source").alias("__lattiq_s"), F.col("size").alias("__lattiq_z"), F.col("copies").alias("__lattiq_c"), F.col("rows").alias("__lattiq_r"))
    both = rows.join(plan, rows["doc_id"].eqNullSafe(plan["__lattiq_d"]) & rows["source"].eqNullSafe(plan["__lattiq_s"]) & (rows["__lattiq_size"] == plan["__lattiq_z"]))
    own = (F.floor(F.col("__lattiq_c") / F.col("__lattiq_r")) + F.when(F.col("__lattiq_n") <= F.pmod(F.col("__lattiq_c"), F.col("__lattiq_r")), 1).otherwise(0)).cast("int")
    return both.select(*docs.columns, own.alias("__lattiq_own")).where("__lattiq_own > 0").withColumn("__lattiq_i", F.explode(F.sequence(F.lit(1), F.col("__lattiq_own")))).select(*docs.columns)
