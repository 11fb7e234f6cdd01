"""Count matrix, variable features and a summary of every sample of a text table.

    python -m jobs.sample_features --documents PATH --out PATH [--config FILE]

A document is a unit, its words are features, its source is the sample: the preparation that spatial and single-cell
tables get (feature filter, normalised log counts, variable features, a summary row a sample), for all samples in one
plan. Each run replaces the three tables with those of its input, so that a rerun ends in the same rows, whatever an
earlier or broken run left:

* matrix/sample=S     unit, feature, count, value
* variable/sample=S   rank, feature, n_found, mean, dispersion, score
* summary/sample=S    n_units, n_empty, n_features, total, largest, mean_features, mean_total

A word is what lies between ASCII white space, lower-cased (A-Z) and without ASCII punctuation at its ends. Documents
with a null or empty text are units without features; a null source is the sample "none". A sample may hold a third of
all rows: ranges of its units go to several writing tasks, and files have a bounded number of rows. The folders _counts,
_rare, _units and _moments hold what the last run staged.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import samples

log = logging.getLogger("jobs.sample_features")
DEFAULTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sample_features.json")

#: Most samples whose bins (a few rows a sample) are broadcast.
FEW_SAMPLES = 5000
#: Rows of texts whose words a task counts at once.
PIECE = 1000
UNIT_COLUMNS = ["sample", "unit", "features", "counts", "total"]
UNITS = "sample string, unit long, features string, counts array<long>, total long"
MATRIX = "unit long, feature string, count long, value double, sample string"
VARIABLE = "rank int, feature string, n_found long, mean double, dispersion double, score double, sample string"
SUMMARY = "n_units long, n_empty long, n_features long, total long, largest long, mean_features double, mean_total double, sample string"


def load_config(path: str = DEFAULTS) -> dict:
    with open(path) as f:
        return json.load(f)


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A row a unit of rows sorted by (sample, unit): its words, lower-cased (A-Z), without ASCII punctuation at their ends, each once, joined by blanks (no word has one), with their counts."""
    # a null unit is one of its own, and large numbers stay exact
    keys = [c.to_numpy(zero_copy_only=False) for c in (rows["sample"], pc.is_null(rows["unit"]), pc.fill_null(rows["unit"], 0))]
    starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    words = pc.ascii_split_whitespace(pc.ascii_lower(rows["text"]))
    n = np.diff(words.offsets.to_numpy())
    at = np.repeat(np.searchsorted(starts, np.arange(len(n)), "right") - 1, n)
    flat = pc.ascii_trim(words.flatten(), string.punctuation)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    keys, counts = np.unique(at[some] * np.int64(size) + coded.indices.to_numpy()[some], return_counts=True)
    ends = pa.array(np.searchsorted(keys, np.arange(len(starts) + 1) * np.int64(size)), pa.int32())
    features = pc.binary_join(pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(keys % size))), " ")
    totals = pa.array(np.bincount(at[some], minlength=len(starts)), pa.int64())
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([rows["sample"].take(first), rows["unit"].take(first), features, pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), totals], UNIT_COLUMNS)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row from rows of the same unit."""
    some = [p for p in parts if p["features"][0].as_py()] or parts[:1]
    if len(some) == 1:
        return some[0]
    words = pc.split_pattern(pa.concat_arrays([p["features"] for p in some]), " ").flatten().dictionary_encode()
    n = np.zeros(len(words.dictionary), np.int64)
    np.add.at(n, words.indices.to_numpy(), np.concatenate([p["counts"].flatten().to_numpy() for p in some]))
    features = pa.array([" ".join(words.dictionary.to_pylist())], pa.string())
    return pa.RecordBatch.from_arrays([parts[0]["sample"], parts[0]["unit"], features, pa.array([n], pa.list_(pa.int64())), pa.array([n.sum()], pa.int64())], UNIT_COLUMNS)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a unit from rows sorted by (sample, unit). The last unit of a piece waits for the next, which may go on with it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for k in range(0, b.num_rows, PIECE):
            found = _counted(b.slice(k, PIECE))
            if held and all(held[0][c][0].as_py() == found[c][0].as_py() for c in ("sample", "unit")):
                held.append(found.slice(0, 1))
                found = found.slice(1)
            if found.num_rows:
                if held:
                    yield _joined(held)
                yield found.slice(0, found.num_rows - 1)
                held = [found.slice(found.num_rows - 1)]
    if held:
        yield _joined(held)


def units_of(documents: DataFrame) -> DataFrame:
    """row, sample, unit, features, counts, total: a row a unit; rows of one doc_id are one unit of each of their samples.
    A task gives a range of units, and row is a number of its own that rises with the task."""
    docs = documents.select(F.coalesce("source", F.lit("none")).alias("sample"), F.col("doc_id").cast("long").alias("unit"), F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.repartitionByRange("sample", "unit").sortWithinPartitions("sample", "unit").mapInArrow(_count_words, UNITS)
    return counted.select(F.monotonically_increasing_id().alias("row"), "*")


def _write(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", rows_per_file).partitionBy("sample").parquet(path)


def _staged(df: DataFrame, path: str) -> DataFrame:
    """df written below the output folder and read again; Spark's readers skip names that begin with _."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict:
    """Read documents and write the three tables below out; returns counts of what was read and written.

    Texts are dealt to their units before they are split, so that words are counted where they are; the counts are written
    once (out/_counts), a row a unit. A unit's features stay one row through all shuffles until the matrix is written:
    the filter finds the places of rare features by sums over features, and drops them there.
    """
    config = load_config() | (config or {})
    units = _staged(units_of(spark.read.parquet(documents)), f"{out}/_counts")
    rare = _staged(samples.rare_places(units, config["least_units"]), f"{out}/_rare")
    lots = (units.agg(F.max(samples.lot_of("row"))).first()[0] or 0) + 1
    left = samples.without_rare(units, rare, lots)
    _write(samples.normalise(left, config["target"]), f"{out}/matrix", config["rows_per_file"])
    n_units = _staged(samples.sizes(units), f"{out}/_units")
    moments = _staged(samples.feature_moments(read(spark, out, "matrix"), n_units), f"{out}/_moments")
    few = n_units.count() <= FEW_SAMPLES
    variable = samples.variable_features(moments, config["top"], config["bins"], few).select("rank", "feature", "n_found", "mean", "dispersion", "score", "sample")
    _write(variable.hint("rebalance", "sample"), f"{out}/variable", config["rows_per_file"])
    left = samples.without_rare(units.drop("features"), rare, lots)
    s = samples.summary(left, n_units, moments).select("n_units", "n_empty", "n_features", "total", "largest", "mean_features", "mean_total", "sample")
    _write(s.hint("rebalance", "sample"), f"{out}/summary", config["rows_per_file"])
    done = read(spark, out, "summary").agg(F.count("*").alias("samples"), F.sum("n_units").alias("units"), F.sum("total").alias("counts")).first().asDict()
    log.info("read %s from %s; wrote matrix, variable and summary of %d samples into %s", done, documents, done["samples"], out)
    return done


def read(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.schema({"matrix": MATRIX, "variable": VARIABLE, "summary": SUMMARY}[table]).parquet(f"{out}/{table}")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=DEFAULTS)
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("sample_features").getOrCreate()
    try:
        run(spark, a.documents, a.out, load_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
