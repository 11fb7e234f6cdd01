"""Readers and writers of the file formats the model's inputs and reports come in.

HDF5 files (h5ad, h5) have no Spark reader; convert them to Parquet first.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, **options: str) -> DataFrame:
    """CSV or TSV, gzip included; with a schema no pass for inference is made."""
    r = spark.read.option("sep", sep).option("header", str(header).lower()).options(**options)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names alone: the first line is all that is read."""
    first = spark.read.text(path).limit(1).first()
    return first["value"].split(sep) if first else []


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """i, j (from 1), value of a MatrixMarket coordinate file. Comments and the line of dimensions are left out.

    The line of dimensions is the first that is no comment: the one with the smallest place in the file, found by
    monotonically growing ids, which follow the file's order.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("v")).where(~F.col("v").startswith("%") & (F.col("v") != ""))
    dims = lines.agg(F.min("n").alias("first"))
    cells = lines.join(F.broadcast(dims)).where(F.col("n") > F.col("first")).select(F.split("v", r"\s+").alias("p"))
    return cells.select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0)).alias("value"))


def write_matrix_market(df: DataFrame, path: str, rows: int, cols: int) -> None:
    """Write (i, j, value) as MatrixMarket text: one file, as the format asks, its lines in order of (j, i)."""
    n = df.count()
    head = df.sparkSession.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 1, f"{rows} {cols} {n}")], "a long, b long, line string")
    body = df.select(F.col("j").cast("long").alias("a"), F.col("i").cast("long").alias("b"), F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")).alias("line"))
    head.unionByName(body).orderBy("a", "b").select("line").coalesce(1).write.text(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """barcode, x, y of spots in tissue, from a positions file with or without a header."""
    names = ["barcode", "in_tissue", "array_row", "array_col", "row", "col"]
    raw = spark.read.option("header", "false").csv(path)
    raw = raw.select(*[F.col(c).alias(n) for c, n in zip(raw.columns, names)])
    return raw.where("try_cast(in_tissue as int) = 1").select("barcode", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))


def read_labelled_matrix(spark: SparkSession, path: str, label_row: str = "Cluster_Number", sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(cells, counts) from a ragged genes by cells table whose header is the cells' names.

    Short rows are filled with 0 and long ones cut. counts has cell, gene, count of nonzero entries; cells has
    cell and label from the label row. Raises where the label row is missing.
    """
    cells = header_of(spark, path, sep)[1:]
    n = len(cells)
    lines = spark.read.text(path).select(F.split("value", sep).alias("p")).where(F.col("p")[0] != "").where(F.col("p")[0] != sep.join(["", *cells])[:0])
    lines = lines.select(F.trim(F.col("p")[0]).alias("gene"), F.transform(F.sequence(F.lit(2), F.lit(n + 1)), lambda k: F.coalesce(F.try_element_at("p", k), F.lit("0"))).alias("v"))
    lines = lines.where(F.col("v") != F.array(*[F.lit(c) for c in cells])) if n else lines
    if lines.where(F.col("gene") == label_row).isEmpty():
        raise ValueError(f"no row {label_row!r} in {path}")
    names = spark.createDataFrame(list(enumerate(cells)), "pos int, cell string")
    long = lines.select("gene", F.posexplode("v").alias("pos", "value")).join(F.broadcast(names), "pos")
    labels = long.where(F.col("gene") == label_row).select("cell", F.trim("value").alias("label"))
    counts = long.where(F.col("gene") != label_row).select("cell", "gene", F.expr("try_cast(value as double)").alias("count")).where("count <> 0")
    return labels, counts


def match_names(left: DataFrame, right: DataFrame, name: str = "gene") -> DataFrame:
    """Names of both tables that agree but for case: name_left, name_right; the first of repeats in each."""
    first = lambda d, out: d.select(F.col(name).alias(out), F.lower(name).alias("_k")).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(out))).where("_n = 1").drop("_n")
    return first(left, "name_left").join(first(right, "name_right"), "_k").drop("_k")


def subsample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same ones at each call: those whose hashed key is smallest."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def write_table(df: DataFrame, path: str, kind: str = "parquet", digits: int | None = None) -> None:
    """Write as parquet, csv or json; doubles rounded where digits are given."""
    if digits is not None:
        df = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.option("header", "true").csv(p)}[kind](path)


def to_jsonable(value: Any, most: int = 5000) -> Any:
    """Plain values for JSON: tuple keys joined, arrays beyond most elements replaced by their size."""
    if isinstance(value, dict):
        return {"|".join(map(str, k)) if isinstance(k, tuple) else str(k): to_jsonable(v, most) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_jsonable(v, most) for v in value] if len(value) <= most else f"<{len(value)} values>"
    if hasattr(value, "tolist"):
        return to_jsonable(value.tolist(), most)
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def dump_report(value: Any, path: str) -> None:
    with open(path, "w") as f:
        json.dump(to_jsonable(value), f, indent=1, sort_keys=True)


def latex_table(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """line: rows of a LaTeX table."""
    cells = [F.format_string(f"%.{digits}f", F.col(c)) if dict(df.dtypes)[c] == "double" else F.col(c).cast("string") for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))
