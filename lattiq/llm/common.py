"""Helpers shared by the corpus operators: staged tables, ordered running totals, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but space and the ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED = "_lattiq_shipped"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a temporary one where unset."""
    try:
        path = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the setting is absent
        path = None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_folder(spark.sparkContext.applicationId)
    return path.rstrip("/")


@cache
def _own_folder(app: str) -> str:
    """One folder an application; the setting itself can't be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="lattiq_")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattiq/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts lineage and freezes values; a lost executor costs a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote and that nothing reads any more: what came of them is staged too."""
    for t in tables:
        drop_path(t.sparkSession, t.staged_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to executors once, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lattiq_py_")
    target = os.path.join(os.path.realpath(folder), "lattiq_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


#: Rows and bytes of an Arrow batch of whole texts; texts run to hundreds of kB, and Spark's 10,000 rows are too many.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches, unless the session has bounds of its own."""
    ship(spark)
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES)):
        now = spark._jsparkSession.conf().get(key)
        if usual is None and not spark.conf.get("lattiq.batches", "") or now == usual:
            spark.conf.set(key, str(value))
    spark.conf.set("lattiq.batches", "set")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the named columns with casts; anything else in df, clashing names included, is left out."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_batches(texts: list, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts of about limit characters each, at least one text a slice."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x) if x is not None else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def column_batches(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """The same for an Arrow column of texts, by their bytes."""
    upto = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(column):
        base = upto[start - 1] if start else 0
        end = min(int(np.searchsorted(upto, base + limit)) + 1, len(column))
        yield start, end
        start = end


def arrow_map(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """mapInArrow where fn takes a RecordBatch and yields lists of columns in the order of schema."""
    prepare(df.sparkSession)
    names = schema.names
    kinds = _arrow_types(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cols in fn(b):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)

    return df.mapInArrow(run, schema)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def running_total(df: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """df with column out: the sum of value over all rows before this one in the order of the columns order.

    Rows are range-partitioned once; each partition streams its own running sum, and the totals of the
    partitions (one number each) are summed on the driver. No task ever sees more than its own range.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(ends - v)], names=[*b.schema.names, "_part", "_local"])
            total = int(ends[-1]) if len(v) else total

    kept = staged(df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    sums = sorted((r["_part"], r["s"]) for r in kept.groupBy("_part").agg(F.sum(value).alias("s")).collect())
    base, offsets = 0, []
    for p, s in sums:
        offsets.append((p, base))
        base += int(s or 0)
    if not offsets:
        return kept.select(*df.columns, F.col("_local").alias(out))
    table = spark.createDataFrame(offsets, "_part int, _base long")  # one row a partition
    return kept.join(F.broadcast(table), "_part").select(*df.columns, (F.col("_local") + F.col("_base")).alias(out))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) in any order -> star edges (node, smallest node of its component), without self edges."""
    if not len(a):
        return a.astype(np.int64), b.astype(np.int64)
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:  # labels are roots here; only roots are hooked, each to its smallest linked root
        x, y = label[i], label[j]
        keep = x != y
        if not keep.any():
            break
        i, j, x, y = i[keep], j[keep], x[keep], y[keep]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved].astype(np.int64), nodes[label[moved]].astype(np.int64)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a long, b long) -> (node, component), component the smallest node.

    Rounds of large-star and small-star over a distributed edge table, each round written to the shared
    folder, from which the round before is deleted, until only flat stars are left. Nodes without an edge are not listed.
    """

    def local(batches):
        for b in batches:
            x, y = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    schema = "a long, b long"
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    star = staged(star.mapInArrow(local, schema), f"{name}-edges")
    for k in count():
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written apart from the joins, so that Spark may split a node with very many links there
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low{k}")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, f"{name}-large{k}")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least{k}")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, star = star, staged(small, f"{name}-round{k}")
        unstage(last, low, large, least)
        single = star.groupBy("a").count().where("count > 1").isEmpty()
        if single and star.join(star.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():  # flat stars: settled
            return star.select(F.col("a").alias("node"), F.col("b").alias("component"))


def text_sha():
    """SHA-256 of column text as it stands, a null text as the empty one."""
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def survivors(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each component of groups (text_sha, component), in the columns of docs.

    The smallest doc_id stays, rows without one come last, and texts of one doc_id are ordered by their SHA-256.
    """
    rows = docs.withColumn("__lattiq_sha", text_sha())
    named = rows.select(F.col("doc_id").alias("__lattiq_id"), "__lattiq_sha").join(groups.select(F.col("text_sha").alias("__lattiq_sha"), "component"), "__lattiq_sha")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("__lattiq_id").isNull().alias("none"), F.col("__lattiq_id").alias("id"), F.col("__lattiq_sha").alias("sha"))).alias("m"))
    best = staged(best.select(F.col("m.id").alias("__lattiq_id"), F.col("m.sha").alias("__lattiq_sha")), "survivors")
    rows = rows.join(best, rows["doc_id"].eqNullSafe(best["__lattiq_id"]) & (rows["__lattiq_sha"] == best["__lattiq_sha"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", "__lattiq_sha").orderBy("doc_id"))
    return rows.withColumn("__lattiq_n", turn).where("__lattiq_n = 1").select(*docs.columns)
