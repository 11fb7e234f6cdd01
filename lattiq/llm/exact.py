"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get one integer name: blocks are sorted
by content within hash partitions and numbered. Names of adjacent blocks are paired, the pairs named in the
same way, and so on, until each text has one name. Two texts have the same identity exactly if they are the
same bytes; no hash is trusted.

A block is sent to the sort once an Arrow batch, with a reference that its other places share; the blocks met last
are remembered by a task over its batches (RECENT_BLOCKS of them), so a block that a third of all texts hold reaches
the sort once a task, not once a text.

Defined cases: a null text is the empty text; A-Z alone are folded; rows that repeat a doc_id and text are
members of one group, of which one row is kept; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, byte_batches, only, staged, unstage

BLOCK_BYTES = 8192
#: Blocks that a task remembers from batch to batch: at most 16 MiB of them.
RECENT_BLOCKS = 2048

_CUT = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_sha256", T.StringType()),
    T.StructField("n_blocks", T.IntegerType()),
    T.StructField("refs", T.ArrayType(T.LongType())),
    T.StructField("fresh", T.ArrayType(T.StructType([T.StructField("ref", T.LongType()), T.StructField("block", T.BinaryType())]))),
])


def _cutter(block_bytes: int):
    count = {"rows": 0, "refs": 0}
    recent: OrderedDict[bytes, int] = OrderedDict()  # block -> ref, the one met last at the end

    def cut(b: pa.RecordBatch):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        seen: dict[bytes, int] = {}
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in byte_batches(texts):
            out: list[list] = [[] for _ in _CUT.fields]
            for doc_id, text in zip(ids[lo:hi], texts[lo:hi]):
                raw = (text or "").encode().lower()  # bytes.lower folds A-Z only
                refs, fresh = [], []
                for at in range(0, max(len(raw), 1), block_bytes):
                    block = raw[at : at + block_bytes]
                    ref = seen.get(block)
                    if ref is None:
                        ref = recent.get(block)
                        if ref is None:
                            ref = base + count["refs"]
                            count["refs"] += 1
                            fresh.append({"ref": ref, "block": block})
                        seen[block] = ref
                    refs.append(ref)
                for col, x in zip(out, (base + count["rows"], doc_id, hashlib.sha256(raw).hexdigest(), len(refs), refs, fresh)):
                    col.append(x)
                count["rows"] += 1
            yield out
        for block, ref in seen.items():
            recent[block] = ref
            recent.move_to_end(block)
            if len(recent) > RECENT_BLOCKS:
                recent.popitem(last=False)

    return cut


def _numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of df with a long name that equal keys share. df is partitioned by its keys and sorted in each partition."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in keys] + [T.StructField("name", T.LongType())])
    kept = [f.name for f in df.schema.fields if f.name not in keys]

    def run(batches):
        from pyspark import TaskContext

        now, last = (TaskContext.get().partitionId() << 36) - 1, None
        for b in batches:
            names = []
            for key in zip(*(b.column(k).to_pylist() for k in keys)):
                if key != last:
                    now, last = now + 1, key
                names.append(now)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names, pa.int64())], names=[*kept, "name"])

    return staged(df.mapInArrow(run, schema), name)


def _named_pairs(pairs: DataFrame, name: str) -> DataFrame:
    """(uid, pos, a, b) -> (uid, pos, name)."""
    keyed = pairs.select("a", "b").distinct().select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
    names = _numbered(keyed.repartition("x", "y").sortWithinPartitions("x", "y"), ["x", "y"], f"names-{name}")
    level = staged(pairs.join(names, ["a", "b"]).select("uid", "pos", "name"), f"level-{name}")
    unstage(pairs, names)
    return level


def text_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: uid, doc_id, text_sha256, n_blocks, name; (n_blocks, name) is the text's identity."""
    cut = staged(arrow_map(only(docs, doc_id="long", text="string"), _cutter(block_bytes), _CUT), "blocks")
    fresh = cut.select(F.explode("fresh").alias("f")).select("f.ref", "f.block")
    named = _numbered(fresh.repartition("block").sortWithinPartitions("block"), ["block"], "names")
    level = cut.select("uid", "n_blocks", F.posexplode("refs").alias("pos", "ref")).join(named, "ref").select("uid", "n_blocks", "pos", "name")
    level = staged(level, "level0")
    unstage(named)
    levels = [level]
    longest = cut.agg(F.max("n_blocks")).first()[0] or 1
    width, done = 1, [level.where("n_blocks = 1").select("uid", "name")]
    level = level.where("n_blocks > 1").select("uid", "pos", "name")
    while width < longest:
        width *= 2
        pairs = level.groupBy("uid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = staged(pairs, f"pairs{width}")
        level = _named_pairs(pairs, str(width))
        levels.append(level)
        tops = level.groupBy("uid").agg(F.count("*").alias("n"), F.max("name").alias("name"))
        done.append(tops.where("n = 1").select("uid", "name"))
        level = level.join(tops.where("n = 1"), "uid", "left_anti").select("uid", "pos", "name")
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    identity = staged(cut.select("uid", "doc_id", "text_sha256", "n_blocks").join(ended, "uid"), "identity")
    unstage(cut, *levels)
    return identity


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays."""
    ids = text_names(docs, block_bytes)
    groups = ids.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("group_size"))
    groups = staged(groups, "groups")  # apart from the join, so that Spark may split a group with very many rows there
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without exact copies, in its own columns."""
    kept = exact_dedup(docs, block_bytes).where("kept").select(F.col("doc_id").alias("__lattiq_id"), F.col("text_sha256").alias("__lattiq_sha"))
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.withColumn("__lattiq_sha", F.sha2(folded.cast("binary"), 256))
    first = F.row_number().over(_by("doc_id", "__lattiq_sha")).alias("__lattiq_n")
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["__lattiq_id"]) & (rows["__lattiq_sha"] == kept["__lattiq_sha"]), "left_semi").select("*", first).where("__lattiq_n = 1").select(*docs.columns)


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*keys)
