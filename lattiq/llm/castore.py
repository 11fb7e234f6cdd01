"""Content-addressed store of token ids.

A document's id stream is cut into chunks where a rolling hash of the last WINDOW ids meets a pattern, so
equal passages give equal chunks wherever they stand. The store has three Parquet tables in one folder:

chunks    digest (SHA-256 of data), width (bytes an id, the least of 2 and 4 that holds them), data; each distinct chunk once, bucketed by digest
recipes   doc_id, start, n_tokens, digests in order, root (Merkle root of the digests); in ascending doc_id order
manifest  one row a segment of SEGMENT_IDS ids: its documents, ids and the Merkle root of their roots

Reading joins recipes with chunks, checks every chunk against its digest, every recipe against its Merkle
root and every length, and fails on the first difference.

Defined cases: a null text is the empty text, whose stream is the end id alone; rows that repeat are stored as
separate recipes of the same chunks; an empty table gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, column_batches, drop_path, fresh_path, only, parts, running_total, staged
from .tokens import encoder, tokenizer_path

END_ID = 2
#: Chunk lengths in ids: shortest, mean beyond it (a power of two), longest; ids that the rolling hash sees.
MIN_IDS, MEAN_IDS, MAX_IDS, WINDOW = 128, 512, 4096, 16


def marks(ids: np.ndarray) -> np.ndarray:
    """Places (ends, so 1 and up) where the rolling hash of the WINDOW ids before it meets the pattern."""
    n = len(ids)
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        span = 1
        while span < min(WINDOW, n):  # the hash of the last 2 * span ids from two hashes of span ids
            h[span:] += h[:-span] << np.uint64(span)
            span *= 2
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN_IDS) == 0) + 1


def boundaries(n: int, hits: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids with marks at hits. No chunk but the last is shorter than MIN_IDS, which
    is more than WINDOW, so what stands before a stream has no part in its chunks."""
    ends, last = [], 0
    for e in hits:
        while e - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if e - last >= MIN_IDS and e < n:
            ends.append(e)
            last = e
    while n - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    ends.append(n)
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0]


_CHUNKED = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("digests", T.ArrayType(T.BinaryType())),
    T.StructField("root", T.BinaryType()),
    T.StructField("fresh", T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())]))),
])


#: Digests that a task remembers at least, of those met last: a chunk met again among them isn't sent again.
MEMORY = 1 << 16


class _Met:
    """Digests met last, in two generations, so that frequent ones stay and memory is bounded."""

    def __init__(self) -> None:
        self.now: set[bytes] = set()
        self.before: set[bytes] = set()

    def add(self, digest: bytes) -> bool:
        """Whether the digest isn't among those met last."""
        if digest in self.now:
            return False
        if len(self.now) >= MEMORY:
            self.before, self.now = self.now, set()
        self.now.add(digest)
        return digest not in self.before


def _chunker(path: str, end_id: int):
    count = {"rows": 0}
    met = _Met()

    def run(b: pa.RecordBatch):
        from pyspark import TaskContext

        enc, base = encoder(path), TaskContext.get().partitionId() << 36
        doc_ids, texts = b.column(0).to_pylist(), b.column(1)
        for lo, hi in column_batches(texts, 4_000_000):
            out: list[list] = [[] for _ in _CHUNKED.fields]
            flat, cuts = enc.encode(texts.slice(lo, hi - lo), end_id)
            flat = flat.astype("<u4", copy=False)
            hits = marks(flat)
            spans = np.searchsorted(hits, cuts, side="right").tolist()
            wide, raw, all_hits, cuts = bool((flat >= 65536).any()), memoryview(flat).cast("B"), hits.tolist(), cuts.tolist()
            narrow = flat if wide else memoryview(flat.astype("<u2")).cast("B")
            for k, doc_id in enumerate(doc_ids[lo:hi]):
                first, n = cuts[k], cuts[k + 1] - cuts[k]
                digests, fresh, at = [], [], first
                for e in boundaries(n, [h - first for h in all_hits[spans[k] : spans[k + 1]]]):
                    e += first
                    width = 4 if wide and int(flat[at:e].max()) >= 65536 else 2
                    data = raw[4 * at : 4 * e] if width == 4 else flat[at:e].astype("<u2").data.cast("B") if wide else narrow[2 * at : 2 * e]
                    digest = hashlib.sha256(data).digest()
                    if met.add(digest):
                        fresh.append((digest, width, bytes(data)))
                    digests.append(digest)
                    at = e
                for col, x in zip(out, (base + count["rows"], doc_id, n, digests, merkle_root(digests), fresh)):
                    col.append(x)
                count["rows"] += 1
            out[-1] = _fresh_column(out[-1])
            yield out

    return run


#: Places of a chunk that one task joins at most.
HOT_ROWS = 4096
#: Ids a manifest segment spans. A document has one id at least, so a segment's documents are bounded too.
SEGMENT_IDS = 1 << 21


def _segments(recipes: DataFrame) -> DataFrame:
    """segment, documents, n_tokens and the Merkle root of the documents' roots in order."""

    def seal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "documents": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "root": [merkle_root([bytes(r) for r in pdf["root"]])]})

    rows = recipes.select(F.floor(F.col("start") / SEGMENT_IDS).cast("long").alias("segment"), "start", "n_tokens", "root")
    return rows.groupBy("segment").applyInPandas(seal, "segment long, documents long, n_tokens long, root binary")


def _fresh_column(rows: list[list[tuple]]) -> pa.Array:
    flat = [x for row in rows for x in row]
    kinds = (pa.binary(), pa.int32(), pa.binary())
    items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)], ["digest", "width", "data"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), items)


class Store:
    """A written store: its folder and tables."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "lattiq_chunks_" + path.rsplit("-", 1)[-1]

    def chunks(self) -> DataFrame:
        return self.spark.table(self.table)

    def recipes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def verify(self) -> int:
        """Hold the recipes against the manifest; gives the number of segments, raises on any difference."""
        now = _segments(self.recipes())
        sealed = self.manifest()
        if not now.exceptAll(sealed).isEmpty() or not sealed.exceptAll(now).isEmpty():
            raise ValueError("the recipes differ from the manifest")
        return sealed.count()


def write_store(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> Store:
    """Encode docs (doc_id, text) and write a store to the shared folder."""
    spark = docs.sparkSession
    store = Store(spark, fresh_path(spark, "store"), parts(spark))
    raw = f"{store.path}/incoming"
    arrow_map(only(docs, doc_id="long", text="string"), _chunker(path or tokenizer_path(), end_id), _CHUNKED).write.option("compression", "zstd").parquet(raw)
    incoming = spark.read.schema(_CHUNKED).parquet(raw)
    rows = running_total(incoming.select("uid", "doc_id", "n_tokens", "digests", "root"), ["doc_id", "root", "uid"], "n_tokens", "start", "recipes")
    rows.sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{store.path}/recipes")
    fresh = incoming.select(F.explode("fresh").alias("f")).select("f.digest", "f.width", "f.data")
    # dealt first: tasks have hardly any repeats left, so aggregating before the shuffle would only sort
    writer = fresh.repartition(store.buckets, "digest").dropDuplicates(["digest"]).write.option("compression", "zstd").option("path", f"{store.path}/chunks")
    writer.bucketBy(store.buckets, "digest").sortBy("digest").saveAsTable(store.table)
    _segments(store.recipes()).write.option("compression", "zstd").parquet(f"{store.path}/manifest")
    drop_path(spark, raw)
    return store


def _with_chunks(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """places joined with their chunks. A chunk that stands in more than HOT_ROWS places is dealt out with salts."""
    hot = places.groupBy("digest").count().where(F.col("count") > HOT_ROWS)
    hot = staged(hot.select("digest", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("salts")), "hot")
    if hot.isEmpty():
        return places.join(chunks, "digest")
    cold = places.join(hot, "digest", "left_anti").join(chunks, "digest")
    own = places.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("uid", "pos"), F.col("salts")).cast("int")).drop("salts")
    spread = chunks.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return cold.unionByName(own.join(spread, ["digest", "salt"]).select(*cold.columns))


def read_store(store: Store, with_ids: bool = False) -> DataFrame:
    """Documents rebuilt from the files: doc_id, start, n_tokens, n_chunks, ids_crc32[, ids]. Raises on any difference."""
    places = store.recipes().select("uid", "doc_id", "start", "n_tokens", "root", F.size("digests").alias("n_chunks"), F.posexplode("digests").alias("pos", "digest"))
    rows = _with_chunks(places, store.chunks()).repartition(store.buckets, "uid").sortWithinPartitions("uid", "pos")
    rows = rows.select("uid", "doc_id", "start", "n_tokens", "root", "n_chunks", "digest", "width", "data")
    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "n_chunks", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def rebuild(batches):
        whole: list[bytes] = []
        digests: list[bytes] = []
        last: tuple | None = None

        def close():
            _, doc_id, start, n, root, n_chunks = last
            ids = b"".join(whole)
            if len(digests) != n_chunks or merkle_root(digests) != root or len(ids) != 4 * n:
                raise ValueError(f"document {doc_id}: the stored chunks don't rebuild it")
            return (doc_id, start, n, n_chunks, zlib.crc32(ids), ids)

        for b in batches:
            out = []
            uids = b.column(0).to_numpy()
            begins = np.flatnonzero(np.append(True, uids[1:] != uids[:-1])).tolist() if len(uids) else []
            digest, width, data = (b.column(k).to_pylist() for k in (6, 7, 8))
            for first, stop in zip(begins, [*begins[1:], len(uids)]):
                head = tuple(b.column(k)[first].as_py() for k in range(6))
                if last is not None and head[0] != last[0]:
                    out.append(close())
                    whole, digests = [], []
                last = head
                for k in range(first, stop):
                    if hashlib.sha256(data[k]).digest() != digest[k]:
                        raise ValueError("a chunk differs from its digest")
                    whole.append(np.frombuffer(data[k], "<u2").astype("<u4").tobytes() if width[k] == 2 else data[k])
                digests += digest[first:stop]
            yield _batch(out, fields)
        if last is not None:
            yield _batch([close()], fields)

    return rows.mapInArrow(rebuild, T.StructType(fields))


def _batch(rows: list[tuple], fields: list[T.StructField]) -> pa.RecordBatch:
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in fields]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.name for f in fields])
