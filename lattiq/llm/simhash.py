"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint's 64 bits are majorities over the XXH64 hashes of all word shingles. Fingerprints at Hamming
distance 3 or less are linked. Two such fingerprints agree on at least two of five bit bands, so every
distinct fingerprint is dealt, once for each of the ten pairs of bands, to the shard of those bands' bits; each
shard holds a BK-tree (children keyed by their distance to the parent) in which only edges within the radius
are followed. This sharding loses no pair. A shard that outgrows SHARD_ROWS is cut into blocks, and each pair
of blocks is searched in a task of its own, so no task holds more than two blocks.

Each shard gives the links of a spanning forest only, never all pairs. Copies share a fingerprint and count
once. Components are found by rounds over distributed tables.

Defined cases: a null text is the empty text, whose fingerprint is zero; fewer words than a shingle make one
shingle; rows that repeat are separate documents; rows without a doc_id link through a shared fingerprint
only, and have no component of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .bktree import BKTree
from .common import arrow_map, components, forest, only, staged, survivors

SHINGLE, RADIUS, SEED = 3, 3, 42
#: The five bands of a 64-bit fingerprint as (lowest bit, bits).
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SHARD_ROWS = 2048
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Fingerprint of text bytes, A-Z folded by the caller."""
    import xxhash

    words = raw.split()  # bytes.split cuts at space and \x09-\x0d
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    count, n = np.zeros(64, np.int64), len(words) - size + 1
    stops = (ends[size - 1 :] - 1).tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * count > n))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) per row of docs."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(b: pa.RecordBatch):
        yield [b.column(0), [_signed(fingerprint((x.as_py() or "").encode().lower(), size)) for x in b.column(1)]]

    return arrow_map(only(docs, doc_id="long", text="string"), run, schema)


def shard_links(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within one shard."""
    tree, a, b = BKTree(), [], []
    for k, v in enumerate(fps.view(np.uint64).tolist()):
        if k:
            for j in tree.within(v, radius):
                a.append(k)
                b.append(j)
        tree.add(v)
        if len(a) > 200_000:  # keep the forest only
            x, y = forest(np.array(a), np.array(b))
            a, b = x.tolist(), y.tolist()
    x, y = forest(np.array(a, np.int64), np.array(b, np.int64))
    return forest(nodes[x], nodes[y])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between nodes of distinct (fp, node): enough of them to connect what is within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("the five bands are exact for a radius of at most 3")
    keys = []
    for t, (i, j) in enumerate(combinations(range(5), 2)):
        (lo_i, n_i), (lo_j, n_j) = BANDS[i], BANDS[j]
        cut_i = F.shiftrightunsigned("fp", lo_i).bitwiseAND(F.lit((1 << n_i) - 1))
        cut_j = F.shiftrightunsigned("fp", lo_j).bitwiseAND(F.lit((1 << n_j) - 1))
        keys.append(F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(cut_i, 13) + cut_j)
    dealt = distinct.select("fp", "node", F.explode(F.array(*keys)).alias("shard"))
    sizes = dealt.groupBy("shard").count().where("count > 1")
    sizes = sizes.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("blocks"))
    rows = dealt.join(sizes, "shard")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.select("fp", "node", "shard", own.alias("own"), "blocks")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rows = rows.select("fp", "node", "shard", F.explode(pair).alias("p")).select("fp", "node", "shard", "p.i", "p.j")

    rows = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp")

    def search(batches):
        rest = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(5)]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            cuts = _cuts(cols[2:])
            rest = [c[cuts[-1] :] for c in cols]  # the last shard may go on in the next batch
            yield from _links(cols, cuts, radius)
        if rest is not None:
            yield from _links(rest, [0, len(rest[0])], radius)

    return rows.mapInArrow(search, "a long, b long")


def _cuts(keys: list[np.ndarray]) -> list[int]:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new).tolist()


def _links(cols: list[np.ndarray], cuts: list[int], radius: int):
    fps, nodes = cols[0], cols[1]
    edges = np.array(cuts)
    size = np.diff(edges)
    two = edges[:-1][size == 2]
    near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius
    a, b = [nodes[two[near]]], [nodes[two[near] + 1]]
    for at, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
        x, y = shard_links(fps[at : at + n], nodes[at : at + n], radius)
        a.append(x)
        b.append(y)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = staged(fingerprints(docs, size), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    comp = components(fingerprint_links(distinct.where("node is not null"), radius), "simhash")
    named = distinct.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shard_rows: int = similar.BAND_ROWS) -> DataFrame:
    """docs with one row of each group of near copies, in its own columns: the smallest doc_id, rows without one last.

    Near copies are texts whose sets of 5-word shingles are 0.8 similar or more: fingerprints within 3 bits, found by
    fingerprint_links, and the rest, which that radius would miss, by BK-trees at a wide one (similar.py); each link is checked.
    """
    return survivors(docs, similar.groups(docs, fingerprint_links, shard_rows))
