"""Links by similarity: SimHash fingerprints and BK-trees at a wide radius, each link checked with the whole texts.

Two texts are near copies if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more. Their
64-bit fingerprints then differ in 10 to 12 bits (RADIUS 28 is five deviations beyond), too many for
shards by bit bands: a shard that shares all but a few bits with both would hold nearly everything. So
shards are dealt by the shingles themselves: 40 bands of 5 minima of permuted shingle hashes (a pair at exactly 0.8
shares no band once in 8 million, a nearer one less often). Each shard holds a BK-tree of its fingerprints, the
tree finds what is within the radius, and every pair found is checked with the whole sets.

Fingerprints that differ in few bits are found by their own bit bands and BK-trees first (simhash.fingerprint_links),
whatever minima their sets share; those links are checked too.

Texts of one set count once. Bands with the same members are searched once. A shard that outgrows BAND_ROWS is cut
into blocks, and each pair of blocks is searched in a task of its own. A search skips pairs that its links already
connect, and gives a spanning forest only.

Defined cases: A-Z are folded; a null text is the empty text, whose set holds the empty shingle; fewer words than a
shingle make one shingle; rows without a doc_id are members like others; rows that repeat are one node; an empty
table gives no groups; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bktree import BKTree
from .common import arrow_map, components, only, staged, text_sha

SHINGLE, SIMILARITY, RADIUS, SEED = 5, 0.8, 28, 42
BANDS, BAND_SIZE = 40, 5
BAND_ROWS = 1024
_draws = np.random.default_rng(SEED)
_MASKS = _draws.integers(0, 1 << 64, BANDS * BAND_SIZE, np.uint64)
_FACTORS = _draws.integers(0, 1 << 64, BANDS * BAND_SIZE, np.uint64) | np.uint64(1)

_KEYS = T.StructType([T.StructField("text_sha", T.StringType()), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of text bytes, A-Z folded by the caller."""
    import xxhash

    words, digest = raw.split(), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band from the minima of the permuted hashes."""
    import xxhash

    low = np.full(len(_MASKS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        mixed = (hashes[at : at + 256, None] ^ _MASKS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, mixed.min(axis=0), out=low)
    rows = low.reshape(BANDS, BAND_SIZE)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, as a signed 64-bit integer."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.ascontiguousarray(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least the given Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    joint = np.concatenate([a, b])
    joint.sort(kind="stable")
    shared = int((joint[1:] == joint[:-1]).sum())
    return shared >= least * (len(joint) - shared)


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _hashed(b: pa.RecordBatch):
    """(key, shingle hashes) of each row of (key, text), texts read one at a time."""
    for key, text in zip(b.column(0), b.column(1)):
        yield key.as_py(), shingles((text.as_py() or "").encode().lower())


def shingle_keys(texts: DataFrame) -> DataFrame:
    """text_sha, node (digest of the set), fp (fingerprint), bands of each row of (text_sha, text)."""

    def run(b: pa.RecordBatch):
        for at in range(0, len(b), 100):
            rows = [(key, _node(h), fingerprint(h), bands(h)) for key, h in _hashed(b.slice(at, 100))]
            yield [list(c) for c in zip(*rows)]

    return arrow_map(texts, run, _KEYS)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, shingles of each row of (node, text)."""

    def run(b: pa.RecordBatch):
        for at in range(0, len(b), 100):
            rows = [(key, h.tobytes()) for key, h in _hashed(b.slice(at, 100))]
            yield [list(c) for c in zip(*rows)]

    return arrow_map(texts, run, _SETS)


def shard_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, radius: int = RADIUS):
    """Links (a, b) of a spanning forest between the left and the right members of a shard; both are the whole shard or
    two blocks of it."""
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(x) for x in sets])
    whole = len(nodes) > 8 and int(sizes.sum()) <= 400_000
    if whole:  # shingles by number; those of one member are marked and counted in all members at once
        cols = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(int(cols.max()) + 1, np.int32)
    tree, held = BKTree(), []
    values = fps.view(np.uint64).tolist()
    one = bool((left & right).all())
    order = range(len(nodes)) if one else [*np.flatnonzero(left).tolist(), *np.flatnonzero(right).tolist()]
    for k in order:
        if one or right[k]:
            mine = find(k)
            near = [j for j in (held[x] for x in tree.within(values[k], radius)) if find(j) != mine and min(sizes[j], sizes[k]) >= SIMILARITY * max(sizes[j], sizes[k])]
            shared = None
            if whole and len(near) > 8:
                own = cols[starts[k] : starts[k] + sizes[k]]
                mark[own] = 1
                shared = np.add.reduceat(mark[cols], starts)
                mark[own] = 0
                near = [j for j in near if shared[j] >= SIMILARITY * (sizes[j] + sizes[k] - shared[j])]
            for j in near:
                if find(k) != find(j) and (shared is not None or similar(sets[j], sets[k])):
                    root[find(k)] = find(j)
                    yield int(nodes[k]), int(nodes[j])
        if one or left[k]:
            tree.add(values[k])
            held.append(k)


def candidates(keys: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """node, fp, band, own, i, j: the members of bands that several nodes of (node, fp, bands) share, by pair of blocks."""
    dealt = keys.select("node", "fp", F.explode("bands").alias("band"))
    mixed = F.xxhash64("node").cast("decimal(20,0)")
    found = dealt.groupBy("band").agg(F.count("*").alias("n"), F.sum(mixed).alias("total"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mix")).where("n > 1")
    once = staged(found.groupBy("n", "total", "mix").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / band_rows).cast("int").alias("blocks")), "bands")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rows = dealt.join(once, "band").select("node", "fp", "band", own.alias("own"), "blocks").select("node", "fp", "band", "own", F.explode(pair).alias("p"))
    return staged(rows.select("node", "fp", "band", "own", "p.i", "p.j"), "members")


def set_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of (node, shingles) that are candidates: enough to connect all similar pairs."""
    rows = members.join(sets, "node").select("node", "fp", "band", "own", "i", "j", "shingles")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def run(batches):
        key, held = None, []

        def links():
            if len(held) < 2:
                return []
            nodes, fps, own = (np.array([h[x] for h in held], np.int64) for x in range(3))
            return list(shard_links(nodes, fps, [np.frombuffer(h[3], np.uint64) for h in held], own == key[1], own == key[2]))

        def rows_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for b in batches:
            out = []
            for node, fp, band, mine, i, j, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (band, i, j) != key:
                    out += links() if key else []
                    key, held = (band, i, j), []
                held.append((node, fp, mine, raw))
            yield rows_of(out)
        if key:
            yield rows_of(links())

    return rows.mapInArrow(run, "a long, b long")


def checked(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) whose sets (node, shingles) are similar."""
    sides = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")

    def run(b: pa.RecordBatch):
        for at in range(0, len(b), 100):
            part = b.slice(at, 100)
            rows = zip(*(part.column(k) for k in range(4)))
            good = [(x.as_py(), y.as_py()) for x, y, left, right in rows if similar(np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64))]
            yield [[x for x, _ in good], [y for _, y in good]]

    return arrow_map(sides.select("a", "b", "left", "right"), run, _LINKS)


def groups(docs: DataFrame, near_links: Callable[[DataFrame], DataFrame], band_rows: int = BAND_ROWS) -> DataFrame:
    """text_sha, component of each different text of docs.

    near_links gives the links (a, b) that fingerprints (fp, node) alone find; they are checked like those of the bands,
    which find what lies further apart.
    """
    texts = only(docs, text="string").select(text_sha().alias("text_sha"), "text")
    keys = staged(shingle_keys(texts), "shingles")
    different = keys.select("node", "fp", "bands").dropDuplicates(["node"])
    first = staged(different.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    shared = different.select("node", "fp").join(first.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    near = staged(near_links(first).unionByName(shared), "near")
    members = candidates(different, band_rows)
    # shingles are made anew for candidates only, from one text a node
    wanted = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    named = keys.groupBy("node").agg(F.min("text_sha").alias("text_sha")).join(wanted, "node")
    named = staged(named.select("node", "text_sha"), "candidates")
    sets = staged(shingle_sets(texts.join(named, "text_sha").select("node", "text")).dropDuplicates(["node"]), "sets")
    comp = components(checked(near, sets).unionByName(set_links(members, sets)), "similar")
    names = keys.select("text_sha", "node").distinct()
    return names.join(comp, "node", "left").select("text_sha", F.coalesce("component", "node").alias("component"))
