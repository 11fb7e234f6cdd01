"""Near-duplicate vectors by spherical k-means and blocked cosine products.

Equal vectors are counted once. Centroids are fitted on a bounded sample; every vector is then assigned to its
nearest centroid's cell, its home, and also dealt to each cell whose centroid is at most MARGIN less similar
than the home's. Within a cell, each home vector is compared with all vectors dealt there by products of
blocks in double precision, so nothing below the threshold is linked.

A link is missed only where neither vector is dealt to the other's home. Two unit vectors of cosine
0.95 differ by a vector of length 0.316, and two centroids by one of length 2 at most, so a margin of
MARGIN_SAFE = 0.64 loses nothing whatever the data. The default loses only pairs whose difference points
nearly straight from one centroid to another; the README has its recall against brute force. A link that is found
counts at both ends: where only one vector's home sees the pair, that cell counts it for the other vector too.

Cells that outgrow BLOCK_ROWS are cut into blocks, each pair of blocks a task of its own: no task holds more
than two blocks. A task gives the number of links of each of its vectors and the links of a spanning forest,
never all pairs; components come from rounds over distributed tables.

Vectors of each length have cells of their own.

Defined cases: vectors that have no vec_id or are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths don't link; rows that repeat are separate vectors that link with each other; rows of one
vec_id are one node of the components; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, components, forest, staged

THRESHOLD, MARGIN, MARGIN_SAFE, BLOCK_ROWS = 0.95, 0.16, 0.64, 4096
#: Sample rows a centroid, rounds of k-means, and the most centroids.
SAMPLE_PER_CELL, ROUNDS, MAX_CELLS = 12, 6, 16_384


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; the first k rows start, empty cells keep their centroid."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 0
        c[full] = sums[full] / norm[full, None]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # vectors travel as they came
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e"))
    size = F.coalesce(F.size("e"), F.lit(0))
    good = (size > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("e", lambda v: v != 0)
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)), F.transform("e", lambda v: v + F.lit(0.0))).alias("e"))
    rows = staged(rows, "vectors")
    distinct = staged(rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "distinct")
    lengths = {r["n"]: r["count"] for r in distinct.groupBy(F.size("e").alias("n")).count().collect()}  # a row a length
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, MAX_CELLS / sum(map(math.isqrt, lengths.values())))
    cells, at = {}, 0  # length -> first cell, centroids (None: a single cell)
    for length, n in sorted(lengths.items()):
        k = int(share * math.isqrt(n))
        centroids = None
        if k > 1:
            chosen = distinct.where(F.size("e") == length).orderBy(F.xxhash64("e"), "node").limit(k * SAMPLE_PER_CELL).select("e").toArrow()
            sample = chosen.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            centroids = spherical_kmeans(_unit(sample), min(k, len(sample)))
        cells[length] = (at, centroids)
        at += 1 if centroids is None else len(centroids)
    held = spark.sparkContext.broadcast(cells)  # at most MAX_CELLS centroids

    dtype = np.float32 if kind == "float" else np.float64
    placed_schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("home", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("v", T.BinaryType())])

    def place(b: pa.RecordBatch):
        sizes = b.column(0).value_lengths().to_numpy()
        for length in np.unique(sizes).tolist():
            first, centroids = held.value[length]
            rows = np.flatnonzero(sizes == length)
            for lo in range(0, len(rows), 500):
                part = b.take(pa.array(rows[lo : lo + 500]))
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(part.num_rows, -1)
                if centroids is None:
                    best, near = np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
                else:
                    s = _unit(x) @ centroids.T
                    best = np.argmax(s, axis=1)
                    near = s >= s[np.arange(len(s)), best][:, None] - margin
                yield [part.column(1), part.column(2), (first + best).astype(np.int32), [(first + np.flatnonzero(r)).astype(np.int32) for r in near], [v.tobytes() for v in x]]

    placed = staged(arrow_map(distinct.select("e", "node", "copies"), place, placed_schema), "placed")
    cells = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    cells = F.broadcast(staged(cells, "cells"))  # a row a cell
    own = F.pmod(F.xxhash64("node", "v"), F.col("blocks")).cast("int").alias("own")
    homes = placed.select("node", "copies", "v", "cells", F.col("home").alias("cell")).join(cells, "cell").select("*", own)
    others = placed.select("node", "copies", "v", F.col("home").alias("from"), F.explode("cells").alias("cell")).join(cells, "cell").select("*", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    none = F.lit(None).cast("array<int>")
    as_home = homes.select("cell", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("home"), "cells", F.lit(-1).alias("from"), "node", "copies", "v")
    as_other = others.select("cell", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(False).alias("home"), none.alias("cells"), "from", "node", "copies", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy(bool)
        nodes, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        raw = np.frombuffer(b"".join(pdf["v"]), dtype).reshape(len(pdf), -1)
        x = _unit(raw)
        hx, hn, hc, ox, on, oc = x[home], nodes[home], copies[home], x[~home], nodes[~home], copies[~home]
        hr, other = raw[home], raw[~home]
        links, a, b = np.zeros(len(hx), np.int64), [], []
        # others whose own home doesn't hold the home vector: this cell alone finds their pair
        origin, away = pdf["from"].to_numpy()[~home], pdf["from"].to_numpy()[~home] != pdf["cell"].iloc[0]
        seen = np.unique(origin[away])
        known = np.array([np.isin(seen, c) for c in pdf["cells"].to_numpy()[home]]).reshape(len(hx), len(seen))
        at_home = np.searchsorted(seen, origin[away])
        back = np.zeros(len(ox), np.int64)
        for at in range(0, len(hx), 256):
            near = hx[at : at + 256] @ ox.T >= threshold
            # a vector does not link with itself; one of the same direction and another length is another vector
            p, q = np.nonzero((hr[at : at + 256, :1] == other[None, :, 0]) & near)
            itself = (hr[at + p] == other[q]).all(axis=1)
            near[p[itself], q[itself]] = False
            links[at : at + 256] = near @ oc
            if len(seen):
                back[away] += hc[at : at + 256] @ (near[:, away] & ~known[at : at + 256][:, at_home])
            p, q = np.nonzero(near)
            f, g = forest(hn[at + p], on[q])
            a.append(f)
            b.append(g)
        n = len(hn) + len(on)
        out = pd.DataFrame({"node": np.concatenate([hn, on]), "n": np.concatenate([links, back]), "other": pd.array([None] * n, "Int64")})
        if a:
            f, g = forest(np.concatenate(a), np.concatenate(b))
            out = pd.concat([out, pd.DataFrame({"node": f, "n": 0, "other": pd.array(g, "Int64")})], ignore_index=True)
        return out[["node", "n", "other"]][(out["n"] > 0) | out["other"].notna()]

    found = staged(as_home.unionByName(as_other).groupBy("cell", "i", "j").applyInPandas(compare, "node long, n long, other long"), "found")
    links = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors")
    groups = distinct.join(links, "node", "left").join(comp, "node", "left").select("e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(groups, "e", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
