"""Nearest neighbours between two tables in feature space, exact, through cells around pivots of the reference.

The space (scaling, and principal components where asked for) is fitted on the reference and applied to both sides. The
index deals reference rows to the cell of their nearest pivot and knows each cell's size and radius; cells near one another
make up a grove, the unit that is sent to tasks. A query first visits the grove of its nearest cell; the k-th distance t
found there is a bound, and by the triangle inequality only cells whose pivot lies within t + radius can hold anything
nearer, so only groves with such a cell are visited later. In a task, a block of queries meets only those cells, and in a
cell only rows whose distance from the pivot differs by at most t from a query's. Single-precision products of blocks
choose candidates with a margin for their rounding, plain differences in double precision rank them.

No task holds more than UNIT_ROWS rows of each side: larger cells are cut by hash, and so are the queries of a grove. Where
the bounds prune nothing, a row is sent once for each grove or lot of the other side, and each pair costs a product and a
comparison. Of equal reference vectors only the k with the smallest ids can be among a query's k nearest, so copies are
left out of the index beyond that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .annotate import vote

#: Most pivots, sample rows for each, rounds of fitting them; rows of a side of a task.
MAX_CELLS, SAMPLE_PER_CELL, ROUNDS, UNIT_ROWS = 1024, 8, 4, 32768
#: Queries and reference rows of a product of blocks; candidates whose differences are taken at once.
BLOCK, TILE, CANDIDATES = 256, 4096, 1 << 16


def fit_space(reference: DataFrame, components: int = 0) -> PipelineModel:
    """Standard scaling (and the first principal components, if any are asked for) of column v, fitted on the reference."""
    stages = [StandardScaler(withMean=True, inputCol="_v", outputCol="_s")]
    if components:
        stages.append(PCA(k=components, inputCol="_s", outputCol="_p"))
    return Pipeline(stages=stages).fit(reference.select(array_to_vector("v").alias("_v")))


def in_space(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with column v in the fitted space."""
    last = "_p" if len(model.stages) > 1 else "_s"
    out = model.transform(df.withColumn("_v", array_to_vector("v"))).withColumn("v", vector_to_array(last))
    return out.select(*df.columns)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means centres of a bounded sample; empty cells keep their centre."""
    c = sample[:k].copy()
    for _ in range(ROUNDS):
        near = np.argmin(_distances(sample, c), axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _groves(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The grove of each cell: cells are parted where their pivots vary most until a grove holds at most so many rows."""
    grove, todo, n = np.zeros(len(pivots), np.int32), [np.arange(len(pivots))], 0
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or sizes[cells].sum() <= most:
            grove[cells] = n
            n += 1
            continue
        cells = cells[np.argsort(pivots[cells, np.argmax(pivots[cells].var(axis=0))], kind="stable")]
        before = np.cumsum(sizes[cells])
        half = min(max(1, int(np.searchsorted(before, before[-1] / 2)) + 1), len(cells) - 1)
        todo += [cells[half:], cells[:half]]
    return grove


@dataclass
class Index:
    """rows: j, v, cell, dist; and of each cell: its pivot, its rows, its radius and its grove (at most MAX_CELLS cells)."""

    rows: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    k: int
    grove: np.ndarray


def build(reference: DataFrame, k: int, cells: int | None = None) -> Index:
    """An index over reference (j, v ARRAY<DOUBLE>) for searches of up to k neighbours; null vectors are left out."""
    rows = reference.where("v is not null").select("j", "v")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("j"))  # k + 1 rows a vector pass a task (a window group limit)
    rows = cut(rows.withColumn("_n", copy).where(F.col("_n") <= k).select("j", "v"), "reference")
    n = rows.count()
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(n) // 2))
    share = min(1.0, cells * SAMPLE_PER_CELL / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64("j", "v"), F.lit(2**31)) < int(share * 2**31)).orderBy(F.xxhash64("v", "j")).select("v").toPandas()
    if chosen.empty:
        chosen = rows.limit(1).select("v").toPandas()
    if chosen.empty:
        return Index(rows.withColumn("cell", F.lit(0)).withColumn("dist", F.lit(0.0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), k, np.zeros(0, np.int32))
    pivots = _pivots(np.stack(chosen["v"]).astype(float), min(cells, len(chosen)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"]).astype(float)
                near = np.argmin(_distances(x, pivots), axis=1)
                yield b.assign(cell=near.astype(np.int32), dist=np.sqrt(((x - pivots[near]) ** 2).sum(1)))

    placed = cut(rows.mapInPandas(place, f"j {dict(rows.dtypes)['j']}, v array<double>, cell int, dist double"), "cells")
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect():  # a row a cell
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return Index(placed, pivots, sizes, radius, k, _groves(pivots, sizes, min(UNIT_ROWS, max(1024, n // 8))))


def _visits(queries: DataFrame, index: Index, later: bool) -> DataFrame:
    """i, v, t, home, grove: the groves that a query visits: first its home, the nearest cell's, later the others with a cell within its bound t."""
    pivots, sizes, radius, grove = index.pivots, index.sizes, index.radius, index.grove
    cells = [np.flatnonzero((grove == g) & (sizes > 0)) for g in range(int(grove.max()) + 1)]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):  # a query may visit every grove
                b = whole.iloc[at : at + 1024]
                d = _distances(np.stack(b["v"]).astype(float), pivots)
                # a home known from the first visit stays: products may round to another nearest cell
                home = b["home"].to_numpy() if "home" in b else grove[np.argmin(np.where(sizes > 0, d, np.inf), axis=1)]
                b = b.assign(home=home)
                if not later:
                    yield b.assign(grove=home)
                    continue
                slack = 1e-6 * (1 + np.abs(d) + radius[None])  # products round; a grove too many costs time alone
                near = d - radius[None] <= b["t"].to_numpy()[:, None] + slack
                hit = np.stack([near[:, c].any(axis=1) for c in cells], axis=1)
                hit[np.arange(len(b)), home] = False
                p, q = np.nonzero(hit)
                yield b.iloc[p].assign(grove=q.astype(np.int32))

    return queries.mapInPandas(visit, f"i {dict(queries.dtypes)['i']}, v array<double>, t double, home int, grove int")


def _ordered(p: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by p and by, and each one's rank within its p from 0."""
    order = np.lexsort((*by[::-1], p))
    p = p[order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
    return order, np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))


class _Rows:
    """Reference rows of a task, by cell and distance from its pivot, and products of blocks with them."""

    def __init__(self, b: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray) -> None:
        b = b.sort_values(["cell", "dist"])
        self.j, self.y, self.dist = b["j"].to_numpy(), np.stack(b["v"]).astype(float), b["dist"].to_numpy()
        cells, self.starts = np.unique(b["cell"].to_numpy(), return_index=True)
        self.stops = np.append(self.starts[1:], len(b))
        self.pivots, self.radius = pivots[cells], radius[cells]
        self.centre = self.pivots.mean(axis=0)  # products round less near it
        y = self.y - self.centre
        yy = (y**2).sum(1)
        self.most = float(np.sqrt(np.fmax.reduce(yy)))
        self.kind = np.float32 if self.most < 1e15 else np.float64
        self.right = np.ascontiguousarray(np.column_stack([y, yy]).astype(self.kind).T)

    def block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The left side of a block's products, which give squared distances less the block's squares; those squares; and twice the products' rounding."""
        x = x - self.centre
        xx = (x**2).sum(1)
        kind = self.kind if not len(xx) or xx.max() < 1e30 else np.float64
        eps = 4 * (x.shape[1] + 8) * np.finfo(kind).eps
        return np.column_stack([-2 * x, np.ones(len(x))]).astype(kind), xx, eps * (np.sqrt(xx) + self.most + 1e-30) ** 2

    def bound(self, x: np.ndarray, c: int, k: int) -> np.ndarray:
        """A distance within which k rows lie, by the rows of one cell (and its neighbours in order where it holds fewer)."""
        low, high = int(self.starts[c]), int(self.stops[c])
        if high - low < k:
            low, high = max(0, low - k), min(len(self.j), high + k)
        if high - low < k:
            return np.full(len(x), np.inf)
        out = np.full(len(x), np.inf)
        high = min(high, max(low + k, low + TILE))
        for at in range(0, len(x), BLOCK):
            left, xx, slack = self.block(x[at : at + BLOCK])
            s = np.partition(left @ self.right[:, low:high], k - 1, axis=1)[:, k - 1]
            out[at : at + BLOCK] = np.sqrt(np.maximum(s + xx + slack, 0))
        return out

    def ranges(self, x: np.ndarray, t: np.ndarray) -> list[list[int]]:
        """Ranges of rows that a block of queries with bounds t has to meet."""
        out: list[list[int]] = []
        d = _distances(x, self.pivots)
        slack = 1e-6 * (1 + d + self.radius[None])
        need = d - self.radius[None] <= t[:, None] + slack
        for c in np.flatnonzero(need.any(axis=0)).tolist():
            some, begin, end = need[:, c], int(self.starts[c]), int(self.stops[c])
            reach = t[some] + slack[some, c]
            low = begin + int(np.searchsorted(self.dist[begin:end], (d[some, c] - reach).min()))
            high = begin + int(np.searchsorted(self.dist[begin:end], (d[some, c] + reach).max(), side="right"))
            if out and low - out[-1][1] <= 64:
                out[-1][1] = max(out[-1][1], high)
            elif low < high:
                out.append([low, high])
        return out

    def nearest(self, x: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the block, j and d of the k best within t of each query of a block.

        The products' k-th best so far narrows the bounds from tile to tile; differences are taken of what is left.
        """
        left, xx, slack = self.block(x)
        most = t**2 - xx + slack
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, left.dtype))

        def narrowed(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
            order, rank = _ordered(p, s)
            last = order[rank == k - 1]
            most[p[last]] = np.minimum(most[p[last]], s[last] + slack[p[last]])
            keep = s <= most[p]
            return p[keep], q[keep], s[keep]

        for low, high in self.ranges(x, t):
            for at in range(low, high, TILE):
                s = left @ self.right[:, at : min(at + TILE, high)]
                hit = np.flatnonzero((s <= np.nextafter(most.astype(s.dtype), np.inf, dtype=s.dtype)[:, None]).ravel())
                if len(hit):
                    p, q = np.divmod(hit, s.shape[1])
                    found = tuple(np.concatenate(c) for c in zip(found, (p, at + q, s.ravel()[hit])))
                    if len(found[0]) > 2 * k * len(x):
                        found = narrowed(*found)
        p, q, _ = narrowed(*found)
        d = np.zeros(len(p))
        for at in range(0, len(p), CANDIDATES):
            part = slice(at, at + CANDIDATES)
            d[part] = np.sqrt(((x[p[part]] - self.y[q[part]]) ** 2).sum(1))
        order, rank = _ordered(p, d, self.j[q])
        best = order[rank < k]
        return p[best], self.j[q[best]], d[best]


def _searched(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """i, j, d: the k best of each visited unit within the query's bound."""
    pivots, radius, grove = index.pivots, index.radius, index.grove
    held = np.bincount(grove, index.sizes).astype(np.int64)
    asked = {r["grove"]: r["n"] for r in visits.groupBy("grove").agg(F.count("*").alias("n")).collect()}  # a row a grove
    spark = visits.sparkSession
    table = [(g, max(1, -(-int(held[g]) // UNIT_ROWS)), -(-n // UNIT_ROWS)) for g, n in asked.items()]
    units = F.broadcast(spark.createDataFrame(table, "grove int, subs int, lots int"))  # a row a grove
    home = F.broadcast(spark.createDataFrame(list(enumerate(grove.tolist())), "cell int, grove int"))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = visits.join(units, "grove").select("grove", every("subs").alias("sub"), mine("i", "lots").alias("lot"), "i", "v", "t")
    right = index.rows.join(home, "cell").join(units, "grove").select("grove", mine("j", "subs").alias("sub"), every("lots").alias("lot"), "j", "v", "cell", "dist")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            rows = _Rows(b, pivots, radius)
            i, x, t = a["i"].to_numpy(), np.stack(a["v"]).astype(float), a["t"].to_numpy().copy()
            near = np.argmin(_distances(x, rows.pivots), axis=1)
            order = np.argsort(near, kind="stable")
            i, x, t, near = i[order], x[order], t[order], near[order]
            for c in np.unique(near[np.isinf(t)]).tolist():
                some = (near == c) & np.isinf(t)
                t[some] = rows.bound(x[some], c, k)
            for at in range(0, len(i), BLOCK):
                part = slice(at, at + BLOCK)
                p, j, d = rows.nearest(x[part], t[part], k)
                out.append(pd.DataFrame({"i": i[part][p], "j": j, "d": d}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "d": []})

    kinds = f"i {dict(visits.dtypes)['i']}, j {dict(index.rows.dtypes)['j']}, d double"
    keys = ("grove", "sub", "lot")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, index: Index, k: int | None = None) -> DataFrame:
    """i, j, d, rank: the k nearest reference rows of each row of queries (i, v), by (distance, j); fewer where there are fewer."""
    k = k or index.k
    if k > index.k:
        raise ValueError(f"the index was built for {index.k} neighbours")
    q = queries.where("v is not null").select("i", "v")
    empty = q.sparkSession.createDataFrame([], f"i {dict(q.dtypes)['i']}, j {dict(index.rows.dtypes)['j']}, d double, rank int")
    if not len(index.pivots):
        return empty
    first = cut(_visits(q.withColumn("t", F.lit(float("inf"))), index, False), "visits")
    if first.isEmpty():
        return empty
    found = cut(_ranked(_searched(first, index, k), k), "first")
    bound = found.where(F.col("rank") == k).select("i", F.col("d").alias("t"))
    rest = first.select("i", "v", "home").join(bound, "i", "left").select("i", "v", F.coalesce("t", F.lit(float("inf"))).alias("t"), "home")
    more = cut(_visits(rest, index, True), "visits")
    if more.isEmpty():
        return found
    return _ranked(found.select("i", "j", "d").unionByName(_searched(more, index, k)), k)


def transfer_labels(queries: DataFrame, reference: DataFrame, k: int = 15, components: int = 0) -> DataFrame:
    """i, label, share, nearest: the majority label of each query's k nearest reference rows in the reference's space.

    queries has i, v; reference has j, v, label. nearest: the distance of the nearest one.
    """
    model = fit_space(reference, components)
    near = cut(nearest(in_space(model, queries.select("i", "v")), build(in_space(model, reference.select("j", "v")), k)), "neighbours")
    voted = vote(near.select("i", "j"), reference.select("j", "label"))
    return voted.join(near.where("rank = 1").select("i", F.col("d").alias("nearest")), "i")
