"""Hard negatives by dual-tree search: trees over anchors and over candidates, pruned by intervals of inner products.

Rows are dealt to cells around pivots (a tree over a bounded sample gives the pivots; any pivots give the same
result). Cells make groves of candidates and lots of anchors of bounded size; a hot cell is dealt by hash to several.
Inside a grove and a lot, rows are split by label and then along the coordinate that varies most, down to leaves. For
two nodes with centres a and b and radii r and s, every inner product of their rows lies within a.b +- (r|b| + s|a| + rs).

A demand asks for the best k candidates of one anchor with a score between two bounds: its positives (same label, no
bounds), then the negatives of each positive (another label, between the bounds that the positive's score sets). A pair
of nodes is skipped for its whole group of anchors where the interval ends below what every demand in it already has or
starts above what every one may have; pairs of leaves are scored exactly, in integers.

Lots visit groves best first, in rounds of growing size; after each round the k-th best score of each demand prunes the
rounds that follow, whole groves included. A task holds one lot and one grove; a demand's finds are k rows a visit.

Defined cases: rows with a null label, vector or vec_id, or any null or non-finite component take no part; vectors of
different lengths have no inner product and are not compared; empty vectors score 0 with each other; rows that repeat,
and rows of one vec_id, are rows of their own, each an anchor where its vec_id is divisible by the stride; components and
scores beyond 64 bits count as the nearest 64-bit integer; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, only, staged, unstage

#: Rows of a grove, of a lot, of a leaf of candidates and of a leaf of anchors.
GROVE_ROWS, LOT_ROWS, LEAF, ANCHOR_LEAF = 8192, 2048, 256, 32
#: Most cells, and rows of the sample for each; groves of the first round, and how much larger each round is.
MAX_CELLS, SAMPLE_PER_CELL = 4096, 8
FIRST, FACTOR = 2, 8
STRIDE, POSITIVES, NEGATIVES = 100, 5, 10
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1
#: Bounds of products beyond 64 bits end here, since the scores themselves are cut.
FAR = 9.2e18


def split_label(labels: np.ndarray) -> int:
    """Where a sorted run of labels changes, as near to its middle as can be; 0 where it holds one label."""
    changes = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    return int(changes[np.argmin(np.abs(changes - len(labels) // 2))]) if len(changes) else 0


def split_points(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows in the order of the coordinate that varies most, and where to cut them: at its mean, which parts clusters,
    or in the middle where the mean would leave less than a sixteenth on a side."""
    n = len(points)
    if not points.shape[1]:
        return np.arange(n), n // 2
    v = points[:, int(np.argmax(points.var(axis=0)))]
    cut = int((v < v.mean()).sum())
    return np.argsort(v, kind="stable"), cut if n // 16 < cut < n - n // 16 else n // 2


class Tree:
    """A ball tree over rows: order, and for each node its range in it, children, centre, radius and only label."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        order = np.argsort(labels, kind="stable")
        start, end, left, centre, radius, mixed, label = [0], [len(x)], [], [], [], [], []
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            rows = order[a:b]
            points = x[rows]
            c = points.mean(axis=0)
            centre.append(c)
            radius.append(math.sqrt(max(((points - c) ** 2).sum(axis=1).max(), 0.0)))
            mixed.append(bool(labels[rows[0]] != labels[rows[-1]]))
            label.append(labels[rows[0]])
            left.append(-1)
            if b - a > leaf:
                cut = split_label(labels[rows])
                if not cut:
                    sort, cut = split_points(points)
                    order[a:b] = rows[sort]
                left[at] = len(start)
                start += [a, a + cut]
                end += [a + cut, b]
            at += 1
        self.order, self.start, self.end, self.left = order, start, end, left
        self.centre, self.radius = np.array(centre).reshape(len(start), -1), np.array(radius)
        self.mixed, self.label = mixed, label
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of the rows of each pair of nodes, wide enough for rounding."""
    middle = a.centre @ b.centre.T
    reach = np.outer(a.radius, b.norm) + np.outer(a.norm, b.radius) + np.outer(a.radius, b.radius)
    slack = 1 + 1e-9 * np.outer(a.norm + a.radius, b.norm + b.radius)
    return np.minimum(middle - reach - slack, FAR), np.maximum(middle + reach + slack, -FAR)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    top = int(max(abs(int(a.min())), int(a.max()))) * int(max(abs(int(b.min())), int(b.max()))) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST + 1, HIGHEST).astype(np.int64)


class Search:
    """The best k of one grove for the demands of one lot."""

    def __init__(self, lot: dict, demands: dict, same: bool, k: int):
        self.lot, self.same, self.k = lot, same, k
        self.tree = lot["tree"]
        place = np.empty(len(self.tree.order), np.int64)
        place[self.tree.order] = np.arange(len(place))
        who = place[np.searchsorted(lot["rid"], demands["a"])]
        self.by = np.argsort(who, kind="stable")  # demands in the order of the tree's anchors
        self.who = who[self.by]
        self.low, self.high, self.need = (demands[c][self.by] for c in ("low", "high", "need"))
        self.score = np.full((len(who), k), LOWEST, np.int64)
        self.id = np.full((len(who), k), HIGHEST, np.int64)
        self.visited = self.scored = 0

    def run(self, grove: dict) -> None:
        a, b = self.tree, grove["tree"]
        least, most = intervals(a, b)
        first, last = np.searchsorted(self.who, a.start), np.searchsorted(self.who, a.end)
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            p, q = first[i], last[i]
            if p == q or not a.mixed[i] and not b.mixed[j] and (a.label[i] == b.label[j]) != self.same:
                continue
            self.visited += 1
            if most[i, j] < self.need[p:q].min() or least[i, j] > self.high[p:q].max():
                continue
            if a.left[i] < 0 and b.left[j] < 0:
                self.leaves(grove, i, j, p, q)
            elif b.left[j] < 0 or a.left[i] >= 0 and a.end[i] - a.start[i] > (b.end[j] - b.start[j]) * ANCHOR_LEAF // LEAF:
                stack += [(a.left[i], j), (a.left[i] + 1, j)]
            else:  # the child with the higher middle is searched first, so that it prunes the other
                pair = [(i, b.left[j]), (i, b.left[j] + 1)]
                stack += sorted(pair, key=lambda x: most[x] + least[x])

    def leaves(self, grove: dict, i: int, j: int, p: int, q: int) -> None:
        a, b = self.tree, grove["tree"]
        self.scored += 1
        anchors, rows = a.order[a.start[i] : a.end[i]], b.order[b.start[j] : b.end[j]]
        s = products(self.lot["v"][anchors], grove["v"][rows])
        fit = (self.lot["label"][anchors][:, None] == grove["label"][rows][None, :]) == self.same
        if self.same:
            fit &= self.lot["rid"][anchors][:, None] != grove["rid"][rows][None, :]
        at = self.who[p:q] - a.start[i]
        s, fit = s[at], fit[at]
        fit &= (s >= self.need[p:q, None]) & (s <= self.high[p:q, None])
        hit, col = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
        if not len(hit):
            return
        new = np.where(fit[np.ix_(hit, col)], s[np.ix_(hit, col)], LOWEST)
        score = np.concatenate([self.score[p + hit], new], axis=1)
        ids = np.concatenate([self.id[p + hit], np.where(new > LOWEST, grove["id"][rows[col]][None, :], HIGHEST)], axis=1)
        best = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        self.score[p + hit] = np.take_along_axis(score, best, axis=1)
        self.id[p + hit] = np.take_along_axis(ids, best, axis=1)
        self.need[p + hit] = np.maximum(self.need[p + hit], self.score[p + hit, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Demand (its place in the input), score and id of all that was found."""
        row, col = np.nonzero(self.score > LOWEST)
        return self.by[row], self.score[row, col], self.id[row, col]


def _unpack(b: pa.RecordBatch, k: int, prefix: str, leaf: int) -> dict:
    get = lambda c, kind=np.int64: np.frombuffer(b.column(prefix + c)[k].as_py(), kind)
    rid = get("rid")
    v = get("v").reshape(len(rid), b.column(prefix + "dim")[k].as_py())
    out = {"rid": rid, "id": get("id"), "label": get("label"), "v": v}
    return out | {"tree": Tree(v.astype(np.float64), out["label"], leaf)}


_PACK = "dim int, n long, rid binary, id binary, label binary, v binary, centre array<double>, radius double"


def _packer(key: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        dim = int(pdf["dim"].iloc[0])
        x = np.frombuffer(b"".join(pdf["v"]), np.int64).reshape(len(pdf), dim)
        c = x.astype(np.float64).mean(axis=0)
        radius = float(np.sqrt(((x - c) ** 2).sum(axis=1).max()))
        whole = [pdf[k].to_numpy(np.int64).tobytes() for k in ("rid", "vec_id", "label")]
        return pd.DataFrame([[int(pdf[key].iloc[0]), dim, len(pdf), *whole, x.tobytes(), c.tolist(), radius]], columns=[key, "dim", "n", "rid", "id", "label", "v", "centre", "radius"])

    return pack


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Centres of about k parts of the sample, in tree order, so that neighbours in it are near each other."""
    parts, out = [np.arange(len(sample))], []
    while len(parts) < k and any(len(p) > 1 for p in parts):
        halves = []
        for p in parts:
            if len(p) < 2 or not sample.shape[1]:
                halves.append(p)
                continue
            sort, cut = split_points(sample[p])
            halves += [p[sort[:cut]], p[sort[cut:]]]
        if len(halves) == len(parts):
            break
        parts = halves
    for p in parts:
        out.append(sample[p].mean(axis=0))
    return np.array(out).reshape(len(out), -1)


def placed_rows(vectors: DataFrame, stride: int, grove_rows: int) -> tuple[DataFrame, dict]:
    """rid, vec_id, label, anchor, dim, cell, dist, v of the rows that take part, v their integer components, and the
    pivots: length -> first cell, centres."""
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = only(vectors, vec_id="long", label="long", embedding=f"array<{kind}>")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") % 10 + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "*", (F.col("vec_id") % stride == 0).alias("anchor"), F.size("q").alias("dim")), "negative-rows")
    lengths = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row a length
    share = min(1.0, MAX_CELLS * grove_rows / max(1, sum(lengths.values())))
    first, held = 0, {}
    for dim, n in sorted(lengths.items()):
        k = max(1, math.ceil(share * n / grove_rows))
        take = max(1, int(2**31 * min(1.0, SAMPLE_PER_CELL * k / n)))
        some = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rid"), F.lit(2**31)) < take)).orderBy("rid").select("q").toArrow()
        sample = some.column(0).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim) if len(some) and dim else np.zeros((1, dim))
        held[dim] = (first, _pivots(sample, k))
        first += len(held[dim][1])
    pivots = spark.sparkContext.broadcast(held)  # at most MAX_CELLS and one a length

    def place(b: pa.RecordBatch):
        q = b.column(b.schema.get_field_index("q"))
        dims = b.column(b.schema.get_field_index("dim")).to_numpy()
        for dim in np.unique(dims).tolist():
            at, centres = pivots.value[dim]
            rows = pa.array(np.flatnonzero(dims == dim))
            part = b.take(rows)
            x = q.take(rows).flatten().to_numpy().reshape(part.num_rows, dim)
            f = x.astype(np.float64)
            d = (f**2).sum(axis=1)[:, None] - 2 * f @ centres.T + (centres**2).sum(axis=1)[None, :]
            near = np.argmin(d, axis=1)
            away = np.sqrt(((f - centres[near]) ** 2).sum(axis=1)) * (1 + 1e-12)
            yield [*part.columns[:4], part.column(5), (at + near).astype(np.int32), away, [r.tobytes() for r in x]]

    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("rid", "vec_id", "label")], T.StructField("anchor", T.BooleanType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("v", T.BinaryType())])
    out = staged(arrow_map(rows.select("rid", "vec_id", "label", "anchor", "q", "dim"), place, schema), "negative-cells")
    unstage(rows)
    return out, held


def _lots(cells: list, lot_rows: int) -> list[tuple[int, int, int]]:
    """(cell, first lot, lots): cells in tree order share a lot while they fit; larger ones have several of their own."""
    out, lot, room, dim = [], -1, 0, None
    for c in (c for c in cells if c["anchors"]):
        if c["anchors"] > lot_rows:
            n = math.ceil(c["anchors"] / lot_rows)
            out.append((c["cell"], lot + 1, n))
            lot, room = lot + n, 0
            continue
        if c["anchors"] > room or c["dim"] != dim:
            lot, room, dim = lot + 1, lot_rows, c["dim"]
        out.append((c["cell"], lot, 1))
        room -= c["anchors"]
    return out


def _visits(lots: DataFrame, cells: list, pivots: dict, groves_of: list[tuple[int, int, int]]) -> DataFrame:
    """lot, grove, turn, most: each lot with the groves of its vectors' length, best first, and the upper end of their interval."""
    spark = lots.sparkSession
    by_dim, n = {}, {cell: n for cell, _, n in groves_of}
    for c in cells:
        first, centres = pivots[c["dim"]]
        by_dim.setdefault(c["dim"], []).append((c["cell"], centres[c["cell"] - first], c["radius"], n[c["cell"]]))
    held = spark.sparkContext.broadcast({d: tuple(map(np.array, zip(*x, strict=True))) for d, x in by_dim.items()})  # a row a cell

    def visit(b: pa.RecordBatch):
        for lot, dim, centre, radius in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cell, at, reach, groves = held.value[dim]
            c, norm = np.array(centre, np.float64), math.hypot(*centre)
            far = np.sqrt((at**2).sum(axis=1))
            middle = at @ c
            most = middle + radius * far + reach * norm + radius * reach + 1 + 1e-9 * (norm + radius) * (far + reach)
            order = np.argsort(-middle, kind="stable")
            before = np.cumsum(groves[order]) - groves[order]
            yield [[lot] * len(order), cell[order], before, np.maximum(most, -FAR)[order]]

    schema = T.StructType([T.StructField("lot", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("before", T.LongType()), T.StructField("most", T.DoubleType())])
    table = F.broadcast(spark.createDataFrame(groves_of, "cell long, first long, n long"))  # a row a cell
    out = arrow_map(lots.select("lot", "dim", "centre", "radius"), visit, schema).join(table, "cell")
    out = out.select("lot", "most", "before", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    place = F.col("before") + F.col("k")
    turn = F.when(place < FIRST, 0).otherwise(1 + F.floor(F.log(place / FIRST) / math.log(FACTOR))).cast("int")
    return out.select("lot", (F.col("first") + F.col("k")).alias("grove"), turn.alias("turn"), "most")


_DEMANDS = "lot long, a binary, key binary, low binary, high binary, need binary, least long, highest long"
_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "key", "score", "id")])


def _demand_packer(bounds: tuple[int, int] | None):
    """Demands of a lot in one row; bounds: the least and the most score in percent of key, None for no bounds."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy(np.int64)
        if bounds is None:
            low, high = np.full(len(key), LOWEST, np.int64), np.full(len(key), HIGHEST, np.int64)
        else:  # Python's integers don't overflow
            low = np.array([-(-bounds[0] * int(x) // 100) for x in key], np.int64)
            high = np.array([bounds[1] * int(x) // 100 for x in key], np.int64)
        need = np.maximum(low, pdf["kth"].fillna(LOWEST).to_numpy(np.int64))
        row = [int(pdf["lot"].iloc[0]), pdf["a"].to_numpy(np.int64).tobytes(), key.tobytes(), low.tobytes(), high.tobytes(), need.tobytes(), int(need.min()), int(high.max())]
        return pd.DataFrame([row], columns=["lot", "a", "key", "low", "high", "need", "least", "highest"])

    return pack


def _best(found: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("a", "key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def search(demands: DataFrame, lots: DataFrame, groves: DataFrame, visits: DataFrame, same: bool, k: int, bounds: tuple[int, int] | None) -> DataFrame:
    """a, key, score, id, rank: the best k candidates of each demand (lot, a, key), over all turns of the visits."""

    def visit(b: pa.RecordBatch):
        lot, grove, at = None, None, (None, None)
        for i in range(b.num_rows):
            now = (b.column("lot")[i].as_py(), b.column("grove")[i].as_py())
            if now[0] != at[0]:
                lot = _unpack(b, i, "lot_", ANCHOR_LEAF)
            if now[1] != at[1]:
                grove = _unpack(b, i, "grove_", LEAF)
            at = now
            asked = {c: np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("a", "key", "low", "high", "need")}
            work = Search(lot, asked, same, k)
            work.run(grove)
            row, score, ids = work.found()
            yield [asked["a"][row], asked["key"][row], score, ids]

    parts = ("dim", "rid", "id", "label", "v")
    anchors = lots.select("lot", *[F.col(c).alias(f"lot_{c}") for c in parts])
    candidates = groves.select("grove", *[F.col(c).alias(f"grove_{c}") for c in parts])
    best = None
    for turn in sorted(r["turn"] for r in visits.select("turn").distinct().collect()):  # some log of the number of groves
        asked = demands
        if best is not None:
            kth = best.where(F.col("rank") == k).select("a", "key", F.col("score").alias("kth"))
            asked = demands.join(kth, ["a", "key"], "left")
        else:
            asked = demands.withColumn("kth", F.lit(None).cast("long"))
        asked = asked.groupBy("lot").applyInPandas(_demand_packer(bounds), _DEMANDS)
        todo = visits.where(F.col("turn") == turn).join(asked, "lot").where(F.col("most") >= F.col("least"))
        todo = todo.join(anchors, "lot").drop("turn", "most", "least", "highest").join(candidates, "grove").sortWithinPartitions("grove", "lot")
        found = staged(arrow_map(todo, visit, _FOUND), "negatives-found")
        every = found if best is None else best.select("a", "key", "score", "id").unionByName(found)
        last, best = best, staged(_best(every, k), "negatives-best")
        unstage(found, *([last] if last is not None else []))
    return best


def hard_negatives(vectors: DataFrame, stride: int = STRIDE, positives: int = POSITIVES, negatives: int = NEGATIVES, bounds: tuple[int, int] = (30, 90), grove_rows: int = GROVE_ROWS, lot_rows: int = LOT_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by stride. bounds: least and most score of a negative in percent of
    its positive's.
    """
    spark = vectors.sparkSession
    rows, pivots = placed_rows(vectors, stride, grove_rows)
    stats = rows.groupBy("cell", "dim").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max("dist").alias("radius"))
    cells = sorted((r.asDict() for r in stats.collect()), key=lambda c: c["cell"])  # at most MAX_CELLS and one a length
    lots_of = _lots(cells, lot_rows)
    if not lots_of:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    groves_of, at = [], 0
    for c in cells:
        groves_of.append((c["cell"], at, math.ceil(c["n"] / grove_rows)))
        at += groves_of[-1][2]

    def dealt(df: DataFrame, table: list, key: str) -> DataFrame:
        t = F.broadcast(spark.createDataFrame(table, "cell int, first long, n long"))  # a row a cell
        return df.join(t, "cell").withColumn(key, F.col("first") + F.pmod(F.xxhash64("rid"), F.col("n")))

    groves = staged(dealt(rows, groves_of, "grove").groupBy("grove").applyInPandas(_packer("grove"), f"grove long, {_PACK}"), "groves")
    anchors = staged(dealt(rows.where("anchor"), lots_of, "lot").select("lot", "rid", "vec_id", "label", "dim", "v"), "anchors")
    lots = staged(anchors.groupBy("lot").applyInPandas(_packer("lot"), f"lot long, {_PACK}"), "lots")
    visits = staged(_visits(lots, cells, pivots, groves_of), "visits")
    own = anchors.select("lot", F.col("rid").alias("a"))
    near = search(own.withColumn("key", F.lit(0).cast("long")), lots, groves, visits, True, positives, None).select("a", F.col("score").alias("key"), F.col("id").alias("positive_id"))
    asked = near.select("a", "key").where("key >= 0").distinct().join(own, "a")  # below 0 the bounds exclude each other
    hard = search(staged(asked, "negatives-asked"), lots, groves, visits, False, negatives, bounds)
    out = near.join(hard, ["a", "key"]).join(anchors.select(F.col("rid").alias("a"), F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("key").alias("positive_score"), F.col("score").alias("negative_score"))
