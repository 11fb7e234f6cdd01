"""Graphs as edge tables (i, j, w), both directions stored: building, labels, hops, walks, coarse-graining.

Nearest neighbours and radius joins go through a grid of cells, never through a cross join. Operators that
iterate write each round to the shared folder, so lineage stays short and lost executors cost a re-read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_counted
from .order_stats import quantiles

#: Points a grid cell is meant to hold when the grid is sized from the data, and the most that the fullest may hold at first, both for each neighbour sought.
CELL_POINTS, CELL_MOST = 2, 4


def _celled(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))


def _around(points: DataFrame, cell: float) -> DataFrame:
    """Each point once for each of the nine cells around it."""
    off = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = _celled(points, cell).withColumn("o", F.explode(off))
    return near.select(*points.columns, (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), F.col("cx").alias("hx"), F.col("cy").alias("hy"))


def knn(spots: DataFrame, k: int = 6, id_col: str = "spot") -> DataFrame:
    """i, j, d, rank: the k nearest other spots of each spot by (distance, id), exact.

    Candidates come from the nine cells around a spot. A spot is settled when its k-th distance stays inside
    those cells; the others are tried again with cells twice as wide. The first cells are as narrow as the densest place
    asks for, so a spot meets some 9 * CELL_MOST * k others at most where it settles and few where it does not, however
    many spots there are; of spots at one place only the k + 1 with the smallest ids are candidates (no other can be among
    the k nearest of any spot), so clusters and copies make no square of pairs. spots has id, x, y.
    """
    pts = cut(spots.select(F.col(id_col).alias("i"), "x", "y"), "points")
    s = pts.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    schema = "i long, j long, d double, rank int"
    if not s["n"] or s["n"] < 2:
        return spots.sparkSession.createDataFrame([], schema)
    span = max(s["x1"] - s["x0"], s["y1"] - s["y0"], 1e-12)
    cell = span * math.sqrt(CELL_POINTS * k / s["n"])
    # Spark keeps k + 1 rows a place before the exchange too (a window group limit)
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("i"))
    near = cut(pts.withColumn("_n", place).where(F.col("_n") <= k + 1).drop("_n"), "near")
    while (top := _celled(near, cell).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]) > CELL_MOST * k and cell > span * 2.0**-24:
        cell /= max(2.0, math.sqrt(top / (CELL_MOST * k)))
    by = Window.partitionBy("i")
    pending, done = pts, None
    while True:
        whole = cell >= span  # nine cells then hold every point
        right = _celled(near, cell).select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy")
        pairs = _around(pending, cell).join(right, ["cx", "cy"]).where("i <> j")
        pairs = pairs.withColumn("d", F.sqrt((F.col("x") - F.col("xj")) ** 2 + (F.col("y") - F.col("yj")) ** 2))
        reach = F.least(F.col("x") - (F.col("hx") - 1) * cell, (F.col("hx") + 2) * cell - F.col("x"), F.col("y") - (F.col("hy") - 1) * cell, (F.col("hy") + 2) * cell - F.col("y"))
        ranked = pairs.select("i", "j", "d", reach.alias("reach"), F.row_number().over(by.orderBy("d", "j")).alias("rank")).where(F.col("rank") <= k)
        if whole:
            out = ranked.select("i", "j", "d", "rank")
            return out if done is None else done.unionByName(out)
        # a spot on the far edge of the cells lies outside them and may tie, so the k-th distance must be less
        held = ranked.select("i", "j", "d", "rank", "reach", F.count("*").over(by).alias("n"), F.max("d").over(by).alias("far"))
        settled = cut(held.where((F.col("n") == k) & (F.col("far") < F.col("reach") - 1e-9 * cell)).select("i", "j", "d", "rank"), "knn")
        done = settled if done is None else done.unionByName(settled)
        pending, left = cut_counted(pending.join(settled.where("rank = 1").select("i"), "i", "left_anti"), "pending")
        if not left:
            return done
        cell *= 2


def within_radius(left: DataFrame, right: DataFrame, radius: float, id_col: str = "spot") -> DataFrame:
    """i, j, d of all pairs at distance radius or nearer, a spot with itself included."""
    a = _around(left.select(F.col(id_col).alias("i"), "x", "y"), radius)
    b = _celled(right.select(F.col(id_col).alias("j"), F.col("x").alias("x"), F.col("y").alias("y")), radius).select("j", F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy")
    d = F.sqrt((F.col("x") - F.col("xj")) ** 2 + (F.col("y") - F.col("yj")) ** 2)
    return a.join(b, ["cx", "cy"]).select("i", "j", d.alias("d")).where(F.col("d") <= radius)


def gaussian_graph(neighbours: DataFrame, sigma: float | None = None) -> DataFrame:
    """Edges i, j, w with w = exp(-d^2 / 2 sigma^2), the larger of both directions. sigma: by default the median distance."""
    n = neighbours
    if sigma is None:
        n = cut(n.select("i", "j", "d"), "neighbours")
        sigma = quantiles(n, "d", [0.5])[0] or float("nan")
    w = n.select("i", "j", F.exp(-F.col("d") * F.col("d") / (2 * F.lit(float(sigma)) * F.lit(float(sigma)))).alias("w"))
    return w.unionByName(w.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))


def symmetric_mean(edges: DataFrame) -> DataFrame:
    """(A + A^T) / 2."""
    both = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("deg"), F.count("*").alias("n"))


def boundary_nodes(edges: DataFrame, quantile: float = 0.1) -> DataFrame:
    """i, deg, is_boundary: degree at most the quantile of all degrees."""
    d = cut(degrees(edges), "degrees")
    q = quantiles(d, "deg", [quantile])[0]
    return d.select("i", "deg", (F.col("deg") <= F.lit(q)).alias("is_boundary"))


def row_stochastic(edges: DataFrame) -> DataFrame:
    """Rows divided by their sums; rows that sum to nothing are left out."""
    total = F.sum("w").over(Window.partitionBy("i"))
    return edges.select("i", "j", F.try_divide("w", total).alias("w")).where("w is not null")


def hop_distance(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """i, hops: fewest edges from any source, weights ignored. Nodes out of reach are absent; so are those beyond most
    hops, where most is given.

    One job a level: the nodes next to the last level's, less those visited, which are one table again after every
    eighth level; how many there are is counted while they are written.
    """
    links = cut(edges.select("i", "j").where("i <> j").distinct(), "links")
    front = cut(sources.select("i").distinct().select("i", F.lit(0).alias("hops")), "sources")
    seen, level = front, 0
    while most is None or level < most:
        level += 1
        step = front.join(links, "i").select(F.col("j").alias("i")).distinct().join(seen, "i", "left_anti").select("i", F.lit(level).alias("hops"))
        front, n = cut_counted(step, "hops")
        if not n:
            break
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = cut(seen, "seen")
    return seen


def random_walk(x0: DataFrame, p: DataFrame, steps: int, every: int = 0) -> DataFrame:
    """x after steps of x <- P x; x0 has i, x. every: keep step numbers divisible by it, as column step."""
    x, kept = x0.select("i", "x"), []
    if every:
        kept.append(x.select(F.lit(0).alias("step"), "i", "x"))
    for k in range(1, steps + 1):
        moved = p.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        x = cut(moved, "walk") if k % 5 == 0 else moved
        if every and k % every == 0:
            kept.append(x.select(F.lit(k).alias("step"), "i", "x"))
    if not every:
        return x
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def walk_errors(x0: DataFrame, p: DataFrame, last: int, every: int = 5) -> DataFrame:
    """step, error: mean squared difference of the scaled walk from the scaled column sums of P; best marks the least,
    where step 0 counts as infinite if it would be the least."""
    target = p.groupBy("j").agg(F.sum("w").alias("s")).withColumn("s", F.col("s") / (F.max("s").over(Window.partitionBy()) + F.lit(1e-12))).withColumnRenamed("j", "i")
    walks = random_walk(x0, p, last, every)
    scaled = walks.withColumn("x", F.col("x") / (F.max("x").over(Window.partitionBy("step")) + F.lit(1e-12)))
    err = scaled.join(target, "i", "left").groupBy("step").agg(F.avg((F.col("x") - F.coalesce("s", F.lit(0.0))) ** 2).alias("error"))
    best = F.first("step").over(Window.orderBy("error", "step"))  # a row a kept step
    err = err.withColumn("first", best).withColumn("error", F.when((F.col("first") == 0) & (F.col("step") == 0), F.lit(float("inf"))).otherwise(F.col("error")))
    return err.select("step", "error", (F.row_number().over(Window.orderBy("error", "step")) == 1).alias("best"))


def profile_by_distance(values: DataFrame, dist: str = "dist", x: str = "x") -> DataFrame:
    """Mean of x in each whole distance."""
    return values.groupBy(F.floor(F.col(dist)).cast("long").alias("bin")).agg(F.avg(x).alias("mean_x"), F.count("*").alias("n"))


def radial_zones(spots: DataFrame, cuts: tuple[float, float] = (0.33, 0.66), names: tuple[str, str, str] = ("core", "mid", "boundary"), id_col: str = "spot") -> DataFrame:
    """Spots with dist (from the centroid) and zone (by the quantiles of dist)."""
    mx, my = spots.agg(F.avg("x"), F.avg("y")).first()
    c = spots.withColumn("dist", F.sqrt((F.col("x") - F.lit(mx)) ** 2 + (F.col("y") - F.lit(my)) ** 2))
    low, high = quantiles(c, "dist", list(cuts))
    return c.withColumn("zone", F.when(F.col("dist") <= F.lit(low), names[0]).when(F.col("dist") <= F.lit(high), names[1]).otherwise(names[2]))


def coarse_grain(edges: DataFrame, labels: DataFrame, mode: str = "avg", keep_diagonal: bool = False) -> DataFrame:
    """ca, cb, w over compartments: sums of edge weights (none), divided by both sizes (avg), over existing edges (edges), or of
    the row-stochastic graph (rw). labels has i, comp. Compartments without a shared edge are absent."""
    e = row_stochastic(edges) if mode == "rw" else edges
    a = labels.select("i", F.col("comp").alias("ca"))
    b = labels.select(F.col("i").alias("j"), F.col("comp").alias("cb"))
    g = e.join(a, "i").join(b, "j").groupBy("ca", "cb").agg(F.sum("w").alias("s"), F.count("*").alias("m"))
    if not keep_diagonal:
        g = g.where("ca <> cb")
    if mode == "avg":
        n = labels.groupBy("comp").agg(F.count("*").alias("n"))
        g = g.join(n.select(F.col("comp").alias("ca"), F.col("n").alias("na")), "ca").join(n.select(F.col("comp").alias("cb"), F.col("n").alias("nb")), "cb")
        return g.select("ca", "cb", (F.col("s") / (F.col("na") * F.col("nb"))).alias("w"))
    if mode == "edges":
        return g.select("ca", "cb", (F.col("s") / F.col("m")).alias("w"))
    return g.select("ca", "cb", F.col("s").alias("w"))


def adjacency(edges: DataFrame, convention: str = "sym") -> DataFrame:
    """i, j, wt, l: the exposure weights and the Laplacian of a graph, the diagonal included.

    sym  symmetric-normalised Laplacian; exposure from its off-diagonal, rows scaled to 1
    row  rows scaled to 1; Laplacian unit minus that
    raw  rows scaled to 1 with the diagonal kept; Laplacian degree minus weight
    """
    by = Window.partitionBy("i")
    if convention == "raw":
        e = edges.select("i", "j", "w", F.sum("w").over(by).alias("deg"))
        off = e.select("i", "j", F.try_divide("w", "deg").alias("wt"), (-F.col("w")).alias("l"))
        diag = e.select("i", F.col("i").alias("j"), F.lit(0.0).alias("wt"), F.col("deg").alias("l")).distinct()
        return off.unionByName(diag).groupBy("i", "j").agg(F.sum("wt").alias("wt"), F.sum("l").alias("l"))
    e = edges.where("i <> j")
    d = e.groupBy("i").agg(F.sum("w").alias("deg")).where("deg > 0")
    if convention == "row":
        off = e.join(d, "i").select("i", "j", (F.col("w") / F.col("deg")).alias("wt")).withColumn("l", -F.col("wt"))
    elif convention == "sym":
        s = e.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("deg").alias("degj")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("deg") * F.col("degj"))).alias("s"))
        off = s.select("i", "j", (F.col("s") / F.sum("s").over(by)).alias("wt"), (-F.col("s")).alias("l"))
    else:
        raise ValueError(f"unknown convention {convention!r}")
    return off.unionByName(d.select("i", F.col("i").alias("j"), F.lit(0.0).alias("wt"), F.lit(1.0).alias("l")))


def connected_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """i, component (smallest node reachable), by rounds of neighbour minima with a jump along the labels.

    Labels are nodes of the same component, so a label's own label is a better one; paths halve in each round, and rounds
    grow with the logarithm of the longest path. What changed is counted while a round is written.
    """
    links = cut(edges.select("i", "j").where("i <> j"), "links")
    label = nodes.select("i", F.col("i").alias("c"))
    while True:
        low = links.join(label.select(F.col("i").alias("j"), "c"), "j").groupBy("i").agg(F.min("c").alias("m"))
        near = label.join(low, "i", "left").select("i", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = near.join(near.select(F.col("i").alias("n"), F.col("n").alias("nn")), "n", "left").select("i", F.col("c").alias("old"), F.least("n", "nn").alias("c"))
        label, changed = cut_counted(jump, "labels", F.col("c") != F.col("old"))
        label = label.select("i", "c")
        if not changed:
            return label.select("i", F.col("c").alias("component"))


def split_components(edges: DataFrame, labels: DataFrame, min_size: int = 5) -> DataFrame:
    """i, comp, part: compartments split into connected parts. Parts smaller than min_size go back to the compartment
    itself; the others get _cc0 for the largest (smallest node on ties), then _cc1 and so on."""
    a, b = labels.select("i", "comp"), labels.select(F.col("i").alias("j"), F.col("comp").alias("cj"))
    inner = edges.join(a, "i").join(b, "j").where("comp = cj").select("i", "j")
    cc = connected_labels(inner, labels).join(a, "i")
    sizes = cc.groupBy("comp", "component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    order = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("n"), "component")) - 1
    named = sizes.select("comp", "component", F.concat(F.col("comp"), F.lit("_cc"), order.cast("string")).alias("part"))
    return cc.join(named, ["comp", "component"], "left").select("i", "comp", F.coalesce("part", "comp").alias("part"))


def induced(edges: DataFrame, keep: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """Edges i < j above the threshold between kept nodes."""
    a = keep.select("i")
    return edges.where((F.col("w") > threshold) & (F.col("i") < F.col("j"))).join(a, "i", "left_semi").join(a.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "w")


def induced_by(edges: DataFrame, labels: DataFrame, key: str, threshold: float = 1e-4) -> DataFrame:
    """key, i, j, w: edges i < j above the threshold whose ends share a value of key; the induced graphs of all values at once."""
    a, b = labels.select("i", key), labels.select(F.col("i").alias("j"), F.col(key).alias("_other"))
    e = edges.where((F.col("w") > threshold) & (F.col("i") < F.col("j"))).join(a, "i").join(b, "j")
    return e.where(F.col(key) == F.col("_other")).select(key, "i", "j", "w")


def interlayer(edges: DataFrame, labels: DataFrame, comps: DataFrame, topology: DataFrame, d_inter: float = 1.0) -> DataFrame:
    """ca, cb, w in both directions: summed spot weights between compartments of coupled layers, over the root of both
    sizes (at least 1), times the root of both d_d and d_inter. comps has comp, macro, d_d; topology has ma, mb."""
    n = labels.groupBy("comp").agg(F.count("*").alias("n"))
    c = comps.join(n, "comp").select("comp", "macro", "d_d", "n")
    a = c.select(F.col("comp").alias("ca"), F.col("macro").alias("ma"), F.col("d_d").alias("da"), F.col("n").alias("na"))
    b = c.select(F.col("comp").alias("cb"), F.col("macro").alias("mb"), F.col("d_d").alias("db"), F.col("n").alias("nb"))
    flux = edges.join(labels.select("i", F.col("comp").alias("ca")), "i").join(labels.select(F.col("i").alias("j"), F.col("comp").alias("cb")), "j").groupBy("ca", "cb").agg(F.sum("w").alias("flux")).where("flux > 0")
    w = F.lit(d_inter) * F.col("flux") / F.greatest(F.sqrt(F.col("na") * F.col("nb")), F.lit(1.0)) * F.sqrt(F.col("da") * F.col("db"))
    one = flux.join(a, "ca").join(b, "cb").join(F.broadcast(topology), ["ma", "mb"]).select("ca", "cb", "ma", "mb", w.alias("w"))
    back = one.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), F.col("mb").alias("ma"), F.col("ma").alias("mb"), "w")
    return one.unionByName(back)


def interlayer_summary(coupling: DataFrame, comps: DataFrame) -> DataFrame:
    """ma, mb, w: coupling between layers over the root of their numbers of compartments (at least 1)."""
    n = comps.groupBy("macro").agg(F.count("*").alias("n"))
    g = coupling.groupBy("ma", "mb").agg(F.sum("w").alias("s"))
    g = g.join(n.select(F.col("macro").alias("ma"), F.col("n").alias("na")), "ma").join(n.select(F.col("macro").alias("mb"), F.col("n").alias("nb")), "mb")
    return g.select("ma", "mb", (F.col("s") / F.greatest(F.sqrt(F.col("na") * F.col("nb")), F.lit(1.0))).alias("w"))


def edge_class(a: str, b: str):
    """intra_M, or inter_ and both macro types in order."""
    return F.when(F.col(a) == F.col(b), F.concat(F.lit("intra_"), F.col(a))).otherwise(F.concat(F.lit("inter_"), F.least(a, b), F.lit("_"), F.greatest(a, b)))
