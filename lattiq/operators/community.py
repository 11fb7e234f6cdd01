"""Community detection by modularity: distributed moves, refinement into connected parts, contraction.

Each level runs rounds of moves over the node and edge tables. In a round every node finds the neighbouring community
with the largest gain of modularity; a seeded coin lets some of the nodes move, fewer each round, so that neighbours
don't swap places for ever, and the moves of a level are kept only if they raise the modularity. The
communities are then refined: inside each, nodes start alone again and join by the same gains, and what isn't connected
is parted. The refined parts become the nodes of the next level, which starts from the unrefined communities, so a later
level can move a part out of the community it was grown in. At the end every community is connected.

All rounds are joins and sums over tables; a community of any size is only ever a sum. Each round is written to the
shared folder, and what moved is counted while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_counted
from .graph import connected_labels

#: Rounds of a level and of its refinement, levels; the share of nodes that may move in the first round, and its fall a round.
ROUNDS, REFINING, LEVELS, SHARE, FALL = 8, 4, 10, 0.7, 0.85
#: A level's rounds end when at most one node in so many would still move.
SETTLED = 25


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (i, c) over edges (i, j, w) in both directions; 0 for a graph without weights."""
    total = edges.agg(F.sum("w")).first()[0]
    state = edges.groupBy("i").agg(F.sum("w").alias("k")).join(labels, "i")
    return _quality(edges, state, total, resolution) if total else 0.0


def _proposals(edges: DataFrame, state: DataFrame, total: float, resolution: float, within: str | None = None) -> DataFrame:
    """i, to, gain: the community with the largest gain for each node that gains by moving. state has i, k, c (and within)."""
    kept = [] if within is None else [within]
    there = state.select(F.col("i").alias("j"), F.col("c").alias("to"), *[F.col(x).alias("_" + x) for x in kept])
    links = edges.where("i <> j").join(there, "j")
    if kept:
        links = links.join(state.select("i", within), "i").where(F.col(within) == F.col("_" + within))
    into = links.groupBy("i", "to").agg(F.sum("w").alias("w"))
    sums = state.groupBy("c").agg(F.sum("k").alias("t"))
    own = state.select("i", "k", "c").join(sums, "c").withColumnRenamed("t", "own")
    each = into.join(own, "i").join(sums.select(F.col("c").alias("to"), "t"), "to")
    scale = resolution * F.col("k") / total
    stay = F.max(F.when(F.col("to") == F.col("c"), F.col("w") - scale * (F.col("own") - F.col("k")))).over(Window.partitionBy("i"))
    # a node without an edge into its own community has only what the others' strengths cost it
    each = each.withColumn("stay", F.coalesce(stay, -scale * (F.col("own") - F.col("k")))).where(F.col("to") != F.col("c"))
    each = each.select("i", "to", (F.col("w") - scale * F.col("t") - F.col("stay")).alias("gain")).where(F.col("gain") > 1e-12 * total)
    best = F.max_by("to", F.struct(F.round("gain", 12), -F.col("to")))
    return each.groupBy("i").agg(best.alias("to"), F.max("gain").alias("gain"))


def _coin(column: str, seed: int, turn: int, share: float):
    """Whether a node may move in this turn: a hash of it below share."""
    return F.pmod(F.xxhash64(column, F.lit(seed), F.lit(turn)), F.lit(1 << 20)) < int(share * (1 << 20))


def _quality(edges: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    """Modularity of state (i, k, c) in one job."""
    a, b = state.select("i", "c"), state.select(F.col("i").alias("j"), F.col("c").alias("cj"))
    same = edges.join(a, "i").join(b, "j").where("c = cj").select((F.col("w") / total).alias("x"))
    size = state.groupBy("c").agg(F.sum("k").alias("t")).select((-resolution * (F.col("t") / total) ** 2).alias("x"))
    return same.unionByName(size).agg(F.sum("x")).first()[0] or 0.0


def _moved(edges: DataFrame, state: DataFrame, nodes: int, total: float, resolution: float, seed: int) -> tuple[DataFrame, float]:
    """state after rounds of moves, and its modularity; the state as it came where the rounds didn't raise it.

    A round is one job: proposals, the coin, and the count of nodes that would move. The share of movers falls from round
    to round, so that what still swaps places settles; the few nodes left over are taken up by the next level.
    """
    first = now = _quality(edges, state, total, resolution)
    start = state
    for turn in range(ROUNDS):
        new = state.join(_proposals(edges, state, total, resolution).select("i", "to"), "i", "left")
        goes = _coin("i", seed, turn, SHARE * FALL**turn) & F.col("to").isNotNull()
        state, n = cut_counted(new.select("i", "k", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c"), F.col("to").isNotNull().alias("asks")), "moved", F.col("asks"))
        state = state.drop("asks")
        if n <= nodes // SETTLED:
            break
    now = _quality(edges, state, total, resolution)
    return (state, now) if now > first else (start, first)


def _refined(edges: DataFrame, state: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    """i, k, c, part: each community c grown again from single nodes, and parted where it isn't connected.

    Only nodes that are still alone move, and only into communities whose founder stays (tails to heads), so a part
    grows as a star and no chain of moves forms.
    """
    parts = cut(state.select("i", "k", F.col("c").alias("home"), F.col("i").alias("c")), "alone")
    for turn in range(REFINING):
        alone = parts.groupBy("c").agg(F.count("*").alias("n")).where("n = 1").select(F.col("c").alias("i"))
        asked = _proposals(edges, parts, total, resolution, "home").where(_coin("i", seed, -1 - turn, 0.5) & ~_coin("to", seed, -1 - turn, 0.5))
        go = asked.join(alone, "i", "left_semi").select("i", "to")
        parts, n = cut_counted(parts.join(go, "i", "left").select("i", "k", "home", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("went")), "refined", F.col("went"))
        parts = parts.drop("went")
        if not n:
            break
    inner = edges.join(parts.select("i", "c"), "i").join(parts.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j").where("c = cj").select("i", "j")
    joined = connected_labels(inner, parts.select("i"))
    return parts.join(joined, "i").select("i", "k", F.col("home").alias("c"), F.col("component").alias("part"))


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """i, community (its smallest node) of every row of nodes (i) over edges (i, j, w), both directions stored, weights
    of at least 0. Nodes without an edge are communities of their own. The same seed gives the same communities."""
    graph = cut(edges.where("w > 0").groupBy("i", "j").agg(F.sum("w").alias("w")), "level-edges")
    total = graph.agg(F.sum("w")).first()[0]
    every = nodes.select("i").distinct()
    if not total:
        return every.select("i", F.col("i").alias("community"))
    state, nodes_now = cut_counted(graph.groupBy("i").agg(F.sum("w").alias("k")).select("i", "k", F.col("i").alias("c")), "level")
    members = state.select(F.col("i").alias("node"), "i")
    first = graph
    for level in range(LEVELS):
        state, _ = _moved(graph, state, nodes_now, total, resolution, seed + level)
        parts = cut(_refined(graph, state, total, resolution, seed + level), "parts")
        n = parts.agg(F.count("*").alias("nodes"), F.count_distinct("part").alias("parts"), F.count_distinct("c").alias("c")).first()
        if n["parts"] == n["nodes"] or n["c"] == n["parts"] == 1:
            break
        nodes_now = n["parts"]
        a, b = parts.select("i", F.col("part").alias("a")), parts.select(F.col("i").alias("j"), F.col("part").alias("b"))
        graph = cut(graph.join(a, "i").join(b, "j").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("w")), "level-edges")
        members = cut(members.join(parts.select("i", "part"), "i").select("node", F.col("part").alias("i")), "members")
        named = parts.groupBy("c").agg(F.min("part").alias("name"))
        state = cut(parts.groupBy("part", "c").agg(F.sum("k").alias("k")).join(named, "c").select(F.col("part").alias("i"), "k", F.col("name").alias("c")), "level")
    labels = cut(members.join(state.select("i", "c"), "i").select(F.col("node").alias("i"), "c"), "communities")
    inner = first.join(labels, "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j").where("c = cj").select("i", "j")
    return every.join(connected_labels(inner, labels.select("i")), "i", "left").select("i", F.coalesce("component", "i").alias("community"))
