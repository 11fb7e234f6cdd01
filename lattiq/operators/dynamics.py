"""State evolution on compartment graphs: one group of rows a run, all runs in parallel.

A run is the rows of one run_id in a design table: node, its rates and initial state. The solver is a grouped
pandas function with a fixed schema; the graph (at most MAX_NODES compartments) goes with it. A design may name a
graph per run (column graph_id) for ablations and rewirings; each run then meets its graph in its own group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

MAX_NODES = 4096
TRAJECTORY = "run_id string, t_idx int, t double, node long, h double, d double, r double"
DRUG_TRAJECTORY = TRAJECTORY + ", d2 double, x double, f double"
# The Dormand-Prince pair of orders 5 and 4.
_C = (0.0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1.0, 1.0)
_A = (
    (),
    (1 / 5,),
    (3 / 40, 9 / 40),
    (44 / 45, -56 / 15, 32 / 9),
    (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
    (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
)
_E = (71 / 57600, 0.0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40)


def rk45(f: Callable, y0: np.ndarray, times: np.ndarray, rtol: float = 1e-6, atol: float = 1e-9) -> np.ndarray:
    """States at the given times (rows) by adaptive steps that end at each of them."""
    y, t, out = y0.astype(float), float(times[0]), [y0.astype(float)]
    h = (times[-1] - times[0]) / max(len(times) - 1, 1)
    for goal in times[1:]:
        while t < goal:
            h = min(h, goal - t)
            k = [f(t, y)]
            for c, row in zip(_C[1:], _A[1:]):
                k.append(f(t + c * h, y + h * sum(a * x for a, x in zip(row, k))))
            new = y + h * sum(a * x for a, x in zip(_A[6], k))
            err = h * sum(e * x for e, x in zip(_E, k))
            norm = np.sqrt(np.mean((err / (atol + rtol * np.maximum(np.abs(y), np.abs(new)))) ** 2))
            if norm <= 1:
                t, y = (goal if h == goal - t else t + h), new
            h *= min(5.0, max(0.2, 0.9 * max(norm, 1e-10) ** -0.2))
        out.append(y)
    return np.array(out)


def collect_graph(adjacency: DataFrame) -> pd.DataFrame:
    """The edges i, j, wt, l of one graph, to go with every run. Raises where it is too large for one group."""
    n = adjacency.select("i").distinct().count()
    if n > MAX_NODES:
        raise ValueError(f"a graph of {n} nodes; compartment graphs have at most {MAX_NODES}")
    return adjacency.select("i", "j", "wt", "l").toPandas()


def _matrices(edges: pd.DataFrame, run: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Exposure matrix and Laplacian in the order of the run's nodes; a node without edges has none."""
    nodes = run["node"].to_numpy()
    if len(nodes) > MAX_NODES:
        raise ValueError(f"a run of {len(nodes)} nodes; compartment graphs have at most {MAX_NODES}")
    wt, lap = np.zeros((len(nodes),) * 2), np.zeros((len(nodes),) * 2)
    edges = edges[edges["i"].isin(nodes) & edges["j"].isin(nodes)]
    i, j = np.searchsorted(nodes, edges["i"].to_numpy()), np.searchsorted(nodes, edges["j"].to_numpy())
    wt[i, j], lap[i, j] = edges["wt"], edges["l"]
    return wt, lap


def _solved(design: DataFrame, adjacency: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """solve(run, exposure, Laplacian) for each run, its rows in the order of node.

    One graph for all runs goes with the function. Where the adjacency has a graph_id, each run meets the edges of its own
    graph in its group, so that any number of graphs passes through the shuffle and none through the driver.
    """
    if "graph_id" not in adjacency.columns:
        edges = collect_graph(adjacency)

        def alone(run: pd.DataFrame) -> pd.DataFrame:
            run = run.sort_values("node")
            return solve(run, *_matrices(edges, run))

        return design.groupBy("run_id").applyInPandas(alone, schema)
    runs = design.select(F.col("run_id").alias("_run"), F.col("graph_id").alias("_graph")).distinct()
    own = cut(adjacency, "graphs").join(runs, F.col("graph_id") == F.col("_graph")).select("_run", "i", "j", "wt", "l")
    names = [f.split()[0] for f in schema.split(", ")]

    def met(run: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if run.empty:
            return pd.DataFrame(columns=names)
        run = run.sort_values("node")
        return solve(run, *_matrices(edges, run))

    return design.groupBy("run_id").cogroup(own.groupBy("_run")).applyInPandas(met, schema)


def _long(run: pd.DataFrame, times: np.ndarray, blocks: dict[str, np.ndarray]) -> pd.DataFrame:
    n, steps = len(run), len(times)
    return pd.DataFrame({
        "run_id": run["run_id"].iloc[0],
        "t_idx": np.repeat(np.arange(steps, dtype=np.int32), n),
        "t": np.repeat(times, n),
        "node": np.tile(run["node"].to_numpy(), steps),
        **{k: v.ravel() for k, v in blocks.items()},
    })


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def simulate(design: DataFrame, adjacency: DataFrame, t_end: float, steps: int, method: str = "euler", conserve: bool = False, renormalise: bool = False, rtol: float = 1e-6, bounded: bool = False) -> DataFrame:
    """Trajectories of the healthy/diseased/recovered model, run_id, t_idx, t, node, h, d, r.

    design has run_id, node, beta, rho, d_h, d_d, h0, d0 and may have graph_id. method is euler (steps + 1
    samples, clipped at each) or rk45 (the same samples, adaptive steps). conserve: r is one minus the others, as
    in the simplified model; else r gathers what recovers. renormalise: h, d, r are scaled to sum to 1 each step. bounded: rates
    see h and d scaled down to a sum of 1 where they exceed it, as in the layered model.
    """
    times = np.linspace(0.0, t_end, steps + 1)

    def solve(run: pd.DataFrame, wt: np.ndarray, lap: np.ndarray) -> pd.DataFrame:
        beta, rho, dh, dd = (run[c].to_numpy() for c in ("beta", "rho", "d_h", "d_d"))
        n = len(run)

        def rate(t: float, y: np.ndarray) -> np.ndarray:
            h, d = _clip(y[:n]), _clip(y[n : 2 * n])
            if bounded:
                top = np.maximum(h + d, 1.0)
                h, d = h / top, d / top
            infect, recover = beta * h * (wt @ d), rho * d
            a, b = -infect - dh * (lap @ h), infect - recover - dd * (lap @ d)
            return np.concatenate([a, b, -a - b if conserve else recover])

        y = np.concatenate([run["h0"].to_numpy(), run["d0"].to_numpy(), np.zeros(n)])
        if method == "rk45":
            ys = rk45(rate, y, times, rtol)
            if conserve:
                ys = _clip(ys)
                ys[:, 2 * n :] = _clip(1 - ys[:, :n] - ys[:, n : 2 * n])
        else:
            ys, dt = [y], t_end / steps
            for k in range(steps):
                y = _clip(y + dt * rate(k * dt, y))
                if renormalise:
                    s = y[:n] + y[n : 2 * n] + y[2 * n :]
                    y = y / np.tile(np.where(s > 0, s, 1.0), 3)
                ys.append(y)
            ys = np.array(ys)
        return _long(run, times, {"h": ys[:, :n], "d": ys[:, n : 2 * n], "r": ys[:, 2 * n :]})

    return _solved(design, adjacency, solve, TRAJECTORY)


def dose_rate(mode: str, t: float, t_dose: float, dose: float, width: float = 0.5, duration: float = 5.0, n_doses: int = 3, interval: float = 10.0) -> float:
    """Drug input at t: a Gaussian pulse (bolus, also for unknown modes), a constant over a time (infusion), or pulses."""
    if mode == "infusion":
        return dose if t_dose <= t <= t_dose + duration else 0.0
    at = [t_dose + k * interval for k in range(n_doses if mode == "repeated" else 1)]
    return sum(dose / (width * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((t - x) / width) ** 2) for x in at)


def simulate_drug(design: DataFrame, adjacency: DataFrame, t_end: float, steps: int, method: str = "euler", rtol: float = 1e-6) -> DataFrame:
    """Trajectories of the drug model with h, d, r, d2 (attenuated), x (dead), f (drug).

    design has the columns of simulate, those of params.drug_rates, and dose_mode, t_dose, dose; target (boolean,
    optional) says which nodes are dosed.
    """
    times = np.linspace(0.0, t_end, steps + 1)

    def solve(run: pd.DataFrame, wt: np.ndarray, lap: np.ndarray) -> pd.DataFrame:
        beta, rho, dh, dd, delta, rho2, kf, ke, df, ic50 = (run[c].to_numpy() for c in ("beta", "rho", "d_h", "d_d", "delta", "rho2", "k_f", "k_e", "d_f", "ic50"))
        mode, t_dose, dose = (run[c].iloc[0] for c in ("dose_mode", "t_dose", "dose"))
        aim = run["target"].to_numpy().astype(float) if "target" in run else np.ones(len(run))
        n = len(run)

        def rate(t: float, y: np.ndarray) -> np.ndarray:
            h, d, d2, r, x = (_clip(y[k * n : (k + 1) * n]) for k in range(5))
            f = np.maximum(y[5 * n :], 0.0)
            eff = np.where(ic50 > 0, beta / (1 + f / np.where(ic50 > 0, ic50, 1.0)), beta)
            infect, act = eff * h * (wt @ d), kf * f * d
            return np.concatenate([
                -infect - dh * (lap @ h),
                infect - rho * d - delta * d - act - dd * (lap @ d),
                act - rho2 * d2 - dd * (lap @ d2),
                rho * d + rho2 * d2,
                delta * d,
                dose_rate(mode, t, t_dose, dose) * aim - ke * f - act - df * (lap @ f),
            ])

        y = np.concatenate([run["h0"].to_numpy(), run["d0"].to_numpy(), np.zeros(4 * n)])
        if method == "rk45":
            ys = rk45(rate, y, times, rtol)
        else:
            ys, dt = [y], t_end / steps
            for k in range(steps):
                y = y + dt * rate(k * dt, y)
                y = np.concatenate([_clip(y[: 5 * n]), np.maximum(y[5 * n :], 0.0)])
                ys.append(y)
            ys = np.array(ys)
        part = lambda k: ys[:, k * n : (k + 1) * n]
        return _long(run, times, {"h": part(0), "d": part(1), "r": part(3), "d2": part(2), "x": part(4), "f": part(5)})

    return _solved(design, adjacency, solve, DRUG_TRAJECTORY)


def finals(trajectory: DataFrame, states: tuple[str, ...] = ("h", "d", "r")) -> DataFrame:
    """Last state of each run and node, clipped and scaled to sum to 1."""
    last = trajectory.groupBy("run_id", "node").agg(*[F.max_by(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(s))), "t_idx").alias(s) for s in states])
    total = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    return last.select("run_id", "node", *[(F.col(s) / F.when(total > 0, total).otherwise(1.0)).alias(s) for s in states])


def seeded(rates: DataFrame, seed: float = 0.05, where=None) -> DataFrame:
    """rates with h0 and d0: seeded where the condition holds (is_boundary by default)."""
    where = F.col("is_boundary") if where is None else where
    return rates.withColumn("d0", F.when(where, F.lit(float(seed))).otherwise(0.0)).withColumn("h0", 1.0 - F.col("d0"))
