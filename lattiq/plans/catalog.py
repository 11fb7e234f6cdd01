"""Registry of queries and their SQL, and the SQL building blocks that the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import dims

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL for the same rows where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def values(rows, name: str, columns: str) -> str:
    """A CTE of constants; numbers as doubles."""
    show = lambda v: f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


SPOTS = f"spots AS (SELECT vec_id AS spot, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS identity, {_list(dims.MACROS)}[label % 6 + 1] AS macro, embedding FROM embeddings)"
EXPR = "expr AS (SELECT spot, 'g' || (k - 1) AS gene, floor(abs(CAST(embedding[k + 2] AS DOUBLE)) * 100) AS count FROM spots, (SELECT unnest(range(1, 63)) AS k))"


def nn(k: int = 6) -> str:
    return f"nn AS (SELECT a.spot AS i, b.spot AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM spots a JOIN spots b ON a.spot <> b.spot QUALIFY row_number() OVER (PARTITION BY a.spot ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.spot) <= {k})"


WSP = "sg AS (SELECT quantile_cont(d, 0.5) AS s FROM nn), w0 AS (SELECT i, j, exp(-d * d / (2 * s * s)) AS w FROM nn, sg), wsp AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM w0 UNION ALL SELECT j, i, w FROM w0) GROUP BY 1, 2)"
RADIAL = "ctr AS (SELECT avg(x) AS mx, avg(y) AS my FROM spots), dst AS (SELECT s.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS dist FROM spots s, ctr), qq AS (SELECT quantile_cont(dist, 0.33) AS q0, quantile_cont(dist, 0.66) AS q1 FROM dst), lab AS (SELECT spot AS i, spot, x, y, macro, dist, CASE WHEN dist <= q0 THEN 'core' WHEN dist <= q1 THEN 'mid' ELSE 'boundary' END AS zone, macro || '_' || CASE WHEN dist <= q0 THEN 'core' WHEN dist <= q1 THEN 'mid' ELSE 'boundary' END AS comp FROM dst, qq)"
GRAPH = ", ".join([SPOTS, nn(), WSP, RADIAL])

COMPS = f"comps0 AS (SELECT CAST(n_nationkey AS BIGINT) AS node, {_list(dims.MACROS)}[n_nationkey % 6 + 1] AS macro, {_list(dims.REGIONS)}[n_regionkey + 1] AS region FROM nation), comps AS (SELECT node, macro || '_' || region AS comp, macro, region, contains(macro || '_' || region, 'outer_medulla') OR ends_with(macro || '_' || region, '_boundary') AS is_boundary FROM comps0)"
TRADE = "trade AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
EDGES = TRADE + ", e0 AS (SELECT i, j, sum(v) / 2 AS w FROM (SELECT i, j, v FROM trade WHERE i <> j UNION ALL SELECT j, i, v FROM trade WHERE i <> j) GROUP BY 1, 2), edges AS (SELECT i, j, w / (SELECT max(w) FROM e0) AS w FROM e0)"
DIMS = ", ".join([
    values([(k, *v) for k, v in dims.MACRO_RATES.items()], "mr", "macro, beta, rho, d_d"),
    values([(k, *v) for k, v in dims.REGION_RATES.items()], "rr", "region, bm, rm"),
])
RATES = f"rates AS (SELECT c.*, coalesce(m.beta, {dims.BETA}) * coalesce(r.bm, CAST(1 AS DOUBLE)) AS beta, coalesce(m.rho, {dims.RHO}) * coalesce(r.rm, CAST(1 AS DOUBLE)) AS rho, CAST({dims.D_H} AS DOUBLE) AS d_h, coalesce(m.d_d, {dims.D_D}) AS d_d FROM comps c LEFT JOIN mr m USING (macro) LEFT JOIN rr r USING (region))"
OUTER = "rates AS (SELECT c.*, m.beta * CASE WHEN contains(comp, 'outer_medulla') OR contains(comp, 'boundary') THEN CAST(1.25 AS DOUBLE) ELSE 1 END AS beta, m.rho * CASE WHEN contains(comp, 'outer_medulla') OR contains(comp, 'boundary') THEN CAST(1.1 AS DOUBLE) ELSE 1 END AS rho, CAST(0.05 AS DOUBLE) AS d_h, m.d_d FROM comps c JOIN mr m USING (macro))"


def adj(convention: str = "sym", source: str = "edges", g: str = "'g'", by: str = "") -> str:
    """CTE adj(g, i, j, wt, l) of a graph, or of graphs told apart by a column."""
    key, same = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    own = f"e.{by}" if by else g
    pre = f"dg AS (SELECT {key}i, sum(w) AS deg FROM {source} WHERE i <> j GROUP BY {key}i)"
    if convention == "row":
        off = f"ad AS (SELECT {own} AS g, e.i, e.j, e.w / a.deg AS wt, -(e.w / a.deg) AS l FROM {source} e JOIN dg a ON {f'a.{by} = e.{by} AND ' if by else ''}a.i = e.i WHERE e.i <> e.j)"
    else:
        off = (
            f"sn AS (SELECT {own} AS g, e.i, e.j, e.w / sqrt(a.deg * b.deg) AS s FROM {source} e JOIN dg a ON {f'a.{by} = e.{by} AND ' if by else ''}a.i = e.i JOIN dg b ON {f'b.{by} = e.{by} AND ' if by else ''}b.i = e.j WHERE e.i <> e.j), "
            "ad AS (SELECT g, i, j, s / sum(s) OVER (PARTITION BY g, i) AS wt, -s AS l FROM sn)"
        )
    return f"{pre}, {off}, adj AS (SELECT * FROM ad UNION ALL SELECT {by or g}, i, i, 0, 1 FROM dg)"


def seeded(where: str = "is_boundary", seed: float = 0.05, run: str = "'base'", source: str = "rates", g: str = "'g'", extra: str = "") -> str:
    return f"par AS (SELECT {run} AS run_id, {g} AS g, node, beta, rho, d_h, d_d{extra}, 1 - CASE WHEN {where} THEN CAST({seed} AS DOUBLE) ELSE 0 END AS h0, CASE WHEN {where} THEN CAST({seed} AS DOUBLE) ELSE 0 END AS d0 FROM {source})"


_UNIT = "greatest(0, least(1, {}))"


def sim(t_end: float, steps: int, conserve: bool = False, bounded: bool = False) -> str:
    """CTE traj of Euler steps over par and adj; bounded: rates see h and d over their sum where that exceeds 1."""
    see = lambda t, x: f"({t}.{x} / greatest({t}.h + {t}.d, 1))" if bounded else f"{t}.{x}"
    dt = f"CAST({t_end / steps} AS DOUBLE)"
    h = _UNIT.format(f"h + {dt} * (-beta * hs * lam - d_h * lh)")
    d = _UNIT.format(f"d + {dt} * (beta * hs * lam - rho * ds - d_d * ld)")
    r = _UNIT.format(f"r + {dt} * (d_h * lh + rho * ds + d_d * ld)" if conserve else f"r + {dt} * rho * ds")
    return f"""it AS (
  SELECT run_id, g, node, 0 AS k, h0 AS h, d0 AS d, CAST(0 AS DOUBLE) AS r FROM par
  UNION ALL
  SELECT run_id, g, node, k + 1, {h}, {d}, {r} FROM (
    SELECT a.run_id, a.g, a.node, a.k, any_value(a.h) AS h, any_value(a.d) AS d, any_value(a.r) AS r, any_value({see("a", "h")}) AS hs, any_value({see("a", "d")}) AS ds, any_value(p.beta) AS beta, any_value(p.rho) AS rho,
      any_value(p.d_h) AS d_h, any_value(p.d_d) AS d_d, coalesce(sum(e.wt * {see("c", "d")}), 0) AS lam, coalesce(sum(e.l * {see("c", "h")}), 0) AS lh, coalesce(sum(e.l * {see("c", "d")}), 0) AS ld
    FROM it a JOIN par p ON p.run_id = a.run_id AND p.node = a.node LEFT JOIN adj e ON e.g = a.g AND e.i = a.node LEFT JOIN it c ON c.run_id = a.run_id AND c.node = e.j
    WHERE a.k < {steps} GROUP BY a.run_id, a.g, a.node, a.k)),
traj AS (SELECT run_id, k AS t_idx, k * {dt} AS t, node, h, d, r FROM it)"""


def drug_sim(t_end: float, steps: int) -> str:
    """CTE traj of Euler steps of the drug model over par (with delta, rho2, d_f, mode, t_dose) and adj; dose 1."""
    dt = f"CAST({t_end / steps} AS DOUBLE)"
    t = f"(k * {dt})"
    pulse = lambda at: f"exp(-0.5 * (({t} - ({at})) / 0.5) * (({t} - ({at})) / 0.5)) / (0.5 * sqrt(2 * pi()))"
    dose = f"CASE mode WHEN 'infusion' THEN CASE WHEN {t} BETWEEN t_dose AND t_dose + 5 THEN 1 ELSE 0 END WHEN 'repeated' THEN {pulse('t_dose')} + {pulse('t_dose + 10')} + {pulse('t_dose + 20')} ELSE {pulse('t_dose')} END"
    u = _UNIT.format
    cols = ("beta", "rho", "d_h", "d_d", "delta", "rho2", "d_f", "mode", "t_dose")
    return f"""it AS (
  SELECT run_id, g, node, 0 AS k, h0 AS h, d0 AS d, CAST(0 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS d2, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS f FROM par
  UNION ALL
  SELECT run_id, g, node, k + 1,
    {u(f"h + {dt} * (-beta * h * lam - d_h * lh)")},
    {u(f"d + {dt} * (beta * h * lam - rho * d - delta * d - 0.5 * f * d - d_d * ld)")},
    {u(f"r + {dt} * (rho * d + rho2 * d2)")},
    {u(f"d2 + {dt} * (0.5 * f * d - rho2 * d2 - d_d * ld2)")},
    {u(f"x + {dt} * delta * d")},
    greatest(0, f + {dt} * ({dose} - 0.15 * f - 0.5 * f * d - d_f * lf))
  FROM (
    SELECT a.run_id, a.g, a.node, a.k, {", ".join(f"any_value(a.{c}) AS {c}" for c in ("h", "d", "r", "d2", "x", "f"))}, {", ".join(f"any_value(p.{c}) AS {c}" for c in cols)},
      coalesce(sum(e.wt * c.d), 0) AS lam, coalesce(sum(e.l * c.h), 0) AS lh, coalesce(sum(e.l * c.d), 0) AS ld, coalesce(sum(e.l * c.d2), 0) AS ld2, coalesce(sum(e.l * c.f), 0) AS lf
    FROM it a JOIN par p ON p.run_id = a.run_id AND p.node = a.node LEFT JOIN adj e ON e.g = a.g AND e.i = a.node LEFT JOIN it c ON c.run_id = a.run_id AND c.node = e.j
    WHERE a.k < {steps} GROUP BY a.run_id, a.g, a.node, a.k)),
traj AS (SELECT run_id, k AS t_idx, k * {dt} AS t, node, h, d, r, d2, x, f FROM it)"""


T_END, STEPS = 30.0, 120
BASE_PRE = ", ".join([COMPS, EDGES, DIMS, RATES, adj()])
BASE = ", ".join([BASE_PRE, seeded(), sim(T_END, STEPS)])
CROSS = "crossed AS (SELECT run_id, node, min(t) FILTER (WHERE d > 0.1) AS t_cross FROM traj GROUP BY 1, 2)"
FINALS = "fin0 AS (SELECT run_id, node, greatest(0, least(1, arg_max(h, t_idx))) AS h, greatest(0, least(1, arg_max(d, t_idx))) AS d, greatest(0, least(1, arg_max(r, t_idx))) AS r FROM traj GROUP BY 1, 2), finals AS (SELECT run_id, node, h / (h + d + r) AS h, d / (h + d + r) AS d, r / (h + d + r) AS r FROM fin0)"


def argmax_first(out: str, x: str, t: str = "t") -> str:
    """out at the largest x, the first t on ties."""
    return f"first({out} ORDER BY {x} DESC, {t})"


def trapz(value: str, source: str, by: str, name: str) -> str:
    """CTE name(by, k): integral of value over t."""
    return f"{name} AS (SELECT {by}, coalesce(sum(s), 0) AS k FROM (SELECT {by}, (t - lag(t) OVER w) * ({value} + lag({value}) OVER w) / 2 AS s FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY t)) GROUP BY {by})"


OUTPUTS = ", ".join([
    CROSS,
    FINALS,
    "mean0 AS (SELECT run_id, t, avg(d) AS d FROM traj GROUP BY 1, 2)",
    trapz("d", "mean0", "run_id", "auc"),
    f"outs AS (SELECT m.run_id, any_value(e.gr) AS global_r, any_value(e.gd) AS global_d, max(m.d) AS peak_d, {argmax_first('m.t', 'm.d', 'm.t')} AS t_peak, any_value(auc.k) AS auc_d, any_value(c.mi) AS mean_inv_time, any_value(c.fi) AS frac_invaded FROM mean0 m JOIN auc USING (run_id) JOIN (SELECT run_id, avg(r) AS gr, avg(d) AS gd FROM finals GROUP BY 1) e USING (run_id) JOIN (SELECT run_id, avg(t_cross) AS mi, avg(CASE WHEN t_cross IS NOT NULL THEN 1.0 ELSE 0.0 END) AS fi FROM crossed GROUP BY 1) c USING (run_id) GROUP BY m.run_id)",
])
