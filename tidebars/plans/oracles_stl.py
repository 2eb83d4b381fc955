"""STL and MSTL written out as SQL: every local line is a join of a position with its neighbours, their
weights and sums. The text is long, as each step of each pass is a table of its own."""

from __future__ import annotations

from tidebars.operators.decompose import PERIOD, STL_INNER, STL_SEASONAL, _odd, trend_window


def local_lines(name: str, src: str, keys: str, q: int, more: int = 0) -> str:
    """CTE ``name`` (keys, x, fit): lines through the ``q`` nearest points of ``src`` (keys, j, n, span, y), weights
    falling with the cube of the distance; from ``more`` points before the first to as many after the last."""
    half, on = (q - 1) // 2, " AND ".join(f"p.{k} = s.{k}" for k in keys.split(", "))
    kept = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f""",
{name}_p AS MATERIALIZED (SELECT *, a + least({q}, n) - 1 AS b FROM (SELECT *, least(greatest(x - {half}, 0), n - least({q}, n)) AS a
  FROM (SELECT {keys}, n, span, unnest(range(-{more}, n + {more})) AS x FROM (SELECT DISTINCT {keys}, n, span FROM {src})))),
{name}_w AS MATERIALIZED (SELECT {kept}, p.x, p.span, s.j - p.x AS d, s.y, greatest(p.x - p.a, p.b - p.x) + greatest({q} - p.n, 0) // 2 AS h
  FROM {name}_p AS p JOIN {src} AS s ON {on} AND s.j BETWEEN p.a AND p.b),
{name}_s AS MATERIALIZED (SELECT {keys}, x, span, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM (
  SELECT *, CASE WHEN abs(d) <= 0.001::DOUBLE * h THEN 1.0::DOUBLE WHEN abs(d) > 0.999::DOUBLE * h THEN 0.0::DOUBLE
    ELSE (1 - (abs(d) / h::DOUBLE) ** 3) ** 3 END AS w FROM {name}_w) GROUP BY {keys}, x, span),
{name} AS MATERIALIZED (SELECT {keys}, x, CASE WHEN sqrt(greatest(v, 0)) > 0.001::DOUBLE * span THEN (t0 - c / v * (t1 - c * t0)) / s0 ELSE t0 / s0 END AS fit
  FROM (SELECT *, s1 / s0 AS c, s2 / s0 - (s1 / s0) ** 2 AS v FROM {name}_s))"""


def stl(name: str, src: str, period: int, seasonal: int, inner: int = STL_INNER) -> str:
    """CTE ``name`` (symbol, i, n, y, s, t) from ``src`` (symbol, i, n, y)."""
    out, trend = "", "0.0::DOUBLE"
    ahead = lambda x, k: f"avg({x}) OVER (PARTITION BY symbol ORDER BY c ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    for k in range(inner):
        p = f"{name}{k}"
        from_ = src if not k else f"(SELECT symbol, i, n, y, t FROM {name}{k - 1}_o)"
        out += f""",
{p}_d AS MATERIALIZED (SELECT symbol, i % {period} AS ph, i // {period} AS j, y - {trend} AS y, greatest(n // {period}, 1) - 1 AS span,
  count(*) OVER (PARTITION BY symbol, i % {period}) AS n FROM {from_})"""
        out += local_lines(f"{p}_c", f"{p}_d", "symbol, ph", seasonal, 1)
        out += f""",
{p}_y AS MATERIALIZED (SELECT symbol, (x + 1) * {period} + ph AS c, fit FROM {p}_c),
{p}_1 AS MATERIALIZED (SELECT *, {ahead("fit", period)} AS m FROM {p}_y),
{p}_2 AS MATERIALIZED (SELECT *, {ahead("m", period)} AS mm FROM {p}_1),
{p}_3 AS MATERIALIZED (SELECT *, {ahead("mm", 3)} AS low FROM {p}_2),
{p}_l AS MATERIALIZED (SELECT f.symbol, f.c AS j, f.low AS y, s.n, s.n - 1 AS span FROM {p}_3 AS f JOIN {src} AS s ON f.symbol = s.symbol AND f.c = s.i)"""
        out += local_lines(f"{p}_f", f"{p}_l", "symbol", _odd(period + 1))
        out += f""",
{p}_s AS MATERIALIZED (SELECT s.symbol, s.i, s.n, s.y, y.fit - f.fit AS s FROM {src} AS s JOIN {p}_y AS y ON y.symbol = s.symbol AND y.c = s.i + {period}
  JOIN {p}_f AS f ON f.symbol = s.symbol AND f.x = s.i),
{p}_r AS MATERIALIZED (SELECT symbol, i AS j, n, n - 1 AS span, y - s AS y FROM {p}_s)"""
        out += local_lines(f"{p}_t", f"{p}_r", "symbol", trend_window(period, seasonal))
        out += f""",
{p}_o AS MATERIALIZED (SELECT s.*, t.fit AS t FROM {p}_s AS s JOIN {p}_t AS t ON t.symbol = s.symbol AND t.x = s.i)"""
        trend = "t"
    return out + f",\n{name} AS MATERIALIZED (SELECT * FROM {name}{inner - 1}_o)"


def stl_parts(bars: str) -> str:
    """CTE ``st``: the parts of ``b`` by STL, and the strengths of each series."""
    return bars + f",\nst_y AS MATERIALIZED (SELECT symbol, i, n, close AS y FROM b WHERE n >= {2 * PERIOD})" + stl("st_x", "st_y", PERIOD, STL_SEASONAL) + """,
st AS MATERIALIZED (SELECT b.symbol, b.ts, b.i, x.t, x.s, x.y - x.s - x.t AS r FROM b LEFT JOIN st_x AS x USING (symbol, i)),
st_v AS (SELECT symbol, 1 - var_samp(r) / nullif(var_samp(s + r), 0) AS ss, 1 - var_samp(r) / nullif(var_samp(t + r), 0) AS tt FROM st GROUP BY 1)"""


def mstl_parts(bars: str, periods: tuple[int, ...] = (24, PERIOD), passes: int = 2) -> str:
    """CTE ``ms`` (symbol, ts, t, s<period>, r): the seasons in turn, each from what the others leave."""
    out = bars + f",\nms_y AS MATERIALIZED (SELECT symbol, i, n, close AS y FROM b WHERE n >= {2 * max(periods)})"
    rest, last = "ms_y", {}
    for turn in range(passes):
        for k, p in enumerate(periods):
            name = f"ms{turn}{k}"
            if p in last:
                out += f",\n{name}_a AS MATERIALIZED (SELECT r.symbol, r.i, r.n, r.y + o.s AS y FROM {rest} AS r JOIN {last[p]} AS o USING (symbol, i))"
                rest = f"{name}_a"
            out += stl(name, rest, p, 7 + 4 * (k + 1))
            out += f",\n{name}_b AS MATERIALIZED (SELECT symbol, i, n, y - s AS y FROM {name})"
            rest, last[p], trend = f"{name}_b", name, name
    seasons = "".join(f", o{p}.s AS s{p}" for p in periods)
    joins = "".join(f" LEFT JOIN {last[p]} AS o{p} USING (symbol, i)" for p in periods)
    return out + f""",
ms AS MATERIALIZED (SELECT b.symbol, b.ts, b.i, tr.t{seasons}, re.y - tr.t AS r FROM b LEFT JOIN {rest} AS re USING (symbol, i)
  LEFT JOIN {trend} AS tr USING (symbol, i){joins})"""
