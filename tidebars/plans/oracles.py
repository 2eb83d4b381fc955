"""The same queries as plain SQL over whole tables, for comparison on a small scale."""

from __future__ import annotations

import math

from tidebars.plans.oracles_stl import mstl_parts, stl_parts

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close,
    CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume
  FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n, (high + low + close) / 3 AS tp FROM bars)"""
BARS_1M = BARS.replace("'hour'", "'minute'")
DAILY = """b AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
    first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
    count(*)::BIGINT AS volume
  FROM orders GROUP BY 1, 2)"""
DIRTY = (
    BARS
    + """,
dirty AS (
  SELECT symbol, CASE WHEN i % 20 = 7 THEN lag(ts) OVER (PARTITION BY symbol ORDER BY i) ELSE ts END AS ts,
    i AS seq, i,
    CASE WHEN i % 10 = 3 OR i < 2 OR i % 25 = 12 THEN NULL WHEN i % 100 = 41 THEN 0 ELSE open * (CASE WHEN i % 33 = 5 THEN 10 ELSE 1 END) END AS open,
    CASE WHEN i % 10 = 3 OR i % 25 = 14 THEN NULL WHEN i % 40 = 21 THEN open * 0.9::DOUBLE WHEN i % 100 = 71 THEN -high
      ELSE high * (CASE WHEN i % 33 = 5 THEN 10 ELSE 1 END) END AS high,
    CASE WHEN i % 10 = 3 OR i % 25 = 16 THEN NULL WHEN i % 40 = 11 THEN open * 1.1::DOUBLE WHEN i % 100 = 81 THEN 0
      ELSE low * (CASE WHEN i % 33 = 5 THEN 10 ELSE 1 END) END AS low,
    CASE WHEN i % 10 = 3 OR i < 3 THEN NULL WHEN i % 50 = 29 THEN 0
      ELSE close * (CASE WHEN i % 33 = 5 THEN 10 ELSE 1 END) END AS close,
    CASE WHEN i % 10 = 3 OR i % 25 = 18 THEN NULL WHEN i % 50 = 19 THEN -volume
      WHEN i % 50 = 9 THEN volume * 50
      WHEN i % 200 = 130 THEN volume * 1000000000 ELSE volume END AS volume
  FROM b)"""
)
O = ["open", "high", "low", "close"]
OV = [*O, "volume"]


def w(first: str, last: str = "CURRENT ROW", order: str = "i", by: str = "symbol") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {first} AND {last})"


def last_n(n: int) -> str:
    return w(f"{n - 1} PRECEDING")


def prior_n(n: int) -> str:
    return w(f"{n} PRECEDING", "1 PRECEDING")


def roll(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {last_n(n)} = {n} THEN {agg}({x}) {last_n(n)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY i))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def pct(a: str, b: str) -> str:
    return f"(({div(a, b)} - 1) * 100)"


def out(cols: dict[str, str] | list[str], source: str, dp: int = 6, keys="symbol, ts", raw=(), where="") -> str:
    """SELECT keys, rounded columns (``raw`` ones as they are)."""
    if not isinstance(cols, dict):
        cols = {n: f'"{n}"' for n in cols}
    parts = [keys] if keys else []
    for name, x in cols.items():
        parts.append(f'{x} AS "{name}"' if name in raw else f'round(CAST({x} AS DOUBLE), {dp}) + 0.0 AS "{name}"')
    return f"SELECT {', '.join(parts)} FROM {source} {where}"


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ORACLES: dict[str, str] = {}
BARS_OUT = out(OV, "b", raw=["volume"])


# ---- sources ----------------------------------------------------------------

for _k in ("s01_read_bars", "s02_lower_names", "s08_write_processed", "s10_bars_1h"):
    ORACLES[_k] = sql(BARS, BARS_OUT)
# Bid = p - 0.00003 and ask = p + 0.00006; the mid is rounded half-even at five places.
# Mid of bid = p - 0.00003 and ask = p + 0.00006, half-even at five places.
ORACLES["s03_broker_json"] = sql(
    BARS,
    # p has two decimals, so p + 0.000015 is a tie between p + 0.00001 and p + 0.00002:
    # half-even takes the even last digit, 2.
    out({**{n: f"CAST(CAST({n} AS DECIMAL(20,5)) + 0.00002 AS DOUBLE)" for n in O}, "volume": "volume"}, "b", raw=["volume"]),
)
ORACLES["s04_equity_json"] = sql(
    BARS,
    out({**{n: n for n in O}, "volume": "CASE WHEN hour(ts) % 7 = 3 THEN 0 ELSE volume END"}, "b", raw=["volume"]),
)
ORACLES["s05_concat_chunks"] = sql(
    BARS,
    out(
        {**{n: n for n in ["open", "high", "low"]}, "close": "CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN close + 1 ELSE close END", "volume": "volume"},
        "b",
        raw=["volume"],
    ),
)
RANGES = BARS + """,
r AS (SELECT symbol, epoch_us(min(ts)) AS f, epoch_us(max(ts)) + 40 * 3600000000 AS t FROM b GROUP BY 1),
plan AS (SELECT symbol, f, t, k AS chunk, f + k * 30000000000 AS cs, least(f + (k + 1) * 30000000000, t) AS ce
  FROM r, unnest(range(0, CAST(floor((t - f - 1) / 30000000000) AS BIGINT) + 1)) AS u(k)),
held AS (SELECT symbol, f, CAST(floor((epoch_us(ts) - f) / 30000000000) AS BIGINT) AS chunk, count(*) AS n,
  min(ts) AS first_ts, max(ts) AS last_ts FROM b JOIN r USING (symbol) WHERE epoch_us(ts) >= f AND epoch_us(ts) < t GROUP BY 1, 2, 3),
cover AS (SELECT symbol, make_timestamp(f) AS from_ts, chunk, make_timestamp(cs) AS chunk_start, make_timestamp(ce) AS chunk_end,
  coalesce(n, 0) AS n_points, first_ts, last_ts, n IS NOT NULL AS ok FROM plan LEFT JOIN held USING (symbol, f, chunk))"""
ORACLES["s06_chunk_plan"] = sql(RANGES, "SELECT symbol, from_ts, chunk, chunk_start, chunk_end FROM cover")
ORACLES["s07_coverage"] = sql(RANGES, "SELECT * FROM cover")
ORACLES["s07_coverage_summary"] = sql(
    RANGES,
    "SELECT symbol, count(*) FILTER (ok) AS successful_chunks, count(*) FILTER (NOT ok) AS failed_chunks, "
    "CAST(sum(n_points) AS BIGINT) AS total_points, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM cover GROUP BY 1",
)
TWO_RANGES = RANGES.replace(
    "plan AS (",
    "r2 AS (SELECT symbol, f, CAST(floor((f + t) / 2) AS BIGINT) AS t FROM r UNION ALL SELECT symbol, CAST(floor((f + t) / 2) AS BIGINT), t FROM r),\nplan AS (",
).replace("FROM r, unnest", "FROM r2, unnest").replace("JOIN r USING", "JOIN r2 USING")
ORACLES["s07_coverage_two_ranges"] = sql(TWO_RANGES, "SELECT * FROM cover")
ORACLES["s09_dataset_names"] = sql(
    DAILY,
    "SELECT symbol, 'raw_' || regexp_replace(symbol, '[^0-9A-Za-z_]', '_', 'g') || '_d_' || strftime(min(ts), '%Y%m%d') || '_' "
    "|| strftime(max(ts), '%Y%m%d') || '.parquet' AS dataset FROM b GROUP BY 1",
)
ORACLES["s10_bars_1m"] = sql(BARS_1M, BARS_OUT)
ORACLES["s10_coarser_bars"] = sql(
    BARS,
    "SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, first(open ORDER BY ts) AS open, "
    "max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM b GROUP BY 1, 2",
)
ORACLES["s11_accounts"] = "SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS account_name, round(c_acctbal, 2) AS available FROM customer"
ORACLES["s11_account_by_name"] = ORACLES["s11_accounts"] + " WHERE c_name = 'Customer#000000042'"
ORACLES["s12_deals"] = "SELECT o_custkey, 'D' || o_orderkey AS deal_id FROM orders WHERE o_orderkey % 5 <> 0"
ORACLES["s12_deal_counts"] = "SELECT o_custkey, count(*) AS n_deals FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1"
ORACLES["s13_json_key"] = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"
ORACLES["s14_landed_responses"] = sql(
    BARS,
    "SELECT symbol, symbol AS instrument, 'HOUR' AS resolution, date_trunc('day', ts)::TIMESTAMP AS from_ts, count(*) AS n_points, true AS ok "
    "FROM b GROUP BY symbol, date_trunc('day', ts)",
)

# ---- cleaning ---------------------------------------------------------------

UP, DOWN, BEFORE = w("UNBOUNDED PRECEDING"), w("CURRENT ROW", "UNBOUNDED FOLLOWING"), w("UNBOUNDED PRECEDING", "1 PRECEDING")


def near(x: str) -> str:
    """Previous and next known value and place of x, for the next CTE to use."""
    at = f"CASE WHEN {x} IS NOT NULL THEN i END"
    return (
        f"last_value({x} IGNORE NULLS) {UP} AS {x}_pv, last_value({at} IGNORE NULLS) {UP} AS {x}_pi, "
        f"first_value({x} IGNORE NULLS) {DOWN} AS {x}_nv, first_value({at} IGNORE NULLS) {DOWN} AS {x}_ni"
    )


def lerp(x: str) -> str:
    return f"coalesce({x}, {x}_pv + ({x}_nv - {x}_pv) * (i - {x}_pi) / nullif({x}_ni - {x}_pi, 0), {x}_pv)"


FILLED = (
    DIRTY
    + f""",
f1 AS (SELECT * REPLACE (CAST(last_value(close IGNORE NULLS) {UP} AS DOUBLE) AS close,
    coalesce(open, last_value(close IGNORE NULLS) {BEFORE}) AS open, CAST(volume AS DOUBLE) AS volume) FROM dirty),
f2 AS (SELECT *, {near("open")} FROM f1),
f3 AS (SELECT symbol, ts, seq, i, {lerp("open")} AS open, high, low, close, volume FROM f2),
f4 AS (SELECT * REPLACE (coalesce(high, greatest(open, close)) AS high, coalesce(low, least(open, close)) AS low) FROM f3),
f5 AS (SELECT *, {near("high")}, {near("low")} FROM f4),
f6 AS (SELECT symbol, ts, seq, i, open, {lerp("high")} AS high, {lerp("low")} AS low, close, volume FROM f5),
f7 AS (SELECT * REPLACE (CASE WHEN volume IS NULL AND high = low THEN 0 ELSE volume END AS volume) FROM f6),
f8 AS (SELECT *, {near("volume")} FROM f7),
filled AS (SELECT symbol, ts, seq, i, open, high, low, close, coalesce({lerp("volume")}, volume_nv, 0) AS volume FROM f8)"""
)


def gapless(src: str, cols: list[str] = OV) -> str:
    """CTEs that put ``src`` (unique stamps) on its grid as ``grid_out``."""
    prices = [x for x in cols if x != "volume"]
    fill = ", ".join(f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {x}" for x in prices)
    return f""",
st AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS step FROM {src}),
md AS (SELECT symbol, first(step ORDER BY c DESC, step) AS iv, max(step) AS big FROM
  (SELECT symbol, step, count(*) AS c FROM st WHERE step IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
sp AS (SELECT symbol, epoch_us(min(ts)) AS s, epoch_us(max(ts)) AS e FROM {src} GROUP BY 1),
gr AS (SELECT symbol, make_timestamp(u.t) AS ts FROM sp JOIN md USING (symbol), unnest(range(s, e + 1, iv)) AS u(t) WHERE big > iv * 1.5
  UNION ALL SELECT symbol, ts FROM {src} JOIN md USING (symbol) WHERE NOT big > iv * 1.5),
gj AS (SELECT gr.symbol, gr.ts, {", ".join(cols)} FROM gr LEFT JOIN {src} AS x ON x.symbol = gr.symbol AND x.ts = gr.ts),
grid_out AS (SELECT symbol, ts, {fill}, coalesce(volume, 0) AS volume FROM gj)"""


def bounds(src: str, prices: list[str] = O) -> str:
    q = ", ".join(
        f"quantile_cont({x}, 0.25) AS {x}_1, quantile_cont({x}, 0.75) AS {x}_3" for x in prices
    )
    b = ", ".join(
        f"{x}_1 - 2 * ({x}_3 - {x}_1) AS {x}_low, {x}_3 + 2 * ({x}_3 - {x}_1) AS {x}_high" for x in prices
    )
    pv = "CASE WHEN volume > 0 THEN CAST(volume AS DOUBLE) END"
    return f""",
q AS (SELECT symbol, {q}, quantile_cont({pv}, 0.25) AS v1, quantile_cont({pv}, 0.75) AS v3,
  avg(ln(1 + {pv})) AS m, stddev_samp(ln(1 + {pv})) AS sd FROM {src} GROUP BY 1),
bd AS (SELECT symbol, {b}, least(v3 + 3 * (v3 - v1), exp(m + 2.5 * sd) - 1) AS volume_cap FROM q)"""


def capped(src: str, prices: list[str] = O) -> str:
    p = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {x}_low), {x}_high) END AS {x}" for x in prices)
    return (
        bounds(src, prices)
        + f""",
cap AS (SELECT symbol, ts, {p}, CASE WHEN volume > 0 THEN CAST(trunc(least(CAST(volume AS DOUBLE), volume_cap)) AS BIGINT)
  WHEN volume IS NOT NULL THEN 0 END AS volume FROM {src} JOIN bd USING (symbol))"""
    )


REPAIR = {
    "open": "open",
    "high": "greatest(high, open, close)",
    "low": "least(low, open, close)",
    "close": "close",
    "volume": "CASE WHEN volume < 0 THEN 0 ELSE volume END",
}
ORACLES["c01a_null_tokens"] = sql(
    BARS,
    "SELECT symbol, ts, CASE WHEN hour(ts) NOT IN (1, 2, 3) THEN round(close, 6) END AS close, "
    "CASE WHEN hour(ts) <> 4 THEN CAST(volume AS DOUBLE) END AS volume FROM b",
)
ORACLES["c01_fill_missing"] = sql(FILLED, out(OV, "filled", keys="symbol, seq"))
ORACLES["c01f_interpolate"] = sql(
    DIRTY + f",\nn1 AS (SELECT *, {', '.join(near(x) for x in OV)} FROM dirty)",
    out({x: lerp(x) for x in OV}, "n1", keys="symbol, seq"),
)
ORACLES["c02_drop_duplicates"] = sql(
    DIRTY,
    "SELECT symbol, ts, min(seq) AS seq, round(arg_min_null(close, seq), 6) + 0.0 AS close FROM dirty GROUP BY 1, 2",
)
ORACLES["c02_null_order"] = sql(
    DIRTY,
    """SELECT symbol, ts, seq, round(CAST(close AS DOUBLE), 6) + 0.0 AS close, round(CAST(open AS DOUBLE), 6) + 0.0 AS open
FROM (SELECT * REPLACE (CASE WHEN seq % 20 <> 6 THEN seq END AS seq) FROM dirty)
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq NULLS LAST, close NULLS FIRST, open NULLS FIRST) = 1""",
)
ORACLES["c03_timestamps"] = (
    "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN date_trunc('second', ts) END AS ts FROM events"
)
ORACLES["c04_fill_gaps"] = sql(BARS + gapless("b"), out(OV, "grid_out", raw=["volume"]))
OFF_GRID = BARS + """,
og AS (SELECT * REPLACE (CASE WHEN i % 50 = 49 THEN ts + INTERVAL 17 MINUTES ELSE ts END AS ts) FROM b)""" + gapless("og")
ORACLES["c04_off_grid"] = sql(OFF_GRID, out(OV, "grid_out", raw=["volume"]))
ORACLES["c04_off_grid_counts"] = sql(
    OFF_GRID,
    """SELECT symbol, iv AS interval_us, count(*) AS n_rows,
  count(*) FILTER (big > iv * 1.5 AND (epoch_us(ts) - s) % iv <> 0) AS n_off_grid,
  CASE WHEN max(big) > max(iv) * 1.5 THEN CAST(floor((max(e) - max(s)) / max(iv)) AS BIGINT) + 1 - count(*) FILTER ((epoch_us(ts) - s) % iv = 0) ELSE 0 END AS n_added
FROM og JOIN md USING (symbol) JOIN sp USING (symbol) GROUP BY 1, 2""",
)
ORACLES["c04_bar_interval"] = sql(
    BARS + gapless("b"),
    "SELECT symbol, iv AS interval_us, big AS largest_us, make_timestamp(s) AS first_ts, make_timestamp(e) AS last_ts FROM md JOIN sp USING (symbol)",
)
ORACLES["c05_outlier_bounds"] = sql(
    BARS + bounds("b"),
    out([f"{x}_{e}" for x in O for e in ("low", "high")] + ["volume_cap"], "bd", 4, "symbol"),
)
ORACLES["c05_cap_outliers"] = sql(BARS + capped("b"), out(OV, "cap", raw=["volume"]))
ORACLES["c06_types"] = sql(
    BARS, out({**{n: n for n in O}, "volume": "CASE WHEN volume % 2 = 0 THEN volume ELSE volume + 1 END"}, "b", raw=["volume"])
)
ORACLES["c07_repair_ohlc"] = sql(DIRTY, out(REPAIR, "dirty", keys="symbol, seq", raw=["volume"]))
ORACLES["c07_repair_counts"] = sql(
    DIRTY,
    "SELECT symbol, count(*) FILTER (high < greatest(open, close)) AS high_below, count(*) FILTER (low > least(open, close)) AS low_above, "
    "count(*) FILTER (volume < 0) AS negative_volume, CAST(0 AS BIGINT) AS remaining FROM dirty GROUP BY 1",
)
_partial = (
    DIRTY
    + f""",
p1 AS (SELECT symbol, ts, i, CAST(last_value(close IGNORE NULLS) {UP} AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM dirty),
p2 AS (SELECT *, {near("volume")} FROM p1),
p3 AS (SELECT symbol, ts, i, close, coalesce({lerp("volume")}, volume_nv, 0) AS volume FROM p2),
p4 AS (SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY i) = 1)"""
    + gapless("p4", ["close", "volume"])
    + capped("grid_out", ["close"])
)
ORACLES["c08_partial_columns"] = sql(_partial, out(["close", "volume"], "cap", raw=["volume"]))
CLEAN = (
    FILLED
    + ",\nded AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY i) = 1)"
    + gapless("ded")
    + capped("grid_out")
)
ORACLES["c09_clean"] = sql(CLEAN, out(REPAIR, "cap", raw=["volume"]))

# ---- validation -------------------------------------------------------------

FOUND = (
    DIRTY
    + """,
vs AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY i)) AS step,
  abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY i), 0) - 1) AS move FROM dirty),
vm AS (SELECT symbol, first(step ORDER BY c DESC, step) AS iv FROM (SELECT symbol, step, count(*) AS c FROM vs WHERE step IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
vl AS (SELECT symbol, avg(ln(1 + volume)) + 6 * stddev_samp(ln(1 + volume)) AS lim FROM dirty WHERE volume > 0 GROUP BY 1),
vx AS (SELECT * FROM vs JOIN vm USING (symbol) JOIN vl USING (symbol)),
found AS (
  SELECT symbol, ts, 'high_below' AS code, NULL::DOUBLE AS gap FROM vx WHERE high < greatest(open, close)
  UNION ALL SELECT symbol, ts, 'low_above', NULL FROM vx WHERE low > least(open, close)
  UNION ALL SELECT symbol, ts, 'open_price', NULL FROM vx WHERE open <= 0
  UNION ALL SELECT symbol, ts, 'high_price', NULL FROM vx WHERE high <= 0
  UNION ALL SELECT symbol, ts, 'low_price', NULL FROM vx WHERE low <= 0
  UNION ALL SELECT symbol, ts, 'close_price', NULL FROM vx WHERE close <= 0
  UNION ALL SELECT symbol, ts, 'duplicate', NULL FROM vx WHERE step = 0
  UNION ALL SELECT symbol, ts, 'gap', step / 1e6::DOUBLE FROM vx WHERE step > 3 * iv
  UNION ALL SELECT symbol, ts, 'future', NULL FROM vx WHERE ts > TIMESTAMP '2024-01-20'
  UNION ALL SELECT symbol, ts, 'negative_volume', NULL FROM vx WHERE volume < 0
  UNION ALL SELECT symbol, ts, 'high_volume', NULL FROM vx WHERE volume > 0 AND ln(1 + volume) > lim
  UNION ALL SELECT symbol, ts, 'move', NULL FROM vx WHERE move > 0.5)"""
)
ORACLES["v01_affected_rows"] = sql(FOUND, "SELECT symbol, ts, code, gap AS gap_seconds FROM found")
_texts = {
    "high_below": ("OHLC Relationship", "Found # records where high < max(open, close)"),
    "low_above": ("OHLC Relationship", "Found # records where low > min(open, close)"),
    "open_price": ("Invalid Prices", "Found # records with open <= 0"),
    "high_price": ("Invalid Prices", "Found # records with high <= 0"),
    "low_price": ("Invalid Prices", "Found # records with low <= 0"),
    "close_price": ("Invalid Prices", "Found # records with close <= 0"),
    "duplicate": ("Duplicate Timestamps", "Found # duplicate timestamps"),
    "gap": ("Time Series Gaps", "Found # large gaps in time series"),
    "future": ("Future Timestamps", "Found # records with future timestamps"),
    "negative_volume": ("Invalid Volume", "Found # records with negative volume"),
    "high_volume": ("Suspicious Volume", "Found # records with extremely high volume"),
    "move": ("Extreme Price Movement", "Found # records with >50% price moves"),
}
_kind = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _texts.items()) + " END"
_said = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _texts.items()) + " END"
ORACLES["v01_issues"] = sql(
    FOUND,
    f"SELECT symbol, code, {_kind} AS issue_type, replace({_said}, '#', CAST(count(*) AS VARCHAR)) AS description, count(*) AS n_rows, "
    "min(ts) AS first_ts, max(ts) AS last_ts FROM found GROUP BY symbol, code",
)
ORACLES["v04_unreadable_timestamps"] = "SELECT event_id, 'soon' AS ts FROM events WHERE event_id % 7 = 0"
ORACLES["v11_missing_columns"] = sql(
    DAILY,
    "SELECT symbol, 'missing_columns' AS code, 'Missing Required Columns' AS issue_type, 'Missing columns: open, high, low' AS description, "
    "count(*) AS n_rows FROM b GROUP BY 1",
)
ORACLES["v12_few_rows"] = sql(
    BARS,
    "SELECT symbol, 'few_rows' AS code, 'Insufficient Data' AS issue_type, 'Only ' || count(DISTINCT k) || ' data points available, minimum 30 required' AS description, "
    "count(DISTINCT k) AS n_rows FROM (SELECT symbol, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS k FROM b) GROUP BY 1 HAVING count(DISTINCT k) < 30",
)
CALM = """,
b2 AS (SELECT symbol, ts, open, high, low, close, volume, i FROM b UNION ALL
  SELECT 'calm', TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)), 100.0 + k % 5, 102.0 + k % 5, 98.0 + k % 5, 101.0 + k % 5, 1000 + k, k FROM range(60) AS u(k))"""
ORACLES["v13_verdict"] = sql(
    FOUND.replace(DIRTY, DIRTY + CALM).replace("FROM dirty", "FROM b2").replace("  UNION ALL SELECT symbol, ts, 'future', NULL FROM vx WHERE ts > TIMESTAMP '2024-01-20'\n", ""),
    "SELECT symbol, n_issues = 0 AS is_valid, n_issues FROM (SELECT symbol, (SELECT count(DISTINCT code) FROM found WHERE found.symbol = s.symbol) "
    "+ CASE WHEN count(*) < 30 THEN 1 ELSE 0 END AS n_issues FROM b2 AS s GROUP BY symbol)",
)

# ---- features ---------------------------------------------------------------


def feature(name: str, exprs: dict[str, str], ctes: str = "", source: str = "b", raw=()) -> None:
    ORACLES[name] = sql(BARS + ctes, out(exprs, source, raw=raw))


feature("f01_sma", {f"sma_{n}": roll("avg", "close", n) for n in (5, 10, 20, 50, 200)})
feature("f03_rate_of_change", {f"roc_{n}": pct("close", lag("close", n)) for n in (1, 5, 10, 20, 60)})
_bb = f",\nx AS (SELECT *, {roll('stddev_samp', 'close', 20)} AS sd, {roll('avg', 'close', 20)} AS m FROM b)"
feature(
    "f05_bollinger",
    {"std": "sd", "sma_20": "m", "upper_band": "m + 2 * sd", "lower_band": "m - 2 * sd", "bb_width": div("(m + 2 * sd) - (m - 2 * sd)", "m")},
    _bb,
    "x",
)
feature(
    "f06_support_resistance",
    {"distance_from_high": pct("close", roll("max", "high", 20)), "distance_from_low": pct("close", roll("min", "low", 20))},
)
feature(
    "f07_volume_averages",
    {
        k: v
        for n in (7, 15, 30, 60)
        for k, v in ((f"vma_{n}", roll("avg", "volume", n)), (f"relative_volume_{n}", div("volume", roll("avg", "volume", n))))
    },
)
feature("f08_volume_roc", {f"vroc_{n}": pct("volume", lag("volume", n)) for n in (1, 5, 10, 20)})
_sg = ",\nx AS (SELECT *, volume * sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY i)) AS sv FROM b)"
feature("f09_obv", {"obv": f"sum(sv) {UP}"}, _sg, "x")
PROFILE = f""",
p AS (SELECT symbol, ts, i, close, {roll("min", "low", 20)} AS lo, {roll("max", "high", 20)} AS hi FROM b),
q AS (SELECT *, (hi - lo) / 10 AS step FROM p WHERE i >= 20 AND hi > lo),
x AS (SELECT q.symbol, q.i, greatest(0, least(9, CAST(floor((v.tp - q.lo) / q.step) AS INTEGER))) AS bin,
  v.volume * (1 + 0.1::DOUBLE * ((v.i - (q.i - 20)) / 20.0::DOUBLE)) AS wt
  FROM q JOIN b AS v ON v.symbol = q.symbol AND v.i BETWEEN q.i - 20 AND q.i - 1),
s AS (SELECT symbol, i, bin, sum(wt) AS v FROM x GROUP BY ALL),
g AS (SELECT q.symbol, q.i, k.k AS bin, coalesce(s.v, 0) AS v FROM q CROSS JOIN (SELECT unnest(range(10)) AS k) AS k
  LEFT JOIN s ON s.symbol = q.symbol AND s.i = q.i AND s.bin = k.k),
t AS (SELECT symbol, i, bin, CASE WHEN sum(v) OVER (PARTITION BY symbol, i) > 0 THEN v / sum(v) OVER (PARTITION BY symbol, i) * 100 ELSE v END AS p FROM g),
c AS (SELECT *, sum(p / 100) OVER (PARTITION BY symbol, i ORDER BY p DESC, bin DESC ROWS UNBOUNDED PRECEDING) AS cum FROM t),
d AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY symbol, i ORDER BY p DESC, bin DESC), 0) < 0.7 AS inside FROM c),
m AS (SELECT symbol, i, {", ".join(f"max(p) FILTER (bin = {k}) AS vol_bin_{k}" for k in range(10))},
  first(bin ORDER BY p DESC, bin) AS poc, max(bin) FILTER (inside) AS vh, min(bin) FILTER (inside) AS vl,
  -sum(CASE WHEN p > 0 THEN p / 100 * ln(p / 100) ELSE 0 END) AS ent FROM d GROUP BY 1, 2),
y AS (SELECT b.symbol, b.ts, b.close, m.*, q.lo + (poc + 0.5) * q.step AS vol_poc, q.lo + (vh + 1) * q.step AS vol_va_high,
  q.lo + vl * q.step AS vol_va_low, q.hi - q.lo AS rng FROM b LEFT JOIN q ON q.symbol = b.symbol AND q.i = b.i
  LEFT JOIN m ON m.symbol = b.symbol AND m.i = b.i)"""
feature("f10_volume_profile", {f"vol_bin_{k}": f"vol_bin_{k}" for k in range(10)}, PROFILE, "y")
feature("f11_point_of_control", {"vol_poc": "vol_poc", "close_to_poc_pct": "(close - vol_poc) / vol_poc * 100"}, PROFILE, "y")
feature(
    "f12_value_area",
    {
        "vol_va_high": "vol_va_high",
        "vol_va_low": "vol_va_low",
        "vol_va_width": "(vol_va_high - vol_va_low) / rng",
        "in_value_area": "CASE WHEN close >= vol_va_low AND close <= vol_va_high THEN 1 ELSE 0 END",
    },
    PROFILE,
    "y",
    ["in_value_area"],
)
feature("f14_concentration", {"vol_concentration": "1 - coalesce(ent, 0) / ln(10)"}, PROFILE, "y")
feature("f15_vwap", {"vwap": div("volume * tp", "volume")})
_mf = f""",
x AS (SELECT *, sign(tp - {lag("tp")}) AS d FROM b),
y AS (SELECT *, CASE WHEN d > 0 THEN volume * tp ELSE 0 END AS pos, CASE WHEN d < 0 THEN volume * tp ELSE 0 END AS neg FROM x),
z AS (SELECT *, {roll("sum", "pos", 14)} AS ps, {roll("sum", "neg", 14)} AS ns FROM y)"""
feature("f16_mfi", {"mfi": "CASE WHEN ps IS NOT NULL THEN 100 - 100 / (1 + coalesce(ps / nullif(ns, 0), 0)) END"}, _mf, "z")


def recursive(first: str, step: str) -> str:
    """A recursive CTE ``e`` along each symbol: state of row 0, and of row i from row i-1."""
    return f""",
pb AS MATERIALIZED (SELECT *, close - lag(close) OVER s AS dc, high - lag(high) OVER s AS dh, lag(low) OVER s - low AS dl,
  greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr
  FROM b WINDOW s AS (PARTITION BY symbol ORDER BY i)),
e AS (SELECT symbol, i, {first} FROM pb WHERE i = 0 UNION ALL
  SELECT x.symbol, x.i, {step} FROM e JOIN pb AS x ON x.symbol = e.symbol AND x.i = e.i + 1)"""


def rec_feature(name: str, exprs: dict[str, str], first: str, step: str, more: str = "", source: str = "") -> None:
    ctes = BARS + recursive(first, step) + more
    source = source or "b JOIN e USING (symbol, i)"
    ORACLES[name] = "WITH RECURSIVE " + ctes + "\n" + out(exprs, source)


def _ema(s: str, x: str, n: int) -> str:
    return f"e.{s} + {2 / (n + 1)!r}::DOUBLE * ({x} - e.{s})"


_spans = (5, 10, 20, 50, 200)
rec_feature(
    "f02_ema",
    {f"ema_{n}": f"CASE WHEN i >= {n - 1} THEN s{n} END" for n in _spans},
    ", ".join(f"close AS s{n}" for n in _spans),
    ", ".join(_ema(f"s{n}", "x.close", n) for n in _spans),
)
rec_feature("f04_atr", {"atr": "a"}, "tr AS a", _ema("a", "x.tr", 14))
_line = f"(({_ema('f', 'x.close', 12)}) - ({_ema('s', 'x.close', 26)}))"
rec_feature(
    "f18_macd",
    {"macd_line": "f - s", "macd_signal": "g", "macd_histogram": "(f - s) - g"},
    "close AS f, close AS s, 0.0::DOUBLE AS g",
    f"{_ema('f', 'x.close', 12)}, {_ema('s', 'x.close', 26)}, {_ema('g', _line, 9)}",
)


def _wilder(s: str, x: str) -> str:
    """Sum until row 12, mean of 14 at row 13, Wilder's mean after."""
    return f"CASE WHEN x.i < 13 THEN e.{s} + {x} WHEN x.i = 13 THEN (e.{s} + {x}) / 14 ELSE (e.{s} * 13 + {x}) / 14 END"


_gain, _loss = "greatest(x.dc, 0)", "greatest(-x.dc, 0)"
rec_feature(
    "f17_rsi",
    {"rsi_14": "CASE WHEN i >= 13 THEN CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END END"},
    "0.0::DOUBLE AS g, 0.0::DOUBLE AS l",
    f"{_wilder('g', _gain)}, {_wilder('l', _loss)}",
)
_pdm = "CASE WHEN x.dh > x.dl AND x.dh > 0 THEN x.dh ELSE 0 END"
_mdm = "CASE WHEN x.dl > x.dh AND x.dl > 0 THEN x.dl ELSE 0 END"
_ADX = (
    recursive(
        "tr AS t, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m",
        f"{_wilder('t', 'x.tr')}, {_wilder('p', _pdm)}, {_wilder('m', _mdm)}",
    )
    + f""",
di AS (SELECT b.*, CASE WHEN i >= 13 THEN 100 * (p / nullif(t, 0)) END AS pdi, CASE WHEN i >= 13 THEN 100 * (m / nullif(t, 0)) END AS mdi
  FROM b JOIN e USING (symbol, i)),
dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di),
ax AS (SELECT *, {roll("avg", "dx", 14)} AS adx FROM dx)"""
)
ORACLES["f19_adx"] = "WITH RECURSIVE " + BARS + _ADX + "\n" + out({"+di": "pdi", "-di": "mdi", "adx": "adx"}, "ax")
_st = f""",
x AS (SELECT *, coalesce(100 * (close - {roll("min", "low", 14)}) / nullif({roll("max", "high", 14)} - {roll("min", "low", 14)}, 0), 50) AS fast FROM b),
y AS (SELECT *, {roll("avg", "fast", 3)} AS k FROM x)"""
feature("f20_stochastic", {"stoch_k": "k", "stoch_d": roll("avg", "k", 3)}, _st, "y")
_cci = f""",
x AS (SELECT *, tp - {roll("avg", "tp", 20)} AS o FROM b), y AS (SELECT *, abs(o) AS ao FROM x)"""
feature("f21_cci", {"cci": div("o", f"0.015::DOUBLE * {roll('avg', 'ao', 20)}")}, _cci, "y")


def _mid_of(n: int) -> str:
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


_ich = f",\nx AS (SELECT *, {_mid_of(9)} AS te, {_mid_of(26)} AS ki, {_mid_of(52)} AS sb, lead(close, 26) OVER (PARTITION BY symbol ORDER BY i) AS ch FROM b)"
feature(
    "f22_ichimoku",
    {
        "ichimoku_tenkan": "te",
        "ichimoku_kijun": "ki",
        "ichimoku_senkou_a": lag("(te + ki) / 2", 26),
        "ichimoku_senkou_b": lag("sb", 26),
        "ichimoku_chikou": "ch",
    },
    _ich,
    "x",
)
_tau = f"{2 * math.pi!r}::DOUBLE"


def _cyc(name: str, share: str) -> dict[str, str]:
    return {f"{name}_sin": f"sin({_tau} * ({share}))", f"{name}_cos": f"cos({_tau} * ({share}))"}


_session = "CASE WHEN hour(ts) <= 6 THEN 'asian_session' WHEN hour(ts) <= 14 THEN 'european_session' ELSE 'us_session' END"
feature("f23_time_of_day", {**_cyc("hour", "hour(ts) / 24"), "session": _session}, raw=["session"])
feature("f24_day_of_week", _cyc("day_of_week", "(isodow(ts) - 1) / 7"))
feature(
    "f25_time_of_week",
    {**_cyc("hour_of_week", "((isodow(ts) - 1) * 24 + hour(ts)) / 168"), "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END"},
    raw=["is_weekend"],
)
_share = "day(ts) / day(last_day(ts))"
feature(
    "f26_time_of_month",
    {
        **_cyc("month_progress", _share),
        "month_period": f"CASE WHEN {_share} <= 0.33 THEN 'start_of_month' WHEN {_share} <= 0.66 THEN 'mid_month' ELSE 'end_of_month' END",
        **_cyc("month_of_year", "month(ts) / 12"),
    },
    raw=["month_period"],
)
_SEAS = f""",
x AS (SELECT *, CASE WHEN i >= 80 AND i < n - 80 AND n >= 320 THEN (sum(close) {w("80 PRECEDING", "80 FOLLOWING")}
  - 0.5::DOUBLE * (lag(close, 80) OVER (PARTITION BY symbol ORDER BY i) + lead(close, 80) OVER (PARTITION BY symbol ORDER BY i))) / 160 END AS mid FROM b),
ends AS (SELECT symbol, regr_slope(mid, i) FILTER (i >= 80 AND i < least(240, n - 81)) AS hs, regr_intercept(mid, i) FILTER (i >= 80 AND i < least(240, n - 81)) AS hi,
  regr_slope(mid, i) FILTER (i >= greatest(80, n - 241) AND i < n - 81) AS ts_, regr_intercept(mid, i) FILTER (i >= greatest(80, n - 241) AND i < n - 81) AS ti FROM x GROUP BY 1),
y AS (SELECT x.*, coalesce(mid, CASE WHEN i < 80 THEN hs * i + hi ELSE ts_ * i + ti END) AS t FROM x JOIN ends USING (symbol)),
ph AS (SELECT symbol, i % 160 AS k, avg(close - t) AS a FROM y GROUP BY 1, 2),
pc AS (SELECT symbol, k, a - avg(a) OVER (PARTITION BY symbol) AS s FROM ph),
z AS (SELECT y.*, s FROM y JOIN pc ON pc.symbol = y.symbol AND pc.k = y.i % 160)"""
feature(
    "f27_seasonal",
    {
        "seasonal_trend": "t + 1e-9::DOUBLE",
        "seasonal_seasonal": "s + 1e-9::DOUBLE",
        "seasonal_residual": "close - t - s + 1e-9::DOUBLE",
        "seasonal_norm": f"{div('s', 'close')} + 1e-9::DOUBLE",
    },
    _SEAS,
    "z",
)


def holidays(first: int = 1990, last: int = 2010) -> str:
    """Dates of US holidays of these years and the weekdays that observe the fixed ones."""
    fixed = [("01", "01", 0), ("06", "19", 2021), ("07", "04", 0), ("11", "11", 0), ("12", "25", 0)]
    days = f"SELECT CAST(d AS DATE) AS d FROM unnest(generate_series(DATE '{first}-01-01', DATE '{last}-12-31', INTERVAL 1 DAY)) AS u(d)"
    parts = []
    for m, d, since in fixed:
        on = f"make_date(y, {int(m)}, {int(d)})"
        parts.append(
            f"SELECT {on} AS h FROM (SELECT unnest(range({first - 1}, {last + 3})) AS y) WHERE y >= {since} UNION "
            f"SELECT CASE isodow({on}) WHEN 6 THEN {on} - 1 WHEN 7 THEN {on} + 1 ELSE {on} END FROM (SELECT unnest(range({first - 1}, {last + 3})) AS y) WHERE y >= {since}"
        )
    floating = (
        "SELECT d AS h FROM days WHERE (isodow(d) = 1 AND ((month(d) = 1 AND day(d) BETWEEN 15 AND 21 AND year(d) >= 1986) OR (month(d) = 2 AND day(d) BETWEEN 15 AND 21 AND year(d) >= 1971) "
        "OR (month(d) = 5 AND day(d) > 24) OR (month(d) = 9 AND day(d) <= 7) OR (month(d) = 10 AND day(d) BETWEEN 8 AND 14))) "
        "OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28)"
    )
    return f"days AS ({days}), hol AS ({' UNION '.join([*parts, floating])})"


ORACLES["f30_holidays"] = sql(
    DAILY + ", " + holidays(),
    "SELECT symbol, ts, CASE WHEN CAST(ts AS DATE) IN (SELECT h FROM hol) THEN 1 ELSE 0 END AS is_holiday, "
    "coalesce((SELECT CAST(min(h - CAST(ts AS DATE)) AS INTEGER) FROM hol WHERE h > CAST(ts AS DATE) AND h <= CAST(ts AS DATE) + 29), 0) AS days_to_next_holiday FROM b",
)
ORACLES["f28_stl"] = sql(
    stl_parts(BARS),
    out({"stl_trend": "t", "stl_seasonal": "s", "stl_residual": "r", "stl_seasonal_strength": "ss", "stl_trend_strength": "tt"}, "st JOIN st_v USING (symbol)"),
)
ORACLES["f29_mstl"] = sql(mstl_parts(BARS), out({"mstl_trend": "t", "mstl_seasonal_24": "s24", "mstl_seasonal_160": "s160", "mstl_residual": "r"}, "ms"))
ORACLES["f28_stl_sum"] = sql(BARS, out({"stl": "CASE WHEN n >= 320 THEN close END", "mstl": "CASE WHEN n >= 320 THEN close END"}, "b", 4))
_FAR = DAILY.replace("b AS (", "b0 AS (", 1) + """,
b AS (SELECT * REPLACE (symbol || ' true' AS symbol, ts + INTERVAL 200 YEARS AS ts) FROM b0 UNION ALL
  SELECT * REPLACE (symbol || ' false' AS symbol, ts - INTERVAL 250 YEARS AS ts) FROM b0)"""
ORACLES["f30_far_holidays"] = ORACLES["f30_holidays"].replace(DAILY, _FAR).replace(
    holidays(), holidays(1735, 1760).replace("days AS", "d1 AS").replace("FROM days", "FROM d1").replace("hol AS", "h1 AS")
    + ", " + holidays(2185, 2210).replace("days AS", "d2 AS").replace("FROM days", "FROM d2").replace("hol AS", "h2 AS")
    + ", hol AS (SELECT * FROM h1 UNION SELECT * FROM h2)",
)
VOL = f""",
v1 AS (SELECT *, {div("close", lag("close"))} - 1 AS ret FROM b),
v2 AS (SELECT *, {roll("stddev_samp", "ret", 20)} * sqrt(252) AS vs, {roll("stddev_samp", "ret", 100)} * sqrt(252) AS vlg FROM v1),
v3 AS (SELECT x.*, (SELECT (count(*) FILTER (h.vs < x.vs) + (count(*) FILTER (h.vs = x.vs) + 1) / 2) / 100 FROM v2 AS h
  WHERE h.symbol = x.symbol AND h.i BETWEEN x.i - 99 AND x.i HAVING count(h.vs) = 100) AS rk FROM v2 AS x),
v4 AS (SELECT *, CASE WHEN rk < 0.33 THEN 'low' WHEN rk >= 0.66 THEN 'high' ELSE 'medium' END AS vr FROM v3)"""
feature(
    "f32_volatility",
    {"returns": "ret", "volatility_short": "vs", "volatility_long": "vlg", "volatility_ratio": "vs / (vlg + 1e-8::DOUBLE)"},
    VOL,
    "v2",
)
feature("f33_two_regimes", {"volatility_regime": "r", "vol_regime_low": "r = 'low'", "vol_regime_high": "r = 'high'"},
    VOL + f", v5 AS (SELECT *, CASE WHEN vs > {roll('median', 'vs', 100)} THEN 'high' ELSE 'low' END AS r FROM v2)", "v5",
    ["volatility_regime", "vol_regime_low", "vol_regime_high"])
feature(
    "f34_volatility_regime",
    {"volatility_regime": "vr", **{f"vol_regime_{k}": f"vr = '{k}'" for k in ("low", "medium", "high")}},
    VOL,
    "v4",
    ["volatility_regime", "vol_regime_low", "vol_regime_medium", "vol_regime_high"],
)
feature(
    "f36_volatility_change",
    {
        "volatility_zscore": div(f"vs - {roll('avg', 'vs', 100)}", roll("stddev_samp", "vs", 100)),
        "volatility_change": f"ln(vs + 1e-8::DOUBLE) - {lag('ln(vs + 1e-8::DOUBLE)', 5)}",
    },
    VOL,
    "v2",
)
TREND = f""",
t1 AS (SELECT *, CASE WHEN adx > 25 THEN 'trending' ELSE 'ranging' END AS ar, {", ".join(f"{roll('avg', 'close', k)} AS m{k}" for k in (20, 50, 200))},
  CASE WHEN count(close) {prior_n(20)} = 20 THEN regr_slope(close, i) {prior_n(20)} END AS rs,
  CASE WHEN count(close) {prior_n(20)} = 20 THEN CASE WHEN max(close) {prior_n(20)} = min(close) {prior_n(20)} THEN 0 ELSE regr_r2(close, i) {prior_n(20)} END END AS r2 FROM ax),
t2 AS (SELECT *, {", ".join(f"{pct('close', f'm{k}')} AS d{k}, {pct(f'm{k}', lag(f'm{k}', 5))} AS sl{k}" for k in (20, 50, 200))} FROM t1),
t3 AS (SELECT *, CASE WHEN abs(sign(d20) * sign(d50) * sign(d200)) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS al FROM t2),
t4 AS (SELECT *, (coalesce(adx / 100, 0) + coalesce(r2, 0) + al) / (1 + CASE WHEN adx IS NULL THEN 0 ELSE 1 END + CASE WHEN r2 IS NULL THEN 0 ELSE 1 END) * 100 AS st FROM t3),
t5 AS (SELECT *, CASE WHEN st > 70 THEN 'strong_trend' WHEN st > 40 THEN 'weak_trend' ELSE 'ranging' END AS tr_ FROM t4)"""


def trend(name: str, exprs: dict[str, str], raw=(), more: str = "", source: str = "t5") -> None:
    ORACLES[name] = "WITH RECURSIVE " + BARS + _ADX + TREND + more + "\n" + out(exprs, source, raw=raw)


trend(
    "f37_adx_regime",
    {"adx_trend_regime": "ar", "adx_regime_trending": "ar = 'trending'", "adx_regime_ranging": "ar = 'ranging'"},
    ["adx_trend_regime", "adx_regime_trending", "adx_regime_ranging"],
)
trend(
    "f38_sma_distance",
    {**{f"dist_from_sma_{k}": f"d{k}" for k in (20, 50, 200)}, **{f"sma_{k}_slope": f"sl{k}" for k in (20, 50, 200)}},
)
trend("f39_ma_cross", {"ma_cross_50_200": "CASE WHEN m50 > m200 THEN 1 ELSE -1 END"}, ["ma_cross_50_200"])
trend("f40_regression", {"regression_slope": "rs", "r_squared": "r2", "norm_regression_slope": div("rs", "close")})
trend(
    "f41_trend_strength",
    {"trend_strength": "st", "trend_regime": "tr_", **{f"trend_regime_{k}": f"tr_ = '{k}'" for k in ("ranging", "weak_trend", "strong_trend")}},
    ["trend_regime", "trend_regime_ranging", "trend_regime_weak_trend", "trend_regime_strong_trend"],
)
STATE = (
    VOL
    + """,
s1 AS (SELECT v4.symbol, v4.ts, v4.i, CASE vr WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS vn,
  CASE tr_ WHEN 'ranging' THEN 0 WHEN 'weak_trend' THEN 1 ELSE 2 END AS tn, vr, tr_ FROM v4 JOIN t5 USING (symbol, i)),
s2 AS (SELECT *, vn * 3 + tn AS ms, vr || '_vol_' || tr_ AS ds FROM s1),
s3 AS (SELECT *, CASE WHEN i = 0 OR ms <> lag(ms) OVER (PARTITION BY symbol ORDER BY i) THEN 1 ELSE 0 END AS ch FROM s2),
s4 AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY i) AS isl FROM s3)"""
)
_states = [f"{v}_vol_{t}" for v in ("low", "medium", "high") for t in ("ranging", "weak_trend", "strong_trend")]
trend(
    "f42_market_state",
    {"vol_regime_num": "vn", "trend_regime_num": "tn", "market_state": "ms", "market_state_desc": "ds", **{f"state_{d}": f"coalesce(ds = '{d}', false)" for d in _states}},
    ["vol_regime_num", "trend_regime_num", "market_state", "market_state_desc", *[f"state_{d}" for d in _states]],
    STATE,
    "s4",
)
trend(
    "f43_state_duration",
    {"market_state": "ms", "state_duration": "row_number() OVER (PARTITION BY symbol, isl ORDER BY i)"},
    ["market_state", "state_duration"],
    STATE,
    "s4",
)
feature("f44_log_return", {"log_return": f"CASE WHEN {div('close', lag('close'))} > 0 THEN ln({div('close', lag('close'))}) END"})
ORACLES["f46_feature_list"] = sql(
    BARS + ",\nx AS (SELECT i, hour(ts) AS h, " + ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in _spans) + " FROM b)",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, '{t}' AS type, count({x}) AS n_known, count(*) - count({x}) AS n_null, min(i) FILTER ({x} IS NOT NULL) AS first_known FROM x"
        for n, t, x in [*[(f"sma_{n}", "double", f"sma_{n}") for n in _spans], ("hour_sin", "double", "h"), ("hour_cos", "double", "h"), ("session", "string", "h")]
    ),
)
feature(
    "f15_vwap_session",
    {"vwap_session": div("sum(volume * tp) " + w("UNBOUNDED PRECEDING", by="symbol, CAST(ts AS DATE)"), "sum(volume) " + w("UNBOUNDED PRECEDING", by="symbol, CAST(ts AS DATE)"))},
)
# The transform of returns written out: m values against (m - 1) / 2 frequencies of every symbol.
ORACLES["f45_cycles"] = sql(
    BARS + f""",
lr AS (SELECT *, CASE WHEN {div('close', lag('close'))} > 0 THEN ln({div('close', lag('close'))}) END AS x FROM b),
v AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY symbol) AS m FROM lr WHERE x IS NOT NULL),
fq AS (SELECT symbol, m, unnest(range(1, (m - 1) // 2 + 1)) AS k FROM (SELECT DISTINCT symbol, m FROM v)),
pw AS (SELECT fq.symbol, fq.m, k, sum(x * cos(2 * pi() * ((k * j) % fq.m) / fq.m)) ^ 2 + sum(x * sin(2 * pi() * ((k * j) % fq.m) / fq.m)) ^ 2 AS p
  FROM fq JOIN v ON fq.symbol = v.symbol GROUP BY 1, 2, 3),
tp5 AS (SELECT symbol, m, CAST(round_even(m / k, 0) AS INTEGER) AS period FROM (SELECT *, round(p / max(p) OVER (PARTITION BY symbol), 9) AS d FROM pw)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC, k) <= 5),
ps AS (SELECT symbol, string_agg(CAST(period AS VARCHAR), ',' ORDER BY period) AS periods FROM tp5 GROUP BY 1),
us AS (SELECT DISTINCT symbol, period FROM tp5 WHERE period >= 2 AND period <= m // 3),
cy AS (SELECT b.symbol, b.i, count(period) AS n, sum(sin(2 * pi() * b.i / period)) AS s, sum(cos(2 * pi() * b.i / period)) AS c FROM b JOIN us USING (symbol) GROUP BY 1, 2)""",
    "SELECT symbol, ts, periods, CAST(coalesce(cy.n, 0) AS INTEGER) AS n_cycles, round(coalesce(s, 0.0), 6) + 0.0 AS sin_sum, round(coalesce(c, 0.0), 6) + 0.0 AS cos_sum "
    "FROM b JOIN ps USING (symbol) LEFT JOIN cy USING (symbol, i)",
)
ORACLES["f47_preconditions"] = sql(
    DIRTY,
    "SELECT symbol, count(*) AS n_rows, CAST(sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) AS BIGINT) AS n_nulls, "
    "count(*) < 200 AS short, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) > 0 AS has_nulls FROM dirty GROUP BY 1",
)

# ---- transformation ---------------------------------------------------------

SMALL = (
    BARS
    + f""",
x1 AS (SELECT *, {_session} AS session, {", ".join(f"{roll('avg', 'close', k)} AS sma_{k}" for k in _spans)},
  {", ".join(f"{pct('close', lag('close', k))} AS roc_{k}" for k in (1, 5, 10, 20, 60))},
  volume * sign(close - {lag("close")}) AS sv, sign(tp - {lag("tp")}) AS dd FROM b),
x2 AS (SELECT *, sum(sv) {UP} AS obv, CASE WHEN dd > 0 THEN volume * tp ELSE 0 END AS pos, CASE WHEN dd < 0 THEN volume * tp ELSE 0 END AS neg,
  sin({_tau} * (hour(ts) / 24)) AS hour_sin, cos({_tau} * (hour(ts) / 24)) AS hour_cos FROM x1),
x3 AS (SELECT *, {roll("sum", "pos", 14)} AS ps, {roll("sum", "neg", 14)} AS ns FROM x2),
sf AS (SELECT *, CASE WHEN ps IS NOT NULL THEN 100 - 100 / (1 + coalesce(ps / nullif(ns, 0), 0)) END AS mfi FROM x3)"""
)
_cols = [*OV, *[f"sma_{k}" for k in _spans], *[f"roc_{k}" for k in (1, 5, 10, 20, 60)], "obv", "mfi", "hour_sin", "hour_cos", "session"]
ORACLES["t01_null_shares"] = sql(
    SMALL,
    " UNION ALL ".join(f"SELECT '{x}' AS \"column\", round(avg(({x} IS NULL)::INT), 6) + 0.0 AS null_share FROM sf" for x in _cols),
)
ORACLES["t01_drop_sparse"] = sql(SMALL, out([f"sma_{k}" for k in _spans], "sf"))
ORACLES["t02_drop_warmup"] = sql(
    SMALL,
    out(["sma_200"], "sf", where="WHERE i >= CASE WHEN n > 200 THEN 200 WHEN n > 50 THEN 50 WHEN n > 20 THEN 20 WHEN n > 10 THEN 10 WHEN n > 5 THEN 5 ELSE 0 END"),
)
ORACLES["t03_fill_scattered"] = sql(
    DIRTY,
    "SELECT symbol, seq AS ts, "
    + ", ".join(
        f"coalesce(last_value({x} IGNORE NULLS) {UP}, first_value({x} IGNORE NULLS) {DOWN}) AS {x}"
        if x == "volume"
        else f"round(coalesce(last_value({x} IGNORE NULLS) {UP}, first_value({x} IGNORE NULLS) {DOWN}), 6) + 0.0 AS {x}"
        for x in OV
    )
    + " FROM dirty",
)
ORACLES["t04_unique_names"] = sql(BARS, out({"close": "close", "open": "open", "close_1": "close", "close_2": "close"}, "b"))
_groups = {"price": O, "volume": ["volume"], "z": [f"roc_{k}" for k in (1, 5, 10, 20, 60)] + ["obv"], "minmax": ["mfi"]}
ORACLES["t05_column_groups"] = sql(
    SMALL,
    " UNION ALL ".join(
        f"SELECT '{g}' AS column_group, '{x}' AS \"column\", round(avg(({x} IS NULL)::INT), 4) + 0.0 AS null_share, round(avg({x}), 4) + 0.0 AS mean, "
        f"round(stddev_samp({x}), 4) + 0.0 AS spread FROM sf"
        for g, cols in _groups.items() for x in cols
    ),
)
ORACLES["t06_log_volume"] = sql(BARS, out({"volume_log": "ln(1 + volume)"}, "b"))


def zscore(x: str, n: int = 20) -> str:
    flat = f"{roll('max', x, n)} = {roll('min', x, n)}"
    return f"CASE WHEN {flat} THEN 0.0 ELSE ({x} - {roll('avg', x, n)}) / {roll('stddev_samp', x, n)} END"


def minmax(x: str, n: int = 20) -> str:
    lo, hi = roll("min", x, n), roll("max", x, n)
    return f"CASE WHEN {hi} = {lo} THEN 0.5 ELSE ({x} - {lo}) / ({hi} - {lo}) END"


def back(x: str) -> str:
    return f"first_value({x} IGNORE NULLS) {DOWN}"


ORACLES["t07_z_score"] = sql(
    BARS + f",\nx AS (SELECT *, {zscore('close')} AS zc, {zscore('volume')} AS zv FROM b)",
    out({"close_norm": back("zc"), "volume_norm": back("zv")}, "x"),
)
ORACLES["t08_minmax"] = sql(BARS + f",\nx AS (SELECT symbol, ts, i, {minmax('close')} AS mm FROM b)", out({"close": back("mm")}, "x"))
ORACLES["t09_one_hot"] = sql(
    BARS + f",\nx AS (SELECT *, {_session} AS session FROM b)",
    out({f"session_{k}": f"CASE WHEN session = '{k}' THEN 1 ELSE 0 END" for k in ("asian_session", "european_session", "us_session")}, "x",
        raw=[f"session_{k}" for k in ("asian_session", "european_session", "us_session")]),
)
ORACLES["t10_transform"] = sql(
    SMALL
    + f""",
kn AS (SELECT avg((sma_200 IS NULL)::INT) AS s200, avg((sma_50 IS NULL)::INT) AS s50 FROM sf),
k0 AS (SELECT sf.*, CASE WHEN n > 200 AND s200 <= 0.5 THEN 200 WHEN n > 50 AND s50 <= 0.5 THEN 50 WHEN n > 20 THEN 20
  WHEN n > 10 THEN 10 WHEN n > 5 THEN 5 ELSE 0 END AS cut FROM sf, kn),
k1 AS (SELECT * REPLACE (i - cut AS i) FROM k0 WHERE i >= cut),
k2 AS (SELECT *, ln(1 + volume) AS lv FROM k1),
k3 AS (SELECT *, {zscore("close")} AS zc, {zscore("lv")} AS zv, {zscore("roc_5")} AS zr, {minmax("mfi")} AS mm FROM k2)""",
    out({"close": back("zc"), "close_og": "close", "volume": back("zv"), "sma_20": "sma_20", "roc_5": back("zr"), "mfi": back("mm")}, "k3"),
)

# ---- selection --------------------------------------------------------------

SELECTION = (
    SMALL
    + f""",
y1 AS (SELECT *, {roll("stddev_samp", "close", 20)} AS std, {pct("close", roll("max", "high", 20))} AS distance_from_high,
  {pct("close", roll("min", "low", 20))} AS distance_from_low,
  {", ".join(f"{roll('avg', 'volume', k)} AS vma_{k}" for k in (7, 15, 30, 60))} FROM sf),
ys AS (SELECT *, sma_20 + 2 * std AS upper_band, sma_20 - 2 * std AS lower_band, (sma_20 + 2 * std - (sma_20 - 2 * std)) / sma_20 AS bb_width,
  {", ".join(f"volume / nullif(vma_{k}, 0) AS relative_volume_{k}" for k in (7, 15, 30, 60))} FROM y1)"""
)
_sel = [
    "open", "high", "low", "volume", "roc_1", "roc_5", "roc_10", "roc_20", "roc_60", "std", "sma_20", "upper_band", "lower_band", "bb_width",
    "distance_from_high", "distance_from_low", *[f"{p}_{k}" for k in (7, 15, 30, 60) for p in ("vma", "relative_volume")], "mfi",
]
_five = ["close", *sorted(_sel)]
ORACLES["l01_correlations"] = sql(
    SELECTION,
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM ys" for k, a in enumerate(_five) for b in _five[k:]
    ),
)


def pair_table(cols: list[str]) -> str:
    """CTE ``cr`` of all ordered pairs."""
    return ",\ncr AS (" + " UNION ALL ".join(
        "SELECT unnest([" + ", ".join(f"'{a}'" for _ in cols) + "]) AS a, unnest([" + ", ".join(f"'{b}'" for b in cols) + "]) AS b, unnest(["
        + ", ".join(f"corr({a}, {b})" for b in cols) + "]) AS corr FROM ys"
        for a in cols
    ) + ")"


def greedy(target: str, k: int, limit: float, name: str) -> str:
    """Recursive CTE: walk the k strongest, keeping those not too close to what was kept."""
    return f""",
{name}_c AS MATERIALIZED (SELECT a, abs(corr) AS s, row_number() OVER (ORDER BY abs(corr) DESC, a) AS r FROM cr WHERE b = '{target}' AND a <> '{target}' ORDER BY r LIMIT {k}),
{name} AS (SELECT 0 AS r, []::VARCHAR[] AS kept UNION ALL
  SELECT g.r + 1, CASE WHEN c.s <= 0.95 AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.a = c.a AND list_contains(g.kept, cr.b) AND abs(cr.corr) > {limit})
    THEN list_append(g.kept, c.a) ELSE g.kept END FROM {name} AS g JOIN {name}_c AS c ON c.r = g.r + 1)"""


ORACLES["l02_cfs"] = (
    "WITH RECURSIVE " + SELECTION + pair_table([*_sel, "close"]) + greedy("close", 15, 0.7, "g")
    + "\nSELECT unnest(kept) AS feature FROM (SELECT kept FROM g ORDER BY r DESC LIMIT 1) UNION ALL SELECT 'close'"
)
ORACLES["l04_time_folds"] = sql(
    BARS,
    "SELECT symbol, ts, CAST(CASE WHEN j < nn - 5 * sz THEN 0 ELSE (j - (nn - 5 * sz)) // sz + 1 END AS INTEGER) AS fold FROM "
    "(SELECT symbol, ts, row_number() OVER (ORDER BY ts, symbol) - 1 AS j, count(*) OVER () AS nn, count(*) OVER () // 6 AS sz FROM b)",
)


def boosted_importance(cols: list[str], trees: int = 100, depth: int = 6, rate: float = 0.3, bins: int = 32) -> str:
    """CTEs from ``ys`` to ``gains`` (f, gain): boosted trees grown level by level. One step of the recursion is one level of one tree;
    its rows are all training rows with their node, residual and (once in a leaf) what the leaf adds, and the splits made."""
    at = ", ".join(f"{k / bins}" for k in range(1, bins))
    value = f"floor({rate}::DOUBLE * g / (n + 1.0::DOUBLE) + 0.5::DOUBLE)"
    return f""",
xs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY symbol, i) AS row, round(CAST(close AS DOUBLE), 6) + 0.0 AS y0, {", ".join(f"coalesce(round(CAST({n} AS DOUBLE), 6) + 0.0, 0) AS x{k}" for k, n in enumerate(cols))} FROM ys),
un AS MATERIALIZED (SELECT pow(2.0::DOUBLE, ceil(log2(max(abs(y0)) + 1.0)) - 30) AS unit FROM xs),
cu AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {k} AS f, list_sort(list_distinct(quantile_disc(x{k}, [{at}]))) AS cuts FROM xs" for k in range(len(cols)))}),
lo AS MATERIALIZED ({" UNION ALL ".join(f"SELECT row, {k} AS f, x{k} AS x FROM xs" for k in range(len(cols)))}),
bi AS MATERIALIZED (SELECT row, f, len(list_filter(cuts, lambda t: t < x)) AS b FROM lo JOIN cu USING (f)),
dr AS MATERIALIZED (SELECT row, y, ('0x' || substr(md5('42:' || h || ':' || CAST(y AS BIGINT)), 1, 5))::BIGINT AS draw FROM
  (SELECT row, round_even(y0 / unit, 0) AS y FROM xs, un) JOIN (SELECT row, string_agg(printf('%02X', b), '' ORDER BY f) AS h FROM bi GROUP BY row) USING (row)),
fi AS MATERIALIZED (SELECT row, y - (SELECT floor(avg_y + 0.5) FROM (SELECT sum(y) / count(*) AS avg_y FROM dr WHERE draw < 838860)) AS r FROM dr WHERE draw < 838860),
fb AS MATERIALIZED (SELECT bi.* FROM bi JOIN fi USING (row)),
gr AS (
  SELECT 0 AS step, row, 1 AS node, r, NULL::DOUBLE AS add_, NULL::INT AS f, NULL::DOUBLE AS gain FROM fi
  UNION ALL
  (WITH
    st AS (SELECT * FROM gr WHERE row IS NOT NULL),
    nd AS (SELECT node, CAST(count(*) AS DOUBLE) AS n, sum(r) AS g FROM st WHERE add_ IS NULL GROUP BY node),
    hi AS (SELECT node, fb.f, b, count(*) AS c, sum(r) AS s FROM st JOIN fb USING (row) WHERE add_ IS NULL AND step % {depth + 1} < {depth} GROUP BY node, fb.f, b),
    cm AS (SELECT node, f, b, CAST(sum(c) OVER w AS DOUBLE) AS ln, sum(s) OVER w AS lg FROM hi WINDOW w AS (PARTITION BY node, f ORDER BY b)),
    ga AS (SELECT node, f, b, lg * lg / (ln + 1.0::DOUBLE) + (g - lg) * (g - lg) / (n - ln + 1.0::DOUBLE) - g * g / (n + 1.0::DOUBLE) AS gain FROM cm JOIN nd USING (node) WHERE ln < n),
    be AS (SELECT * FROM ga WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1),
    mv AS (SELECT st.step, st.row, st.r, be.f AS f, CASE WHEN be.f IS NOT NULL AND st.add_ IS NULL THEN 2 * st.node + CASE WHEN fb.b > be.b THEN 1 ELSE 0 END ELSE st.node END AS node,
        CASE WHEN st.add_ IS NOT NULL THEN st.add_ WHEN be.f IS NULL THEN {value} END AS add_
      FROM st LEFT JOIN nd ON nd.node = st.node AND st.add_ IS NULL LEFT JOIN be ON be.node = st.node AND st.add_ IS NULL LEFT JOIN fb ON fb.row = st.row AND fb.f = be.f)
  SELECT step + 1, row, CASE WHEN step % {depth + 1} = {depth} THEN 1 ELSE node END, CASE WHEN step % {depth + 1} = {depth} THEN r - add_ ELSE r END,
    CASE WHEN step % {depth + 1} = {depth} THEN NULL ELSE add_ END, NULL::INT, NULL::DOUBLE FROM mv WHERE step + 1 < {trees * (depth + 1)}
  UNION ALL SELECT (SELECT min(step) FROM st) + 1, NULL, node, NULL, NULL, f, gain FROM be)
),
gains AS (SELECT f, sum(gain) AS gain FROM gr WHERE gain IS NOT NULL GROUP BY f)"""


# The columns in the order of the table, as of equal splits the first column's is taken.
_order = [
    "open", "high", "low", "volume", "roc_1", "roc_5", "roc_10", "roc_20", "roc_60", "std", "sma_20", "distance_from_high", "distance_from_low",
    *[f"vma_{k}" for k in (7, 15, 30, 60)], "upper_band", "lower_band", "bb_width", *[f"relative_volume_{k}" for k in (7, 15, 30, 60)], "mfi",
]
ORACLES["l03_tree_importance"] = (
    "WITH RECURSIVE " + SELECTION + boosted_importance(_order)
    + f"""
SELECT feature, round(coalesce(gain / (SELECT sum(gain) FROM gains), 0), 6) + 0.0 AS importance
FROM (SELECT unnest({_order}) AS feature, unnest(range({len(_order)})) AS f) LEFT JOIN gains USING (f)"""
)
# Folds of 0 to 5 by time; fold 6 trains on all. Rounds drop two features, from 26 with the planted one, until five are left.
ORACLES["l04_rfecv"] = sql(
    BARS,
    """SELECT CAST(f AS INTEGER) AS fold, CAST(greatest(k, 5) AS INTEGER) AS n_features, CASE WHEN f = 6 THEN n ELSE n - (6 - f) * (n // 6) END AS train_rows,
  CASE WHEN f = 6 THEN 0 ELSE n // 6 END AS test_rows, 'signal' AS strongest
FROM (SELECT count(*) AS n FROM b), unnest(range(1, 7)) AS x(f), unnest(range(26, 3, -2)) AS y(k)""",
)
ORACLES["l05_votes"] = (
    "WITH RECURSIVE " + SELECTION + pair_table([*_sel, "close"]) + greedy("close", 15, 0.5, "g1") + greedy("close", 15, 0.9, "g2") + greedy("volume", 15, 0.9, "g3")
    + """,
v AS (SELECT 1 AS m, unnest(kept) AS feature FROM (SELECT kept FROM g1 ORDER BY r DESC LIMIT 1) UNION ALL
  SELECT 2, unnest(kept) FROM (SELECT kept FROM g2 ORDER BY r DESC LIMIT 1) UNION ALL
  SELECT 3, unnest(kept) FROM (SELECT kept FROM g3 ORDER BY r DESC LIMIT 1) UNION ALL SELECT 3, 'volume')
SELECT feature, count(DISTINCT m) AS n_votes, count(DISTINCT m) >= 2 AS selected FROM v WHERE feature <> 'close' GROUP BY 1"""
)
ORACLES["l06_correlation_report"] = sql(
    SELECTION + pair_table([*_sel, "close"])
    + ",\ntp5 AS (SELECT a FROM cr WHERE b = 'close' AND a <> 'close' ORDER BY abs(corr) DESC, a LIMIT 20)",
    "SELECT a, b, round(corr, 6) + 0.0 AS corr FROM cr WHERE a IN (SELECT a FROM tp5) AND (b IN (SELECT a FROM tp5) OR b = 'close')",
)
ORACLES["l07_expand_periods"] = """WITH d AS (SELECT o_custkey, list_sort(list(DISTINCT day(o_orderdate))) AS l FROM orders GROUP BY 1)
SELECT o_custkey, CAST(l[1] AS DOUBLE) AS fft_dom_period_1, CAST(l[2] AS DOUBLE) AS fft_dom_period_2, CAST(l[3] AS DOUBLE) AS fft_dom_period_3,
  round(list_avg(l), 6) + 0.0 AS fft_dom_period_mean, CAST(list_max(l) AS DOUBLE) AS fft_dom_period_max FROM d"""
ORACLES["l08_one_hot_categories"] = (
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + ", "
    + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"o_orderstatus_{v}\"" for v in ("O", "P"))
    + " FROM orders"
)
ORACLES["l08_label_codes"] = "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name_encoded FROM customer"
ORACLES["l09_numeric_only"] = "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders"
ORACLES["p01_engineer"] = sql(
    BARS
    + gapless("b")
    + capped("grid_out")
    + f""",
cl AS (SELECT symbol, ts, CAST({REPAIR["close"]} AS DOUBLE) AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM cap),
kn AS (SELECT avg((i < 199)::INT) AS s200, avg((i < 49)::INT) AS s50 FROM cl),
k0 AS (SELECT cl.*, CASE WHEN n > 200 AND s200 <= 0.5 THEN 200 WHEN n > 50 AND s50 <= 0.5 THEN 50 WHEN n > 20 THEN 20
  WHEN n > 10 THEN 10 WHEN n > 5 THEN 5 ELSE 0 END AS cut FROM cl, kn),
k1 AS (SELECT * REPLACE (i - cut AS i) FROM k0 WHERE i >= cut),
k3 AS (SELECT *, {zscore("close")} AS zc FROM k1),
k4 AS (SELECT symbol, ts, {back("zc")} AS close FROM k3),
al AS (SELECT unnest(['cleaned', 'features']) AS stage, symbol, ts, close FROM cl UNION ALL SELECT unnest(['transformed', 'selected']), symbol, ts, close FROM k4)""",
    """SELECT symbol, stage, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(close) AS n_known, round(sum(close), 4) + 0.0 AS total
FROM al GROUP BY symbol, stage""",
)
ORACLES["p02_processors"] = sql(DIRTY, out(REPAIR, "dirty", keys="symbol, seq", raw=["volume"]))

# ---- streaming --------------------------------------------------------------

TICK = "event_type AS symbol, ts, value AS open, value AS high, value AS low, value AS close"
_bar = "event_id % 17 NOT IN (3, 5)"
ORACLES["r01_parse_events"] = f"""SELECT event_id, CASE event_id % 17 WHEN 3 THEN 'malformed' WHEN 5 THEN 'other' ELSE 'bar' END AS kind,
  CASE WHEN {_bar} THEN event_type END AS symbol, CASE WHEN {_bar} THEN CASE WHEN event_id % 2 = 0 THEN 'MINUTE' ELSE 'HOUR' END END AS resolution,
  CASE WHEN {_bar} THEN 'bid' END AS price_type, CASE WHEN {_bar} THEN date_trunc('millisecond', ts) END AS ts,
  {", ".join(f"CASE WHEN {_bar} THEN value END AS {x}" for x in O)},
  CASE event_id % 17 WHEN 3 THEN '{{broken ' || event_id WHEN 5 THEN '{{"destination":"ping","status":"OK"}}' END AS raw FROM events"""
ORACLES["r02_subscribe"] = f"""SELECT event_id, event_type AS symbol, 'HOUR' AS resolution, date_trunc('millisecond', ts) AS ts,
  {", ".join(f"value AS {x}" for x in O)} FROM events WHERE {_bar} AND event_id % 2 = 1 AND event_type IN ('click', 'view')"""
ORACLES["r03_handler"] = "SELECT event_id, event_type AS symbol, ts, value AS close FROM events"
ORACLES["r04_first_updates"] = "SELECT DISTINCT event_type AS symbol, 'HOUR' AS resolution, date_trunc('hour', ts) AS ts FROM events"
ORACLES["r04_newest_updates"] = f"""SELECT event_type AS symbol, 'HOUR' AS resolution, date_trunc('hour', ts) AS ts,
  {", ".join(f"last(value ORDER BY event_id) AS {x}" for x in O)}, count(*) AS n_updates FROM events GROUP BY 1, 3"""


def _windows(start: str, hours: int) -> str:
    return f"""SELECT event_type AS symbol, {start} AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY e.ts, event_id) AS close, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume, count(*) AS n_bars
  FROM events AS e{"" if hours == 1 else ", (SELECT unnest(range(4)) AS s)"} GROUP BY 1, 2"""


ORACLES["r05_tumbling"] = _windows("date_trunc('hour', e.ts)", 1)
ORACLES["r05_sliding"] = _windows("(date_trunc('hour', e.ts) - to_hours(CAST(s AS INTEGER)))", 4)
_first = "close AS f, close AS s, 0.0::DOUBLE AS g, tr AS a, 0.0::DOUBLE AS gn, 0.0::DOUBLE AS ls, NULL::DOUBLE AS ob, 0.0::DOUBLE AS dr, 1::BIGINT AS rl"
_next = (
    f"{_ema('f', 'x.close', 12)}, {_ema('s', 'x.close', 26)}, {_ema('g', _line, 9)}, {_ema('a', 'x.tr', 14)}, {_wilder('gn', _gain)}, {_wilder('ls', _loss)}, "
    "coalesce(e.ob, 0) + sign(x.dc) * x.volume, CAST(sign(x.dc) AS DOUBLE), CASE WHEN sign(x.dc) = e.dr THEN e.rl + 1 ELSE 1 END"
)
ORACLES["r06_live_indicators"] = (
    "WITH RECURSIVE " + BARS + recursive(_first, _next) + "\n"
    + out(
        {
            "ema_12": "f",
            "macd_line": "f - s",
            "macd_signal": "g",
            "atr": "a",
            "rsi_14": "CASE WHEN i >= 13 THEN CASE WHEN ls = 0 AND gn > 0 THEN 100 ELSE 100 - 100 / (1 + gn / nullif(ls, 0)) END END",
            "obv": "ob",
            "run_length": "rl",
        },
        "b JOIN e USING (symbol, i)",
        raw=["run_length"],
    )
)
ORACLES["r07_sessions"] = """WITH x AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS brk FROM events),
y AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars, max(value) AS high, min(value) AS low FROM y GROUP BY symbol, g"""
ORACLES["r08_live_issues"] = """WITH x AS (SELECT event_type AS symbol, ts, value AS open, CASE WHEN event_id % 11 = 0 THEN value - 1 ELSE value END AS high,
  CASE WHEN event_id % 13 = 0 THEN value + 1 ELSE value END AS low, CASE WHEN event_id % 19 = 0 THEN 0 ELSE value END AS close,
  CASE WHEN event_id % 23 = 0 THEN -1 ELSE 1 END AS volume FROM events)
SELECT symbol, ts, 'high_below' AS code FROM x WHERE high < greatest(open, close) UNION ALL SELECT symbol, ts, 'low_above' FROM x WHERE low > least(open, close)
UNION ALL SELECT symbol, ts, 'open_price' FROM x WHERE open <= 0 UNION ALL SELECT symbol, ts, 'high_price' FROM x WHERE high <= 0
UNION ALL SELECT symbol, ts, 'low_price' FROM x WHERE low <= 0 UNION ALL SELECT symbol, ts, 'close_price' FROM x WHERE close <= 0
UNION ALL SELECT symbol, ts, 'negative_volume' FROM x WHERE volume < 0"""

ORACLES["r08_live_counts"] = f"""WITH f AS ({ORACLES["r08_live_issues"]}),
codes AS (SELECT unnest(['high_below', 'low_above', 'open_price', 'high_price', 'low_price', 'close_price', 'negative_volume']) AS code)
SELECT code, count(f.code) AS n FROM codes LEFT JOIN f USING (code) GROUP BY 1 UNION ALL SELECT 'n_bars', count(*) FROM events"""
ORACLES["u01_own_feature"] = sql(BARS, out({"hl_spread": f"{roll('max', 'high', 3)} - {roll('min', 'low', 3)}"}, "b"))
ORACLES["u02_rolling_function"] = sql(BARS, out({"mad_7": roll("mad", "close", 7)}, "b"))
ORACLES["u03_exact_quantiles"] = "SELECT event_type AS symbol, " + ", ".join(
    f"round(quantile_cont({x}, {p}), 6) + 0.0 AS {n}_{k}"
    for n, x in (("price", "value"), ("size", "CAST(json_extract_string(props, '$.k') AS DOUBLE)"))
    for k, p in (("q1", 0.25), ("q2", 0.5), ("q99", 0.99))
) + " FROM events GROUP BY 1"



def side_by_side(parts: dict[str, list[str]], twins: dict[str, str]) -> str:
    """One row per bar with the columns of several twins, each cut to those named."""
    tables = [f"{t} AS MATERIALIZED (SELECT symbol, ts, " + ", ".join(f'"{n}"' for n in cols) + f" FROM ({twins[t]}))" for t, cols in parts.items()]
    first, *rest = parts
    return "WITH " + ",\n".join(tables) + f"\nSELECT * FROM {first}" + "".join(f" JOIN {t} USING (symbol, ts)" for t in rest)


# All features at once. The twin for holidays is over daily bars; here it is over the hourly ones.
_spans_of = {"f01_sma": "sma", "f02_ema": "ema"}
_hourly = ORACLES["f30_holidays"].replace(DAILY, BARS).replace(holidays(), holidays(2020, 2030))
ORACLES["f47_all_features"] = side_by_side(
    {
        "s10_bars_1h": OV,
        **{t: [f"{n}_{k}" for k in (5, 10, 20, 50, 200)] for t, n in _spans_of.items()},
        "f03_rate_of_change": [f"roc_{k}" for k in (1, 5, 10, 20, 60)],
        "f04_atr": ["atr"],
        "f05_bollinger": ["std", "upper_band", "lower_band", "bb_width"],
        "f06_support_resistance": ["distance_from_high", "distance_from_low"],
        "f07_volume_averages": [f"{p}_{n}" for n in (7, 15, 30, 60) for p in ("vma", "relative_volume")],
        "f08_volume_roc": [f"vroc_{n}" for n in (1, 5, 10, 20)],
        "f09_obv": ["obv"],
        "f10_volume_profile": [f"vol_bin_{k}" for k in range(10)],
        "f11_point_of_control": ["vol_poc", "close_to_poc_pct"],
        "f12_value_area": ["vol_va_high", "vol_va_low", "vol_va_width", "in_value_area"],
        "f14_concentration": ["vol_concentration"],
        "f15_vwap": ["vwap"],
        "f16_mfi": ["mfi"],
        "f17_rsi": ["rsi_14"],
        "f18_macd": ["macd_line", "macd_signal", "macd_histogram"],
        "f19_adx": ["+di", "-di", "adx"],
        "f20_stochastic": ["stoch_k", "stoch_d"],
        "f21_cci": ["cci"],
        "f23_time_of_day": ["hour_sin", "hour_cos", "session"],
        "f24_day_of_week": ["day_of_week_sin", "day_of_week_cos"],
        "f25_time_of_week": ["hour_of_week_sin", "hour_of_week_cos", "is_weekend"],
        "f26_time_of_month": ["month_progress_sin", "month_progress_cos", "month_period", "month_of_year_sin", "month_of_year_cos"],
        "f27_seasonal": [f"seasonal_{n}" for n in ("trend", "seasonal", "residual", "norm")],
        "f28_stl": [f"stl_{n}" for n in ("trend", "seasonal", "residual", "seasonal_strength", "trend_strength")],
        "f29_mstl": ["mstl_trend", "mstl_seasonal_24", "mstl_seasonal_160", "mstl_residual"],
        "f30_holidays": ["is_holiday", "days_to_next_holiday"],
        "f32_volatility": ["returns", "volatility_short", "volatility_long", "volatility_ratio"],
        "f34_volatility_regime": ["volatility_regime", "vol_regime_low", "vol_regime_medium", "vol_regime_high"],
        "f36_volatility_change": ["volatility_zscore", "volatility_change"],
        "f37_adx_regime": ["adx_trend_regime", "adx_regime_trending", "adx_regime_ranging"],
        "f38_sma_distance": [f"dist_from_sma_{n}" for n in (20, 50, 200)] + [f"sma_{n}_slope" for n in (20, 50, 200)],
        "f39_ma_cross": ["ma_cross_50_200"],
        "f40_regression": ["regression_slope", "r_squared", "norm_regression_slope"],
        "f41_trend_strength": ["trend_strength", "trend_regime", "trend_regime_ranging", "trend_regime_weak_trend", "trend_regime_strong_trend"],
        "f42_market_state": ["vol_regime_num", "trend_regime_num", "market_state", "market_state_desc", *[f"state_{d}" for d in _states]],
        "f43_state_duration": ["state_duration"],
        "f44_log_return": ["log_return"],
        "f45_cycles": ["periods", "n_cycles", "sin_sum", "cos_sum"],
    },
    ORACLES | {"f30_holidays": _hourly},
)
