"""Indicators that a stream keeps up to date bar by bar.

Rows are held until the watermark has passed them, then taken in time order; the state
of a symbol is a handful of numbers, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "ts timestamp, close double, ema_12 double, ema_26 double, macd_line double, "
    "macd_signal double, macd_histogram double, atr double, rsi_14 double, obv double, "
    "direction int, run_length long"
)
STATE = (
    "n long, close double, ema_12 double, ema_26 double, signal double, atr double, "
    "gain double, loss double, obv double, direction int, run_length long"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]
RSI = 14


PIECE = 1000  # rows of an output frame


class Running:
    """The indicators of one series, carried from bar to bar as a handful of numbers."""

    def __init__(self, state: tuple | None):
        self.s = dict(zip(FIELDS, state, strict=True)) if state else None

    def over(self, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
        """Output columns for the bars that follow, and the state after them."""
        n = len(close)
        first = self.s is None
        before = np.concatenate([[close[0] if first else self.s["close"]], close[:-1]])
        move = close - before
        sign = np.sign(move).astype("i4")
        tr = np.maximum.reduce([high - low, np.abs(high - before), np.abs(low - before)])
        if first:
            tr[0] = high[0] - low[0]
        old = self.s or {"n": 0, "ema_12": close[0], "ema_26": close[0], "signal": 0.0, "atr": tr[0], "gain": 0.0, "loss": 0.0, "obv": None, "direction": 0, "run_length": 0}
        number = old["n"] + 1 + np.arange(n)
        fast, slow = _follow(close, old["ema_12"], 2 / 13), _follow(close, old["ema_26"], 2 / 27)
        line = fast - slow
        signal, atr = _follow(line, old["signal"], 2 / 10), _follow(tr, old["atr"], 2 / 15)
        gain, loss = _wilder(np.maximum(move, 0.0), old["gain"], number), _wilder(np.maximum(-move, 0.0), old["loss"], number)
        flow = np.cumsum(sign * volume) + (old["obv"] or 0.0)
        run = _runs(sign, old["direction"], old["run_length"])
        with np.errstate(all="ignore"):
            rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        rsi[(number < RSI) | ((gain == 0) & (loss == 0))] = np.nan
        obv = np.where(number > 1, flow, np.nan)
        self.s = dict(zip(FIELDS, (int(number[-1]), *map(float, (close[-1], fast[-1], slow[-1], signal[-1], atr[-1], gain[-1], loss[-1])), None if number[-1] == 1 else float(flow[-1]), int(sign[-1]), int(run[-1])), strict=True))
        return {
            "close": close, "ema_12": fast, "ema_26": slow, "macd_line": line, "macd_signal": signal, "macd_histogram": line - signal,
            "atr": atr, "rsi_14": rsi, "obv": obv, "direction": sign, "run_length": run,
        }

    def state(self) -> tuple:
        return tuple(self.s[f] for f in FIELDS)


def _follow(x: np.ndarray, last: float, share: float) -> np.ndarray:
    """Each value moves the average by ``share`` of its distance."""
    out = []
    for v in x.tolist():
        last += share * (v - last)
        out.append(last)
    return np.array(out)


def _wilder(x: np.ndarray, last: float, number: np.ndarray) -> np.ndarray:
    """Sums until row 14, where they become means; from there on smoothed means."""
    out = []
    for k, v in zip(number.tolist(), x.tolist(), strict=True):
        last = (last * (RSI - 1) + v) / RSI if k > RSI else (last + v) / RSI if k == RSI else last + v
        out.append(last)
    return np.array(out)


def _runs(sign: np.ndarray, direction: int, length: int) -> np.ndarray:
    """Length of the run of equal signs that each row ends; the first goes on from ``direction``."""
    starts = np.concatenate([[sign[0] != direction], sign[1:] != sign[:-1]])
    at = np.arange(len(sign))
    since = np.maximum.accumulate(np.where(starts, at, -length))
    return at - since + 1


class Indicators(StatefulProcessor):
    def __init__(self, by: tuple[str, ...]):
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        # Only bars that the watermark has not passed are held, one entry per stamp: lateness bounds them.
        self.pending = handle.getMapState("pending", "ms long", "arrived long, h double, l double, c double, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        newest: dict[int, tuple] = {}
        for pdf in rows:
            ms = pdf["ts"].to_numpy("datetime64[ms]").astype("i8")
            # Bars at or before the watermark are late: their place has been taken.
            for stamp, bar in zip(ms[ms > mark].tolist(), pdf.loc[ms > mark, ["arrived", "high", "low", "close", "volume"]].itertuples(index=False, name=None), strict=True):
                if stamp not in newest or bar[0] >= newest[stamp][0]:
                    newest[stamp] = (int(bar[0]), *map(float, bar[1:]))
        if newest:
            known = {k[0]: v[0] for k, v in self.pending.iterator()} if self.pending.exists() else {}
            for stamp, bar in newest.items():
                if stamp not in known or bar[0] >= known[stamp]:
                    self.pending.updateValue((stamp,), bar)
            self.handle.registerTimer(min(newest))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], *v) for k, v in self.pending.iterator()) if self.pending.exists() else []
        due = [b for b in held if b[0] <= mark]
        if len(due) < len(held):
            self.handle.registerTimer(held[len(due)][0])
        running = Running(self.state.get() if self.state.exists() else None)
        for at in range(0, len(due), PIECE):
            ms, _, high, low, close, volume = (np.array(x) for x in zip(*due[at : at + PIECE], strict=True))
            out = running.over(high, low, close, volume)
            yield pd.DataFrame({**dict(zip(self.by, key, strict=True)), "ts": ms.astype("datetime64[ms]").astype("datetime64[ns]"), **out})
        for bar in due:
            self.pending.removeKey((bar[0],))
        if due:
            self.state.update(running.state())
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def live_indicators(bars: DataFrame, late: str = "10 minutes", by: tuple[str, ...] = ("symbol",), arrived: str | None = None) -> DataFrame:
    """EMA, MACD, ATR, RSI, OBV and run length of every series, bar by bar.

    Bars wait until the watermark has passed them. Of several updates of a stamp the one with the largest
    ``arrived`` counts (without that column, the one read last). Needs the RocksDB state store; see ``use_rocksdb``.
    """
    keys = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in by)
    number = F.col(arrived).cast("long") if arrived else F.lit(0).cast("long")
    prices = [F.col(n).cast("double").alias(n) for n in ("high", "low", "close", "volume")]
    return (
        bars.select(*by, "ts", *prices, number.alias("arrived"))
        .withWatermark("ts", late)
        .groupBy(*by)
        .transformWithStateInPandas(Indicators(tuple(by)), f"{keys}, {OUTPUT}", "Append", "EventTime")
    )


def use_rocksdb(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
