"""Made-up bars for tests: random walks with a fixed seed and fixed dates."""

import numpy as np
import pandas as pd


def walk(n: int, symbol: str = "A", seed: int = 42, freq: str = "1h", start: str = "2024-01-01") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = close * (1 + rng.normal(0, 0.002, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq=freq),
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "volume": rng.integers(100, 10_000, n),
        }
    )


def by_row(df):
    """A positioned Spark table as pandas, in series order."""
    return df.toPandas().sort_values(["symbol", "_i"], ignore_index=True)
