"""Rolling functions of your own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebars.operators.blocks import SERIES, block_rows, own_rows, with_halo, with_position
from tidebars.operators.recurrences import KERNEL_ROWS

BATCH = 65_536


def rolling_apply(
    df: DataFrame,
    col: str,
    out: str,
    n: int,
    fn: Callable[[np.ndarray], np.ndarray],
    by=SERIES,
    rows: int | None = None,
) -> DataFrame:
    """``fn`` of the last n values of ``col``, NULL unless all n are known.

    The function gets the windows of a block as a matrix, one per row, and returns one number for each;
    it is called once per block and ``BATCH`` windows. Use it only for what no built-in aggregate can say.
    """

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        x, result = pdf[col].to_numpy(dtype=float, na_value=np.nan), np.full(len(pdf), np.nan)
        if len(x) >= n:
            windows = sliding_window_view(x, n)
            for at in range(0, len(windows), BATCH):
                some = windows[at : at + BATCH]
                known = np.isfinite(some).all(axis=1)
                if known.any():
                    result[at + n - 1 + np.flatnonzero(known)] = fn(some[known])
        return pdf.assign(**{out: result})[names]

    df = with_position(df, by)
    size = block_rows(n - 1, 0, rows or KERNEL_ROWS)
    seated = with_halo(df, n - 1, 0, size)
    schema = T.StructType([*(f for f in seated.schema if f.name != out), T.StructField(out, T.DoubleType())])
    names = schema.names
    return own_rows(seated.groupBy(*by, "_blk").applyInPandas(block, schema), n - 1, 0, size)
