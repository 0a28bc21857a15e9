"""Scalar functions on segments: parts of them, and aggregates of segments given by their six columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def start(s: int, e: int, si: int, ts: int, strict: bool = False) -> int:
    """New start: the grid time at or before ``ts``; with ``strict`` the one at or after. The segment's own where ``ts``
    lies outside."""
    if ts <= s or e < ts:
        return s
    low = ts - (ts - s) % si
    return low + si if strict and low < ts else low


def end(s: int, e: int, si: int, ts: int, strict: bool = False) -> int:
    """New end: the grid time at or after ``ts``; with ``strict`` the one at or before."""
    if ts < s or e <= ts:
        return e
    back = (e - ts) % si
    high = ts + back
    return high - si if strict and high > ts else high


def register(spark: SparkSession, models: tuple[str, ...], classes: dict) -> None:
    """Registers ``seg_values``, the stored values of a segment given by its columns and interval, decoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def values_udf(tid: pd.Series, s: pd.Series, e: pd.Series, mtid: pd.Series, model: pd.Series, offsets: pd.Series, si: pd.Series) -> pd.Series:
        from chronolith.operators.generator import DECODERS, use

        use(models, classes)
        out = []
        ms = ((e - s) // pd.Timedelta(milliseconds=1)).tolist()
        for span, m, x, o, step in zip(ms, mtid, model, offsets, si):
            k, n, off = struct.unpack(">iii", bytes(o))
            out.append(np.asarray(DECODERS[m](bytes(x), off + span // step + 1, n, step)[off:, k - 1]))
        return pd.Series(out, dtype=object)

    spark.udf.register("seg_values", values_udf)
