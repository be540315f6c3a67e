"""Loci of a coordinate-sorted stream: one open locus for each key is kept as state, and given out once a gap closes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "tid long, xs string, lpos int, rpos int, n long, late boolean"
#: Bounds and number of the open locus; how far closed ones reached.
STATE = "lpos int, rpos int, n long"


def close_on_gap(gap: int, least: int = 1):
    """The state function: rows (tid, xs, pos, rpos) of a key, by pos within a batch, extend the open locus or close it.

    Rows left of the open locus's start are late: they are given out alone with late = true and change nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["pos", "rpos"])
        lpos, rpos, n = state.get if state.exists else (None, None, 0)
        out = []
        for pos, end in zip(rows["pos"].tolist(), rows["rpos"].tolist()):
            if n and pos < lpos:
                out.append((*key, pos, end, 1, True))
                continue
            if n and pos > rpos + gap:
                if n >= least:
                    out.append((*key, lpos, rpos, n, False))
                n = 0
            lpos, rpos, n = (pos, end, 1) if not n else (lpos, max(rpos, end), n + 1)
        state.update((lpos, rpos, n))
        yield pd.DataFrame(out, columns=["tid", "xs", "lpos", "rpos", "n", "late"])

    return run


def stream_loci(rows: DataFrame, gap: int = 100, least: int = 1) -> DataFrame:
    """Closed loci of a stream (tid, xs, pos, rpos), append mode; a key's last locus stays open until a row behind it comes.

    End a bounded stream with a row far behind each key's last, as flush_rows() makes them.
    """
    typed = rows.select(F.col("tid").cast("long").alias("tid"), "xs", F.col("pos").cast("int").alias("pos"), F.col("rpos").cast("int").alias("rpos"))
    return typed.groupBy("tid", "xs").applyInPandasWithState(close_on_gap(gap, least), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def flush_rows(rows: DataFrame, at: int = 2_000_000_000) -> DataFrame:
    """A row for each key behind all positions."""
    return rows.select("tid", "xs").distinct().select("tid", "xs", F.lit(at).alias("pos"), F.lit(at).alias("rpos"))


def windowed_counts(events: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """Session windows of events (user_id, ts): the event-time form of gap grouping, with a watermark for late rows."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
