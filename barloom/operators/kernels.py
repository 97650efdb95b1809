"""Recursive series: exponential averages and the parabolic stop, in Arrow batches per chunk.

An exponential average forgets: after `ema_halo(alpha)` new inputs the weight of anything older is below
2**-64, under the last bit of a double, so a chunk whose halo holds that many gives the value of the full
recursion. Rows without a new input (flat or unknown bars) do not count (`renewing_rows`). The parabolic stop has no such bound; it is verified at the chunk seams and repaired
(see `parabolic_stop`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.operators.chunks import Chunked, halo_chunks, restored_keys
from barloom.sources.staging import checkpointed

Step = tuple[str, Callable[[pd.DataFrame], pd.Series]]


def ema_halo(alpha: float, bits: int = 64) -> int:
    return 1 if alpha >= 1 else math.ceil(bits * math.log(2) / -math.log1p(-alpha))


def renewing_rows() -> Column:
    """Aggregate over bars: how many surely give every recursion a new input.

    A bar does if it has a range, or a price that its bucket has not shown yet; an unknown bar spoils itself and the next.
    """
    known = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    moving = F.greatest(F.count_if(known & (F.col("high") > F.col("low"))), (F.size(F.collect_set("close")) - 1).cast("long"))
    return F.greatest(moving - F.count_if(~known), F.lit(0))


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ema(src: str, **how) -> Callable[[pd.DataFrame], pd.Series]:
    """how: span= / alpha= / com= and adjust=."""
    return lambda p: p[src].ewm(**how).mean()


def ewm_std(src: str, **how) -> Callable[[pd.DataFrame], pd.Series]:
    return lambda p: p[src].ewm(**how).std()


def with_recursive(ck: Chunked, df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run the steps in order inside each chunk; each adds one double column and may use earlier ones."""
    added = [name for name, _ in steps]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in added]])
    order = ck.order

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        for name, fn in steps:
            pdf[name] = fn(pdf).astype("float64")
        pdf[added] = pdf[added].replace([np.inf, -np.inf], np.nan)
        return pdf

    return df.groupBy(*ck.chunk_keys).applyInPandas(run, schema)


def averages(df: DataFrame, spans: Sequence[int]) -> DataFrame:
    """Add ema_<span> of the close, adjusted at no bar."""
    ck = halo_chunks(df, back=max(ema_halo(span_alpha(s)) for s in spans) + 1, renewed=renewing_rows())
    return ck.owned(with_recursive(ck, ck.df, [(f"ema_{s}", ema("close", span=s, adjust=False)) for s in spans]))


# --- parabolic stop and reverse -----------------------------------------------------------------

STOP_STATE = 4  # side (1 rising, -1 falling), acceleration, extreme price of the present side, stop


def stop_walk(high, low, step, cap, at=0, state=None):
    """Stops and states of rows from `at` on, entered with `state` (the very start of a series when None).

    A falling market is a rising one seen in the mirror: with the side's sign on every price one rule
    serves both. The stop nears the side's extreme by the acceleration, stays outside the two rows
    before, and on being passed turns over to the extreme that the side had reached.
    """
    high, low = np.asarray(high, float), np.asarray(low, float)
    ahead, behind = {1.0: high, -1.0: -low}, {1.0: low, -1.0: -high}
    stops, states = np.zeros(len(high)), np.zeros((len(high), STOP_STATE))
    if state is None:
        state, at = (1.0, step, high[0], 0.0), 1
        states[0] = state
    side, pace, extreme, stop = state
    for i in range(at, len(high)):
        best, trail = side * extreme, side * stop
        trail = min(trail + pace * (best - trail), *behind[side][max(i - 2, 0) : i])
        if ahead[side][i] > best:
            best, pace = ahead[side][i], min(cap, pace + step)
        if behind[side][i] < trail:
            trail, best, pace, side = -best, -behind[side][i], step, -side
        extreme, stop = side * best, side * trail
        stops[i], states[i] = stop, (side, pace, extreme, stop)
    return stops, states


def parabolic_stop(df: DataFrame, step: float = 0.02, cap: float = 0.2, warmup: int = 512) -> DataFrame:
    """Add psar and psar_flip_flag, equal to one sequential pass over each group."""
    ck, walked = _walked(df, step, cap, warmup)
    prev = F.lag("psar").over(ck.w)
    down = (prev > F.col("high")) & (F.col("psar") <= F.col("low"))
    up = (prev < F.col("low")) & (F.col("psar") >= F.col("high"))
    return ck.owned(walked.withColumn("psar_flip_flag", F.coalesce((down | up).cast("int"), F.lit(0))))


def stop_ends(df: DataFrame, step: float = 0.02, cap: float = 0.2, warmup: int = 512) -> DataFrame:
    """(keys, last, v): the time of each group's last bar, and the state after it followed by the last two highs and lows."""
    ck, walked = _walked(df, step, cap, warmup)
    before = lambda c: F.lag(c).over(ck.w)
    pairs = lambda c: F.filter(F.array(F.col(f"_before_{c}"), F.col(c)), lambda x: x.isNotNull())
    rows = walked.withColumns({"_before_high": before("high"), "_before_low": before("low")}).filter("_own")
    state = F.concat("_exit", pairs("high"), pairs("low"))
    order = F.col(ck.order)
    known = [c for c in rows.columns if c.startswith("_unknown_")]
    ends = rows.groupBy(*ck.keys, *known).agg(F.max(order).alias("last"), F.max_by(state, order).alias("v"))
    return restored_keys(ends).select(*ck.keys, "last", "v")


def _walked(df: DataFrame, step: float, cap: float, warmup: int) -> tuple[Chunked, DataFrame]:
    """The chunks and their rows with psar, and with the states in which the chunk was entered and left.

    Every chunk is walked in parallel from a state guessed by warming up on its halo, and reports
    the state it entered its own rows with and the state it left. A chunk is right when its entry
    state equals its predecessor's exit state. Wrong chunks are walked again from that exit state
    until none is left; runs from different starts meet at the next common reversal, so as a rule
    there is nothing to repair. A table of single-chunk groups needs no check.
    """
    ck = halo_chunks(df, back=max(warmup, 2))
    seam = [T.StructField(f"_{side}", T.ArrayType(T.DoubleType())) for side in ("entry", "exit")]
    schema = T.StructType([*ck.df.schema.fields, T.StructField("psar", T.DoubleType()), *seam])
    order = ck.order

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        first = int(pdf["_own"].to_numpy().argmax())
        if "_fix" in pdf:
            entry = list(pdf["_fix"].iloc[0])
            stop, states = stop_walk(high, low, step, cap, at=first, state=tuple(entry))
            stop[first - 1] = entry[-1]
        else:
            stop, states = stop_walk(high, low, step, cap)
            entry = states[first - 1].tolist() if first else None
        pdf["psar"] = stop
        pdf["_entry"] = [entry] * len(pdf)
        pdf["_exit"] = [states[-1].tolist()] * len(pdf)
        return pdf[schema.names]

    walked = ck.df.groupBy(*ck.chunk_keys).applyInPandas(walk, schema)
    if ck.df.agg(F.max("_chunk")).first()[0]:
        along = Window.partitionBy(*ck.keys).orderBy("_chunk")
        walked = checkpointed(walked)
        while True:
            wrong = (
                walked.filter("_own")
                .groupBy(*ck.chunk_keys)
                .agg(F.first("_entry").alias("_entry"), F.first("_exit").alias("_exit"))
                .withColumn("_fix", F.lag("_exit").over(along))
                .filter(F.col("_fix") != F.col("_entry"))
                .select(*ck.chunk_keys, "_fix")
            )
            if wrong.isEmpty():
                break
            redo = walked.drop("psar", "_entry", "_exit").join(wrong, ck.chunk_keys)
            redone = redo.groupBy(*ck.chunk_keys).applyInPandas(walk, schema)
            walked = checkpointed(walked.join(wrong, ck.chunk_keys, "left_anti").unionByName(redone))
    return ck, walked
