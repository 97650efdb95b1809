"""Ticks to bars, bars without repeats, and recursive indicators with keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from barloom.operators.kernels import STOP_STATE, averages, stop_ends, stop_walk
from barloom.schema import KEYS, PERIODS, TIME

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"


def stream_bars(ticks: DataFrame, period: str, symbol: Column, ts: str, price: Column, volume: Column, late: str = "2 hours", tie: Sequence[Column] = ()) -> DataFrame:
    """Tumbling bars; a bar is emitted once, when the watermark passes its end, and later ticks are dropped."""
    step = f"{PERIODS[period].step_ms} milliseconds"
    rank = F.struct(F.col("_ts"), *[F.col(f"_t{i}") for i in range(len(tie))], F.col("_p"))
    rows = ticks.select(
        symbol.alias("symbol"), F.col(ts).alias("_ts"), price.cast("double").alias("_p"), volume.cast("double").alias("_v"),
        *[t.alias(f"_t{i}") for i, t in enumerate(tie)],
    )
    bars = rows.withWatermark("_ts", late).groupBy(F.window("_ts", step).alias("_w"), "symbol").agg(
        F.min_by("_p", rank).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", rank).alias("close"), F.sum("_v").alias("volume"),
    )
    return bars.select(
        F.unix_millis("_w.start").alias(TIME), "open", "high", "low", "close", "volume",
        F.col("_w.start").alias("datetime"), "symbol", F.lit(period).alias("period"),
    )


def once_per_bar(bars: DataFrame, late: str = "2 days") -> DataFrame:
    """The first arrival of each (symbol, period, timestamp); state lives as long as the watermark allows."""
    return bars.withWatermark("datetime", late).dropDuplicatesWithinWatermark([*KEYS, TIME])


class _Keyed(StatefulProcessor):
    """Runs the bars of one key in time order. Bars wait until the watermark has passed them; of repeats the first arrival counts."""

    schema = "last long, v array<double>"
    waiting = f"{TIME} long, high double, low double, close double"

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        self.pending = handle.getListState("pending", self.waiting)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Goes on from history: the last bar's time and the values after it."""
        for last, values in initialState[["last", "v"]].itertuples(index=False):
            self.state.update((int(last), [float(v) for v in values]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if self.state.exists():
            batch = batch[batch[TIME] > self.state.get()[0]]
        batch = batch.drop_duplicates(TIME)
        if len(batch):
            values = [[None if pd.isna(v) else float(v) for v in batch[c]] for c in ("high", "low", "close")]
            self.pending.appendList(list(zip(map(int, batch[TIME]), *values)))
            self.handle.registerTimer(int(batch[TIME].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        bars = pd.DataFrame(list(self.pending.get()), columns=[TIME, "high", "low", "close"]).drop_duplicates(TIME)
        bars = bars.astype({c: float for c in ("high", "low", "close")})
        batch, rest = bars[bars[TIME] <= passed].sort_values(TIME).reset_index(drop=True), bars[bars[TIME] > passed]
        if not len(batch):
            return
        self.pending.clear()
        if len(rest):
            self.pending.appendList([(int(t), *(None if pd.isna(v) else float(v) for v in row)) for t, *row in rest.itertuples(index=False)])
            self.handle.registerTimer(int(rest[TIME].min()))
        values = self.state.get()[1] if self.state.exists() else None
        out, values = self.advance(batch, None if values is None else [float(v) for v in values])
        self.state.update((int(batch[TIME].iloc[-1]), [float(v) for v in values]))
        for name, value in zip(KEYS, key):
            out[name] = value
        yield out[[*KEYS, TIME, *self.outputs]]

    def close(self) -> None:
        pass


class EmaState(_Keyed):
    """Exponential averages of the close."""

    def __init__(self, spans: Sequence[int]):
        self.spans = tuple(spans)
        self.outputs = [f"ema_{s}" for s in self.spans]

    def history(self, bars: DataFrame) -> DataFrame:
        """(keys, last, v) after the bars of a batch table, for `stateful`."""
        last = F.max_by(F.array(*self.outputs), TIME)
        return averages(bars, self.spans).groupBy(*KEYS).agg(F.max(TIME).alias("last"), last.alias("v"))

    def advance(self, batch, values):
        out = batch[[TIME]].copy()
        ends = []
        for i, (span, name) in enumerate(zip(self.spans, self.outputs)):
            close = batch["close"]
            if values is not None:
                close = pd.concat([pd.Series([values[i]]), close], ignore_index=True)
            ema = close.ewm(span=span, adjust=False).mean()
            ends.append(ema.iloc[-1])
            out[name] = ema.iloc[-len(batch):].to_numpy()
        return out, ends


class StopState(_Keyed):
    """Parabolic stop; keeps its state and the last two bars."""

    outputs = ["psar"]

    def __init__(self, step: float = 0.02, cap: float = 0.2):
        self.step, self.cap = step, cap

    def history(self, bars: DataFrame) -> DataFrame:
        """(keys, last, v) after the bars of a batch table, for `stateful`."""
        return stop_ends(bars, self.step, self.cap)

    def advance(self, batch, values):
        high, low = batch["high"].tolist(), batch["low"].tolist()
        if values is None:
            stop, states = stop_walk(high, low, self.step, self.cap)
            kept = 0
        else:
            tail = values[STOP_STATE:]
            half = len(tail) // 2
            high, low, kept = tail[:half] + high, tail[half:] + low, half
            stop, states = stop_walk(high, low, self.step, self.cap, at=kept, state=tuple(values[:STOP_STATE]))
        out = batch[[TIME]].copy()
        out["psar"] = stop[kept:]
        return out, [*states[-1], *high[-2:], *low[-2:]]


def stateful(bars: DataFrame, processor: _Keyed, late: str = "2 days", history: DataFrame | None = None) -> DataFrame:
    """Apply a keyed processor to a bar stream. Needs the RocksDB state store (`STATE_CONF`).

    A bar may come late by `late` after the latest one of all keys, in any order; it is emitted when the watermark has passed it.
    With `history`, the processor's own over a batch table, the stream goes on where the batch ended: arrivals up to a key's last
    bar of the batch do not count, later ones give what one pass over both would. It is read when the stream first starts.
    """
    fields = [T.StructField(k, T.StringType()) for k in KEYS]
    fields += [T.StructField(TIME, T.LongType())] + [T.StructField(o, T.DoubleType()) for o in processor.outputs]
    return bars.withWatermark("datetime", late).select(*KEYS, TIME, "datetime", "high", "low", "close").groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append", timeMode="EventTime",
        initialState=None if history is None else history.groupBy(*KEYS),
    )


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into a Parquet table at `path` and read it; repeated runs continue."""
    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{path}/data")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
