"""Row-frame windows over long groups without putting a group into one task.

A (symbol, period) group can hold a third of all rows, so partitioning a window by the group key
alone would serialise it. Instead each group is cut along time into chunks of about `chunk_rows`
rows, and every chunk also receives the rows its frames reach into (the halo): `back` rows before
and `ahead` rows after it. Windows then partition by (group, chunk); rows that a chunk only borrowed
are dropped at the end. Results are those of the uncut group as long as `back`/`ahead` cover the
frames in use, summed over nesting.

The layout comes from one map-side-combined count per (group, time bucket). Frames count rows, not
time, so gaps do not matter: a borrowed bucket is chosen by its row numbers. The layout is smaller
than the data by the bucket length; whether it is broadcast is Spark's decision by its size.

The input is read twice, once for the counts (keys and time only) and once for the values, so an
input that is expensive to compute belongs in a staged table first (`barloom.sources.staging`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.operators.carry import carried
from barloom.schema import KEYS, TIME, step_ms

CHUNK_ROWS_CONF = "barloom.chunk.rows"
BUCKET_ROWS_CONF = "barloom.bucket.rows"
DEFAULT_CHUNK_ROWS = 16_384
DEFAULT_BUCKET_ROWS = 256
MIN_CHUNK_ROWS = 512

_CHUNK, _OWN, _BUCKET, _BEFORE = "_chunk", "_own", "_bucket", "_before"


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def time_bucket(df: DataFrame, order: str = TIME, step: Column | None = None) -> Column:
    """Bucket of a bar: with unique bars per step it holds at most `bucket_rows` rows.

    A period without a declared step is bucketed as if it were hourly: only the bucket size depends
    on it.
    """
    rows = _conf_int(df, BUCKET_ROWS_CONF, DEFAULT_BUCKET_ROWS)
    known = step if step is not None else step_ms() if "period" in df.columns else F.lit(None).cast("long")
    width = F.coalesce(known, F.lit(3_600_000).cast("long")) * F.lit(rows)
    return F.floor(F.col(order) / width).cast("long")


_UNKNOWN = "_unknown_"
_STAND_INS = {"string": "\x00", "bigint": -(1 << 63), "int": -(1 << 31)}


def stand_in_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unknown keys are groups of their own: a value that no key has stands in for NULL, so that joins keep their rows."""
    types = dict(df.dtypes)
    wanted = [k for k in keys if types[k] in _STAND_INS and f"{_UNKNOWN}{k}" not in types]
    flags = {f"{_UNKNOWN}{k}": F.col(k).isNull() for k in wanted}
    return df.withColumns(flags).withColumns({k: F.coalesce(F.col(k), F.lit(_STAND_INS[types[k]]).cast(types[k])) for k in wanted})


def restored_keys(df: DataFrame) -> DataFrame:
    """NULL again where a value stands in for it."""
    flags = [c for c in df.columns if c.startswith(_UNKNOWN)]
    keys = {c.removeprefix(_UNKNOWN): F.when(~F.col(c), F.col(c.removeprefix(_UNKNOWN))) for c in flags}
    return df.withColumns(keys).drop(*flags)


def known_bucket(bucket: Column) -> Column:
    """Rows of unknown time come first, in a bucket of their own."""
    return F.coalesce(bucket, F.lit(-(1 << 40)).cast("long"))


@dataclass(frozen=True)
class Chunked:
    """Rows laid out by chunk; `w` is the window every frame derives from."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, _CHUNK).orderBy(self.order)

    def position(self) -> Column:
        """0-based row number in the whole group: rows before the chunk's first row, which starts a
        bucket, plus the row's place in the chunk."""
        first = F.first(_BEFORE).over(self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return first + F.row_number().over(self.w) - 1

    @property
    def chunk_keys(self) -> list[str]:
        return [*self.keys, _CHUNK]

    def owned(self, df: DataFrame) -> DataFrame:
        """Drop borrowed rows and every helper column (leading underscore)."""
        return restored_keys(df.filter(_OWN)).drop(*[c for c in df.columns if c.startswith("_")])


def halo_chunks(
    df: DataFrame,
    back: int,
    ahead: int = 0,
    keys: tuple[str, ...] = KEYS,
    order: str = TIME,
    bucket: Column | None = None,
    renewed: Column | None = None,
) -> Chunked:
    """Cut groups into chunks that reach `back` rows back and `ahead` rows ahead.

    With `renewed`, an aggregate that counts the rows of a bucket which surely give a recursion a new input,
    the look-back counts such rows only: it reaches through stretches without any, however long.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = _conf_int(df, CHUNK_ROWS_CONF, DEFAULT_CHUNK_ROWS)
    least = min(most, max(MIN_CHUNK_ROWS, 2 * (back + ahead)))
    df = stand_in_keys(df, keys)
    bucket = time_bucket(df, order) if bucket is None else bucket
    df = df.withColumn(_BUCKET, known_bucket(bucket))

    before, n, size = F.col(_BEFORE), F.col("_n"), F.col("_size")
    chunk_of = lambda row: F.floor(row / size)
    rows = _conf_int(df, BUCKET_ROWS_CONF, DEFAULT_BUCKET_ROWS)
    new = (F.lit(0) if renewed is None else F.least(renewed, F.lit(rows))).cast("long")
    counts = df.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_n"), new.alias("_new"))
    sized = counts.withColumns({"_rows": F.col("_n"), "_widest": F.col("_n"), "_tail": F.col("_n")})
    earlier = carried(sized, keys, _BUCKET, {"_n": "sum", "_new": "sum"}, {"_rows": "sum", "_widest": "max", "_tail": "last"})
    earlier = earlier.withColumnsRenamed({"_n": _BEFORE, "_new": "_new_before"}).na.fill(0, [_BEFORE, "_new_before"])
    if not back:
        reached = F.col("_home")
    elif renewed is None:
        reached = F.least(chunk_of(before + n + back - 1), chunk_of(F.col("_rows") - F.col("_tail")))
    else:
        reached = F.max("_home").over(Window.partitionBy(*keys).orderBy("_new_before").rangeBetween(Window.currentRow, back + rows))
    layout = (
        counts.join(earlier, [*keys, _BUCKET])
        # short groups are cut finer, as long as the halo stays a fraction of the chunk
        .withColumn("_size", F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("_rows") / parts))))
        .withColumn("_home", chunk_of(before))
        .withColumns(
            {
                # first chunk whose look-ahead may reach this bucket
                "_lo": F.greatest(F.lit(0), chunk_of(before - F.col("_widest") - ahead)) if ahead else F.col("_home"),
                # last chunk whose look-back may reach it
                "_hi": reached,
            }
        )
        .select(*keys, _BUCKET, _BEFORE, "_home", "_lo", "_hi")
    )
    spread = (
        df.join(layout, [*keys, _BUCKET])
        .withColumn(_CHUNK, F.explode(F.sequence(F.least("_lo", "_home"), F.greatest("_hi", "_home"))))
        .withColumn(_OWN, F.col(_CHUNK) == F.col("_home"))
        .drop("_home", "_lo", "_hi", _BUCKET)
        # chunks are even, so hashing them balances; merging partitions by bytes would undo the cut
        .repartition(parts, *keys, _CHUNK)
    )
    return Chunked(spread, tuple(keys), order)
