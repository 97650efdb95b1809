"""File-level scans and sinks around the feature table, predictions and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.columns import is_target
from barloom.functions.nulls import narrow_for_sink
from barloom.schema import KEYS, TIME


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """All predictions_*.parquet below a root; every file has to carry the expert."""
    df = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "predictions_*.parquet")
        .option("mergeSchema", True)
        .parquet(root)
    )
    if "expert" not in df.columns:
        raise ValueError("prediction files lack the column 'expert'")
    return df


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The summary file, else <period>/<target>_importances.csv with both taken from the path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(f"{root}/summary.csv", header=True, inferSchema=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    raw = spark.read.csv(f"{root}/*/*_importances.csv", header=True, inferSchema=True)
    path = F.input_file_name()
    return raw.drop("period", "target").select(
        "*",
        F.regexp_extract(path, r"([^/]+)/[^/]+_importances\.csv", 1).alias("period"),
        F.regexp_extract(path, r"([^/]+)_importances\.csv", 1).alias("target"),
    )


def write_long_table(df: DataFrame, path: str, narrow: bool = True, periods: Sequence[str] = ()) -> None:
    """Parquet partitioned by period, optionally only some periods, narrowed to 32 bits."""
    out = df.filter(F.col("period").isin(*periods)) if periods else df
    (narrow_for_sink(out) if narrow else out).write.mode("overwrite").partitionBy("period").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def csv_to_parquet(spark: SparkSession, source: str, target: str, periods: Sequence[str] = ()) -> None:
    df = spark.read.csv(source, header=True, inferSchema=True)
    write_long_table(df, target, narrow=False, periods=periods)


def slim(df: DataFrame, added: Sequence[str]) -> DataFrame:
    """Keys, prices, the added columns and the labels, as far as they exist."""
    wanted = [TIME, "datetime", *KEYS, "time_idx", "open", "high", "low", "close", "volume", *added]
    wanted += [c for c in df.columns if is_target(c) or c == "logreturn_pct_rank"]
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def write_names(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """One name per line, on whatever storage Spark writes to."""
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """One name per line; # starts a comment line."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"))
    return [r["name"] for r in lines.filter("name <> '' and not startswith(name, '#')").collect()]


def new_bars(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Arriving bars later than the last stored one of their group, once each.

    The stored side is read only as max(time) per group, combined map-side.
    """
    last = stored.groupBy(*KEYS).agg(F.max(TIME).alias("_last"))
    fresh = arriving.join(last, list(KEYS), "left").filter(F.col("_last").isNull() | (F.col(TIME) > F.col("_last")))
    return fresh.drop("_last").dropDuplicates([*KEYS, TIME])


def append_bars(arriving: DataFrame, path: str) -> None:
    """Resume a stored bar table: only bars past the stored end are added."""
    spark = arriving.sparkSession
    stored = spark.read.parquet(path)
    new_bars(arriving, stored).write.mode("append").partitionBy("period").parquet(path)


def file_report(df: DataFrame, target_cols: Sequence[str]) -> DataFrame:
    """Per source file: rows, duplicate times, order, step mismatch share, worst label gap, trainable."""
    from barloom.functions.times import period_ms
    from barloom.operators.audits import _steps

    rows = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.greatest(*[F.avg(F.col(t).isNull().cast("double")) for t in target_cols], F.lit(0.0)).alias("max_target_null"),
    )
    steps = _steps(df).withColumn("_bad", (F.col(TIME) - F.col("prev_ts") != period_ms(F.col("period"))).cast("double"))
    time = steps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_unique"), F.coalesce(F.avg("_bad"), F.lit(0.0)).alias("step_mismatch"))
    return rows.join(time, list(KEYS)).select(
        *KEYS,
        "rows",
        "columns",
        (F.col("rows") - F.col("_unique")).alias("duplicate_ts"),
        "step_mismatch",
        "max_target_null",
        ((F.col("rows") == F.col("_unique")) & (F.col("max_target_null") < 0.5)).cast("int").alias("trainable"),
    )


def schema_check(spark: SparkSession, tables: dict[str, DataFrame], baseline: str) -> DataFrame:
    """Same columns and same order as the baseline table, per table."""
    want = tables[baseline].columns
    rows = [(n, len(t.columns), set(t.columns) == set(want), t.columns == want) for n, t in tables.items()]
    return spark.createDataFrame(rows, "name string, columns int, same_set boolean, same_order boolean")
