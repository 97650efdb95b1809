"""What the operators share: staged tables, table reading, and words as bytes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.staging import checkpoint_dir

SALT = 32


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; it is deleted when the JVM ends."""
    path = f"{checkpoint_dir(spark)}/barloom-llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    files.deleteOnExit(place)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete what `staged` wrote for these tables; nothing may read them any more."""
    for df in tables:
        drop_folder(df.sparkSession, df.staged_at)


def share_file(spark: SparkSession, image: bytes, kind: str) -> str:
    """Hand a small file to all executors, present and future, by way of the shared folder.

    Spark copies it to a folder of each executor; returns the name to ask SparkFiles for.
    """
    name = f"{kind}-{hashlib.sha256(image).hexdigest()[:24]}.bin"
    if not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        path = f"{shared_folder(spark, kind)}/{name}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
        stream.write(bytearray(image))
        stream.close()
        spark.sparkContext.addFile(path)
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table has. A null text is empty."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def schema(**fields: str) -> T.StructType:
    """A schema from names and DDL types."""
    return T.StructType([T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields.items()])


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], by: Column) -> DataFrame:
    """Inner join with a small right side of one row a key, on a key that many left rows share: those are dealt over SALT copies."""
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(copies, [*on, "_salt"]).drop("_salt")


def integer_divided(a: Column, b: Column) -> Column:
    """The whole part of a quotient of integers or decimals, as a long."""
    return F.call_function("div", a, b)
