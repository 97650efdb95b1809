"""Delimited files with headers of their own, as one scan: every file's header is found in the scan, none is read by the driver.

A file below the root is named by its path up to and including `.csv`, so a folder of part files counts as one. A header is the first line
that has no number and no time in it. Fields hold no commas.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _fields(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "^﻿|\r$", ""), ",", -1), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))


def delimited_rows(spark: SparkSession, root: str, files: Column | None = None, pattern: str = "*.csv") -> DataFrame:
    """(file, part, header, fields) of every data line below the root; `files` is a condition on the column `file`.

    Lines longer or shorter than their header stay as they are. Blank lines are left out. A part without a header has no rows.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "", root).rstrip("/") + "/"
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    rows = text.select(F.substr(path, F.instr(path, base) + len(base)).alias("part"), F.col("_metadata.file_block_start").alias("_start"), _fields(F.col("value")).alias("fields"))
    rows = rows.withColumn("file", F.regexp_extract("part", r"^(.*?\.csv)", 1))
    rows = rows.where(F.exists("fields", lambda x: x != ""))
    if files is not None:
        rows = rows.where(files)
    valued = F.exists("fields", lambda x: x.try_cast("double").isNotNull() | x.try_cast("timestamp").isNotNull())
    numbered = rows.withColumn("_line", F.monotonically_increasing_id())
    headers = numbered.where((F.col("_start") == 0) & ~valued).groupBy("part").agg(F.min_by("fields", "_line").alias("header"))
    return rows.join(headers, "part").where(F.col("fields") != F.col("header")).select("file", "part", "header", "fields")


def field(name: Column | str) -> Column:
    """The field under the first header entry of this name, or of the first of several; NULL where there is none."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(F.array_contains("header", name), F.get("fields", (F.array_position("header", name) - 1).cast("int")))
