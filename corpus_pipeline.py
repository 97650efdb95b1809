"""From raw documents to token counts: score, deduplicate, decontaminate, mask, encode.

Each stage is written as Parquet and read again before the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import bpe, pii, quality, shingles, winnow
from barloom.llm.shared import drop_staged, id_and_text, staged, table, unused_name


#: Labelled rows that the classifier learns from, at most: their ids are sent to all tasks.
LEARNED = 20_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1. It learns from LEARNED labelled rows at most, the first by a hash of their id; rows are judged by their text alone."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~quality.held_out(F.col("doc_id")))
    labels = staged(labels.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(LEARNED), "labels")
    texts = id_and_text(docs).join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")  # LEARNED ids at most
    stats = staged(quality.document_statistics(texts), "statistics")  # written first, so that a task holds one Python worker
    model = quality.fit(stats, labels)
    drop_staged(labels, stats)
    return docs.where(quality.accepted(F.col("text"), model))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest doc_id; of its rows with equal doc_id, the first by text.

    Near duplicates share four fifths of their sets of five-word shingles; SimHash finds them, and min-hash buckets those beyond its
    radius. A row goes only because of a row of its own group.
    Rows without a doc_id stay: no group can name them.
    """
    told = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    groups = shingles.near_duplicates(docs.select(F.unhex(told).alias("name"), F.coalesce("text", F.lit("")).alias("text")))
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", told.alias("name"), F.col("text").isNull().alias("unknown"))
    grouped = groups.select(F.lower(F.hex("name")).alias("name"), F.concat(F.lit("="), F.col("component").cast("string")).alias("component"))
    rows = known.join(grouped, "name", "left").withColumn("component", F.coalesce("component", "name"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "unknown", "name")).alias("least"))
    name, place = unused_name(docs, "name"), unused_name(docs, "place")
    chosen = staged(first.select(F.col("least.doc_id").alias("doc_id"), F.col("least.name").alias(name)), "chosen")
    drop_staged(groups)
    kept = docs.withColumn(name, told).join(chosen, ["doc_id", name], "left_semi")
    order = Window.partitionBy("doc_id", name).orderBy(F.col("text").asc_nulls_last())  # the rows of a join on these keys stay where they are
    once = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
    return once.unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return docs.where(~winnow.contaminated(F.col("text"), winnow.benchmark_items(spark, sf_dir)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, gives way to its kind; n_chars follows."""
    return docs.withColumn("text", pii.masked(F.col("text"))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(id_and_text(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_distinct),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("BPE encoding and decoding", encode),
]

#: SQL has neither the discriminant nor XXH64; the tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
