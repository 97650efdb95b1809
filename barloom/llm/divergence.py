"""How far the sources of a language differ, term by term and pair by pair, with exact integer arithmetic.

A term's share is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), its divergence f = floor((p - q)^2 / (p + q)); both depend on counts alone.
So the terms of a group are gathered into cells of equal (group count, language count), f is evaluated once for each cell, cells of equal
f are merged, and the running multiplicity of the cells says which ones hold the first ranks; only those are expanded to terms, in
UTF-8 order. A pair of sources has cells of (count here, count there) in the same way, counted in blocks of terms and tiles
of sources, so that no task holds a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import integer_divided as _div
from barloom.llm.shared import salted, schema, staged, table

SCALE, LEAST_DOCS, RANKS = 10**9, 10, 10
HELD = 1 << 19  # distinct (group, term) entries that a worker gathers before it hands them on
BLOCK, TILE = 4096, 64  # terms and sources of one task's share of the pair sums
GROUP = ["lang", "source"]

#: ASCII letters in lower case, and bytes of characters beyond ASCII; anything else separates.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, text) to (lang, source, term, n, docs): occurrences, and documents with the term, in each group.

    Nulls are empty strings. Every group also has one row of a null term, so groups without terms are known. Each document
    row counts, also one that repeats another.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.encode("utf-8", "replace").translate(TERM_BYTES).split()
                n, rows = found.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                rows.update(set(terms))
                if sum(len(n) for n, _ in found.values()) > HELD:
                    yield from handed(found)
                    found.clear()
        yield from handed(found)

    def handed(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, rows) in found.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            k = len(terms)
            columns = [pa.array([lang] * k), pa.array([source] * k), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(rows.__getitem__, n)], pa.int64())]
            yield from pa.Table.from_arrays(columns, [*GROUP, "term", "n", "docs"]).to_batches(1 << 16)

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    parts = texts.mapInArrow(count, schema(lang="string", source="string", term="string", n="bigint", docs="bigint"))
    return parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, terms: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)); the long division in steps of 1000 stays inside a long."""
    rest, whole = count + 2, total + 2 * terms
    out = F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, whole), F.pmod(rest, whole)
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def shares(counts: np.ndarray, terms: int, total: int) -> np.ndarray:
    """`share` of many counts."""
    rest, whole = counts.astype(np.int64) + 2, np.int64(total + 2 * terms)
    out = np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


class Vocabulary:
    """The staged tables that both parts read.

    kept: (lang, term, total): terms in at least LEAST_DOCS documents of the language, and their occurrences there.
    cells: (lang, source, term, n, total): occurrences of kept terms in the groups that have them.
    groups: (lang, source, group_n, terms, lang_n): every group, with its and its language's sums over kept terms, and V.
    """

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        counts = staged(term_counts(docs), "term-counts")
        by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        self.kept = staged(by_term.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
        self.counts = staged(counts.select(*GROUP, "term", "n").join(self.kept, ["lang", "term"]).select(*GROUP, "term", "n", "total"), "kept-counts")
        groups = counts.where("term IS NULL").select(*GROUP)
        sums = self.counts.groupBy(*GROUP).agg(F.sum("n").alias("group_n"))
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
        known = groups.join(sums, GROUP, "left").join(langs, "lang", "left")
        self.groups = staged(known.na.fill(0, ["group_n", "terms", "lang_n"]), "groups")


def leading_terms(vocabulary: Vocabulary, ranks: int = RANKS) -> DataFrame:
    """The terms of each group that lead over the language: (lang, source, item, value, rank), ranks to `ranks`.

    Cells of equal f are one value. Of the values, greatest first, those are expanded whose running multiplicity has not passed
    `ranks` before them; at most `ranks` values of a group and as many terms of a value go on, so a value may hold any number of terms.
    """
    cells = vocabulary.counts.groupBy(*GROUP, "n", "total").agg(F.count("*").alias("many"))
    cells = salted(cells, vocabulary.groups, GROUP, F.struct("n", "total"))
    p, q = share(F.col("n"), F.col("terms"), F.col("group_n")), share(F.col("total"), F.col("terms"), F.col("lang_n"))
    cells = cells.withColumns({"_p": p, "_q": q}).where("_p > _q").withColumn("value", divergence(F.col("_p"), F.col("_q")))
    cells = staged(cells.select(*GROUP, "n", "total", "many", "value"), "cells")
    greatest = Window.partitionBy(*GROUP).orderBy(F.col("value").desc())
    values = cells.groupBy(*GROUP, "value").agg(F.sum("many").alias("many"))
    values = values.withColumn("_place", F.row_number().over(greatest)).where(F.col("_place") <= ranks)
    before = F.coalesce(F.sum("many").over(greatest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = staged(values.withColumn("before", before).where(F.col("before") < ranks).select(*GROUP, "value", "before"), "values")
    chosen = staged(cells.join(values, [*GROUP, "value"]).select(*GROUP, "n", "total", "value", "before"), "chosen-cells")
    terms = salted(vocabulary.counts, chosen, [*GROUP, "n", "total"], F.col("term"))
    inside = Window.partitionBy(*GROUP, "value").orderBy("term")
    terms = terms.withColumn("_place", F.row_number().over(inside)).where(F.col("_place") <= ranks)
    return terms.withColumn("rank", (F.col("before") + F.col("_place")).cast("int")).where(F.col("rank") <= ranks).select(*GROUP, F.col("term").alias("item"), "value", "rank")


def pair_divergence(vocabulary: Vocabulary) -> DataFrame:
    """The divergence of each two sources of a language over all kept terms: (lang, source, item, value, rank), both ways round.

    The terms of a language are dealt into blocks and its sources into tiles; a task has one block and two tiles, counts the
    cells of each pair, and hands on a sum for each. Terms that neither source has are one more cell, added at the end.
    """
    sizes = vocabulary.groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.count("*") / TILE), F.lit(1)).cast("int").alias("tiles"), F.greatest(F.ceil(F.max("terms") / BLOCK), F.lit(1)).cast("int").alias("blocks")
    )
    groups = staged(vocabulary.groups.join(sizes, "lang"), "tiled")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    heads = groups.select(*GROUP, "group_n", "terms", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("*", other)
    heads = heads.select(*GROUP, "block", tile.alias("tile"), "other", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "group_n", "terms")
    placed = salted(vocabulary.counts, groups.select(*GROUP, "tiles", "blocks"), GROUP, F.col("term"))
    rows = placed.select(*GROUP, F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), tile.alias("tile"), other, "term", "n", F.lit(0).cast("long").alias("group_n"), F.lit(0).cast("long").alias("terms"))
    both = heads.unionByName(rows).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame["term"].isna()
        sources = frame[head].reset_index(drop=True)
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        column = pd.Series(range(len(sources)), index=sources["source"])
        cells = frame[~head]
        code, _ = pd.factorize(cells["term"])
        counts = np.zeros((len(sources), int(code.max()) + 1 if len(cells) else 0), np.int64)
        counts[cells["source"].map(column).to_numpy(np.int64), code] = cells["n"]
        out = []
        for i, j in combined(sources["tile"].to_numpy(), low, high):
            a, b = sources.iloc[i], sources.iloc[j]
            if not a["terms"]:
                out.append((a["lang"], a["source"], b["source"], 0, 0, 0))
                continue
            width = int(counts[j].max(initial=0)) + 1
            cell, many = np.unique(counts[i] * width + counts[j], return_counts=True)
            p, q = shares(np.append(cell // width, 0), a["terms"], a["group_n"]), shares(np.append(cell % width, 0), b["terms"], b["group_n"])
            f = (p - q) ** 2 // (p + q)
            out.append((a["lang"], a["source"], b["source"], int((f[:-1] * many).sum()), int(many.sum()), int(f[-1])))
        return pd.DataFrame(out, columns=["lang", "source", "item", "value", "seen", "unseen"])

    parts = both.groupBy("lang", "block", "low", "high").applyInPandas(sums, schema(lang="string", source="string", item="string", value="bigint", seen="bigint", unseen="bigint"))
    pairs = parts.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("unseen").alias("unseen"))
    whole = pairs.join(groups.groupBy("lang").agg(F.max("terms").alias("terms")), "lang")
    whole = staged(whole.select(*GROUP, "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("unseen")).alias("value")), "pairs")
    turned = whole.unionByName(whole.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    return turned.select(*GROUP, "item", "value", F.row_number().over(order).alias("rank"))


def combined(tiles: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs of sources of the two tiles, or of the one."""
    first, second = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
    for i in first:
        for j in second if low != high else first[first > i]:
            yield int(i), int(j)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """Rows with lang, source and text to (lang, source, part, item, value, rank), the parts being `pair` and `term`.

    Null columns are empty strings, which are a language or source like any other. Repeated rows count each. A language
    without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Other columns are not read.
    """
    vocabulary = Vocabulary(docs, least_docs)
    parts = [d.withColumn("part", F.lit(part)) for part, d in (("pair", pair_divergence(vocabulary)), ("term", leading_terms(vocabulary, ranks)))]
    return parts[0].unionByName(parts[1]).select(*GROUP, "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counts AS (SELECT w.lang, source, term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY w.lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (group_n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (lang_n + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // (s.p + t.p)) AS value
    FROM full_counts s JOIN full_counts t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM full_counts WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
