"""Nearest neighbours by inner product, from a vantage-point tree per shard.

Inner products become distances: with R the largest norm, a vector v is lifted to (v, sqrt(R² - |v|²)) and a query q to
(q, 0); the squared distance is then R² + |q|² - 2 q·v, so the nearest lifted vectors are those of largest inner product. Each
shard, a bounded number of vectors dealt out by hash, builds a tree: a vantage point, the median distance to it, the nearer half
and the farther half. A block of queries descends together; for each a half is passed over if the triangle inequality, with
the bound multiplied by ``factor``, says that it holds nothing nearer than the k-th found so far. Factor 1 is exact; a smaller one
shrinks the search ball and trades recall for speed.

Equal vectors are one point of a tree with all their ids. Queries meet shards in blocks, and each meeting returns at most k
rows a query. A first round searches one shard per query; its k-th score then bounds the search in all other shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import schema, staged, table

SHARD, QUERIES = 16384, 2048  # vectors of a shard, and queries of a block
LEAF = 256
NEAREST = 20
SLACK = 1e-9  # of the scale of distances, for rounding


class Tree:
    """A vantage-point tree over distinct lifted vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radius: float, leaf: int | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, place = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        owners = np.argsort(place.ravel(), kind="stable")
        self.ids, self.bounds = ids[owners], np.concatenate([[0], np.cumsum(np.bincount(place.ravel(), minlength=len(first)))])
        self.points, self.leaf, self.radius = vectors[first], leaf or LEAF, radius
        norms = np.einsum("ij,ij->i", self.points, self.points)
        self.lifted = np.concatenate([self.points, np.sqrt(np.maximum(radius**2 - norms, 0))[:, None]], axis=1)
        self.norms = np.einsum("ij,ij->i", self.lifted, self.lifted)
        self.root = self._build(np.arange(len(first)))

    def _build(self, members: np.ndarray):
        """(members) of a leaf, or (vantage point, greatest inner distance, least outer distance, inner, outer)."""
        if len(members) <= self.leaf:
            return members
        spread = self.lifted[members] - self.lifted[members].mean(axis=0)
        vantage = members[np.einsum("ij,ij->i", spread, spread).argmax()]  # far from the middle, where distances differ most
        far = self._distances(self.lifted[vantage][None], self.norms[vantage][None], members)[0]
        order = np.argsort(far, kind="stable")
        half = len(members) // 2
        return vantage, far[order[half - 1]], far[order[half]], self._build(members[order[:half]]), self._build(members[order[half:]])

    def _distances(self, queries: np.ndarray, norms: np.ndarray, members: np.ndarray) -> np.ndarray:
        squared = norms[:, None] + self.norms[members] - 2 * (queries @ self.lifted[members].T)
        return np.sqrt(np.maximum(squared, 0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of the k best of each query, its own id apart. least: scores below which nothing matters."""
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        norms = np.einsum("ij,ij->i", queries, queries)
        scale = self.radius**2 + norms
        found_score = np.full((len(queries), k), -np.inf)
        found_id = np.full((len(queries), k), np.iinfo(np.int64).max)

        def ball(rows: np.ndarray) -> np.ndarray:
            """The distance within which a better one must lie."""
            worst = np.maximum(found_score[rows, -1], least[rows])
            return np.sqrt(np.maximum(scale[rows] - 2 * worst, 0) + SLACK * np.maximum(scale[rows], 1e-30)) + 1e-7 * np.sqrt(scale[rows])

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                self._leaf(node, rows, query_ids, queries, found_score, found_id, least, k)
                return
            vantage, inner, outer, near, far = node
            d = self._distances(lifted[rows], norms[rows], np.array([vantage]))[:, 0]
            inside = d * 2 <= inner + outer
            visit(near, rows[inside])
            visit(far, rows[~inside])
            again = inside & (d + factor * ball(rows) >= outer)
            visit(far, rows[again])
            again = ~inside & (d - factor * ball(rows) <= inner)
            visit(near, rows[again])

        visit(self.root, np.arange(len(queries)))
        row, place = np.nonzero(found_score > -np.inf)
        return row, found_id[row, place], found_score[row, place]

    def _leaf(self, members, rows, query_ids, queries, found_score, found_id, least, k) -> None:
        """Points of a leaf that may beat a query's k-th are scored in a fixed order of addition, so equal vectors score alike."""
        rough = queries[rows] @ self.points[members].T
        worst = np.maximum(found_score[rows, -1], least[rows])
        margin = 1e-12 * (1 + np.sqrt(np.einsum("ij,ij->i", queries[rows], queries[rows])) * self.radius)
        if len(members) > k + 1:  # none below the leaf's own k-th, the query's own vector apart, can be among the k best
            worst = np.maximum(worst, np.partition(rough, len(members) - k - 1, axis=1)[:, len(members) - k - 1])
        may = rough >= (worst - margin)[:, None]
        for q in np.flatnonzero(may.any(axis=1)).tolist():
            row = rows[q]
            ids, scores = [found_id[row]], [found_score[row]]
            hits = members[may[q]]
            exact = exact_products(queries[row], self.points[hits])
            for point, score in zip(hits.tolist(), exact.tolist(), strict=True):
                own = self.ids[self.bounds[point] : self.bounds[point + 1]][: k + 1]  # in order: beyond k of equal score none counts
                own = own[own != query_ids[row]][:k]
                ids.append(own)
                scores.append(np.full(len(own), score))
            ids, scores = np.concatenate(ids), np.concatenate(scores)
            best = np.lexsort((ids, -scores))[:k]
            found_id[row], found_score[row] = ids[best], scores[best]


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component to the last."""
    total = np.zeros(len(vectors))
    for x, column in zip(query.tolist(), vectors.T, strict=True):
        total += x * column
    return total


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v, norm) of vectors that are not null or zero and have no null or non-finite component."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    given = given.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return given.where(sound).withColumn("norm", norm).where("norm > 0")


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, factor: float = 1.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """Vectors (vec_id, embedding) to (query_id, rank, vec_id, score): the k largest inner products of each query.

    is_query: a condition on vec_id. Only vectors of a query's length are its candidates. Ties go to the smaller vec_id. Repeated
    rows count once; an id with several vectors takes part with each. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    vectors = staged(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    facts = vectors.agg(F.count("*").alias("n"), F.max("norm").alias("radius"), F.count(F.when(is_query, 1)).alias("queries")).first()
    shards, blocks = max(1, -(-facts.n // shard)), max(1, -(-facts.queries // block))
    radius = float(facts.radius or 0.0)
    members = vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    queries = vectors.where(is_query).select(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    home = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(shards)).cast("int")
    first = _meet(members, queries.withColumn("shard", home).withColumn("least", F.lit(float("-inf"))), k, factor, radius)
    if shards > 1:
        first = staged(first, "first")
        worst = first.groupBy("query_id", "size").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).select("query_id", "size", "worst")
        other = queries.withColumn("size", F.size("q")).join(worst, ["query_id", "size"], "left").withColumn("least", F.coalesce("worst", F.lit(float("-inf"))))
        other = other.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
        first = first.unionByName(_meet(members, other.select("block", "query_id", "q", "shard", "least"), k, factor, radius))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _meet(members: DataFrame, queries: DataFrame, k: int, factor: float, radius: float) -> DataFrame:
    """Each block of queries searches the shards that it is sent to. A shard goes to as many tasks as it has blocks of queries."""
    sent = queries.select("shard", "block").distinct()
    left = members.join(sent, "shard").select("shard", "block", F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("least"))
    right = queries.select("shard", "block", F.col("query_id").alias("id"), F.col("q").alias("v"), "least")
    rows = left.unionByName(right)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        asking = frame["least"].notna().to_numpy()
        sizes = frame["v"].map(len).to_numpy()
        for size in np.unique(sizes[asking]):
            own, ask = frame[~asking & (sizes == size)], frame[asking & (sizes == size)]
            if not len(own):
                continue
            tree = Tree(own["id"].to_numpy(), np.stack(own["v"].to_numpy()).astype(np.float64), radius)
            ids = ask["id"].to_numpy()
            row, found, score = tree.search(ids, np.stack(ask["v"].to_numpy()).astype(np.float64), ask["least"].to_numpy(), k, factor)
            out.append(pd.DataFrame({"query_id": ids[row], "size": np.int32(size), "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "size": [], "vec_id": [], "score": []})

    return rows.groupBy("shard", "block").applyInPandas(search, schema(query_id="bigint", size="int", vec_id="bigint", score="double"))


def op2_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, x -> x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), z -> z[1] * z[2]), (a, b) -> a + b) AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
