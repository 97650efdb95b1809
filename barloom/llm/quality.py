"""A quality score from document statistics: regularised quadratic discriminant analysis.

Statistics of whole texts (shares of character classes, shapes of words and lines, repetition) are transformed towards
normality. Each class has a mean and a covariance, shrunk towards the pooled covariance and towards a scaled identity; the score is
the posterior of the log densities, whose Mahalanobis distances use Cholesky factors computed once. Means and covariances
come from sums over all labelled rows, aggregated in Spark; the driver sees one small matrix per class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import id_and_text, schema, staged, table

FOLDS, THRESHOLD = 5, 0.3
POOLED, IDENTITY = 0.2, 0.02  # shrinkage of a class covariance towards the pooled one, and of that towards the identity
BLOCK = 1 << 16  # bytes compressed at a time

NAMES = (
    "log_chars", "upper", "digit", "space", "line_breaks", "beyond_ascii", "stops", "commas", "marks", "bars", "symbols", "quotes", "word_length", "word_spread", "long_words", "distinct_words",
    "commonest_word", "repeated_next", "word_ends", "shouted_words", "line_length", "distinct_lines", "commonest_line", "short_lines", "compressed", "character_entropy", "worst_words",
)
UPPER, DIGIT = slice(65, 91), slice(48, 58)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES; an empty text has its own fixed values."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / n
    letters = max(1, int(counts[UPPER].sum() + counts[97:123].sum()))
    words = raw.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally = Counter(words)
    top = max(tally.values(), default=0)
    following = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd_ends = sum(not (x[-1:].isalnum() or x[-1] >= 128) for x in words)
    shouted = sum(x.isupper() and len(x) > 1 for x in words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = Counter(lines)
    packed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))
    seen = share[share > 0]
    odd = b"!#$%&*|=~^<>_{}[]\\/@"
    worst = max((_odd_share(x, odd) for x in lines), default=0.0)
    root = np.sqrt
    return [
        np.log1p(len(raw)), root(counts[UPPER].sum() / letters), root(share[DIGIT].sum()), root(share[32]), root(share[10]), root(share[128:].sum()), root(share[46]), root(share[44]),
        root(share[33] + share[63]), root(share[124]), root(sum(share[b] for b in b"#$%&*=~^<>_{}[]\\/@")), root(share[34] + share[39]), np.log1p(sizes.mean()), np.log1p(sizes.std()),
        root((sizes > 20).sum() / w), root(len(tally) / w), root(top / w), root(following / w), root(odd_ends / w), root(shouted / w), np.log1p(len(raw) / max(1, len(lines))),
        len(kinds) / max(1, len(lines)), root(max(kinds.values(), default=0) / max(1, len(lines))), root(sum(len(x) < 30 for x in lines) / max(1, len(lines))), packed / n,
        float(-(seen * np.log2(seen)).sum()), root(worst),
    ]


def _odd_share(line: bytes, odd: bytes) -> float:
    """The share of a line's words that hold an odd mark, shout, or repeat the word before."""
    words = line.split()
    if len(words) < 8:
        return 0.0
    marked = len(words) - sum(len(x) == len(x.translate(None, odd)) for x in words)
    shouted = sum(x.isupper() and len(x) > 2 for x in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return max(marked, shouted, again) / len(words)


def document_statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, x): the transformed statistics."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": [statistics(t) for t in frame["text"]]})

    return docs.mapInPandas(run, schema(doc_id="bigint", x="array<double>"))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, and log density offsets, for labels 0 and 1."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of label 1 for rows of statistics."""
        z = (x - self.centre) / self.scale
        log = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def discriminant(counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Fit from a count, a sum and a sum of outer products per class. A class without rows takes the pooled shape at its mean."""
    d, total = len(NAMES), sum(counts)
    centre = sum(sums) / total if total else np.zeros(d)
    spread = np.sqrt(np.maximum(np.diag(sum(squares)) / total - centre**2, 0)) if total else np.ones(d)
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, shapes = [], []
    for n, s, q in zip(counts, sums, squares, strict=True):
        mean = s / n if n else centre
        means.append((mean - centre) / scale)
        shapes.append((q - n * np.outer(mean, mean)) / np.outer(scale, scale) if n else np.zeros((d, d)))
    common = sum(shapes) / max(total, 1)
    whiten, offsets = [], []
    for n, shape in zip(counts, shapes, strict=True):
        own = (1 - pooled) * shape / max(n, 1) + pooled * common
        own = (1 - identity) * own + identity * np.eye(d) * max(float(np.trace(own)) / d, 1e-6)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        offsets.append(float(np.log((n + 1) / (total + 2)) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(whiten), tuple(offsets), centre, scale)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text leaves no remainder; a null doc_id is held out, as it can have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from all labelled rows that are not held out. Labels other than 0 and 1 are left out; repeated labels all count."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    rows = stats.join(known, "doc_id").select("quality", "x")
    d = len(NAMES)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments = np.zeros((2, 1 + d + d * d))
        for frame in frames:
            x, y = np.array(frame["x"].tolist()).reshape(-1, d), frame["quality"].to_numpy()
            for label in (0, 1):
                own = x[y == label]
                moments[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], moments.shape[1]), "place": np.tile(np.arange(moments.shape[1]), 2), "value": moments.ravel()})

    total = rows.mapInPandas(sums, schema(label="int", place="int", value="double")).groupBy("label", "place").agg(F.sum("value").alias("value"))
    moments = np.zeros((2, 1 + d + d * d))
    for r in total.collect():  # 2 (1 + d + d²) numbers
        moments[r.label, r.place] = r.value
    return discriminant(moments[:, 0].tolist(), list(moments[:, 1 : 1 + d]), list(moments[:, 1 + d :].reshape(2, d, d)))


def scored(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, x) to (doc_id, held_out, score, predicted)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.score(np.array(frame["x"].tolist()).reshape(-1, len(NAMES)))})

    out = stats.mapInPandas(run, schema(doc_id="bigint", score="double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(text: Column, model: Discriminant, threshold: float = THRESHOLD) -> Column:
    """Whether a text scores at least the threshold; a null text as an empty one."""

    @F.pandas_udf("boolean")
    def accept(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts]).reshape(-1, len(NAMES))) >= threshold)

    return accept(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with labels (doc_id, quality) to (doc_id, held_out, score, predicted). Null texts are scored as empty ones.

    Without any usable label every score is 0.5. Repeated rows each have their row.
    """
    stats = staged(document_statistics(docs), "statistics")
    return scored(stats, fit(stats, labels))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(id_and_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
