"""Row and column pruning by completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barloom.columns import feature_candidates


def prune_rows(
    df: DataFrame,
    cols: Sequence[str],
    how: str,
    min_k: int | None = None,
    min_ratio: float | None = None,
    periods: Sequence[str] = (),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Keep rows by how many of the columns are known: all (`any` missing drops), at least one (`all`),
    at least k (`thresh_k`) or a share (`thresh_ratio`). Other periods than the listed stay whole."""
    df = df.drop(*drop)
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    n = len(cols)
    known = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    need = {
        "any": known == n,
        "all": known > 0,
        "thresh_k": known >= int(min_k or max(1, n // 4)),
        "thresh_ratio": known / F.lit(float(n)) >= float(min_ratio or 0.5),
    }
    if how not in need:
        raise ValueError(f"unknown rule {how!r}")
    keep = need[how]
    return df.filter(keep | ~F.col("period").isin(*periods)) if periods else df.filter(keep)


def feature_projection(df: DataFrame, allow: Sequence[str] | None = None) -> DataFrame:
    """Candidate features with at least one known value; one counting pass decides."""
    names = feature_candidates(df.columns, allow)
    known = df.agg(*[F.count(c).alias(c) for c in names]).first()
    keys = [c for c in ("timestamp", "symbol", "period") if c in df.columns]
    return df.select(*keys, *[c for c in names if known[c]])


def resolution_report(df: DataFrame, experts: dict[str, dict[str, Sequence[str]]], synonyms: dict[str, Sequence[str]]) -> DataFrame:
    """Per expert, channel and wanted name: the resolved column and how much of it is known."""
    have = set(df.columns)
    wanted = []
    for expert, channels in experts.items():
        for channel, names in channels.items():
            for name in names:
                hit = next((c for c in (name, *synonyms.get(name, ())) if c in have), None)
                wanted.append((expert, channel, name, hit))
    used = sorted({w[3] for w in wanted if w[3]})
    known = df.agg(*[F.count(c).alias(c) for c in used]).unpivot([], used, "resolved", "known")
    plan = df.sparkSession.createDataFrame(wanted, "expert string, channel string, source string, resolved string")
    return plan.join(known, "resolved", "left")


def fill_gaps(df: DataFrame, cols: Sequence[str], backward: bool = False) -> DataFrame:
    """Forward fill per group, optionally backward, then zero.

    Backward filling copies future values back, so it is off unless asked for.
    """
    from barloom.operators.chunks import time_bucket
    from barloom.operators.joins import hold_last
    from barloom.operators.scan import bucketed_scan
    from barloom.schema import KEYS

    out = hold_last(df, cols, lag=0)
    if backward:
        work = out.withColumns({"_minus": -F.col("timestamp"), "_bucket": -time_bucket(out)})
        work = bucketed_scan(work, KEYS, ["_minus"], "_bucket", lasts={f"_b_{c}": F.col(c) for c in cols})
        out = work.withColumns({c: F.col(f"_b_{c}") for c in cols}).drop("_minus", "_bucket", *[f"_b_{c}" for c in cols])
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


def fill_counts(df: DataFrame, filled: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many unknown values each column had before and after filling."""
    before = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).unpivot([], list(cols), "column", "before")
    after = filled.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).unpivot([], list(cols), "column", "after")
    return before.join(after, "column")
