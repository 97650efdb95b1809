"""One fused dataset per expert over one base: settings decide series, flags and null policy."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from barloom.operators import joins
from barloom.operators.audits import coverage, continuity, group_summary
from barloom.sources.staging import staged


@dataclass(frozen=True)
class FuseSettings:
    """Columns of the series to use (None means all) and what to do with incomplete rows."""

    symbol_columns: Sequence[str] | None = None
    global_columns: Sequence[str] | None = None
    fundamentals_only: bool = False
    rich: bool = False
    max_missing: float | None = None
    null_scope: str | None = None  # onchain, all_new or custom
    null_method: str = "intersect"
    null_columns: Sequence[str] = field(default_factory=tuple)


def _pick(series: DataFrame | None, keys: Sequence[str], wanted: Sequence[str] | None) -> DataFrame | None:
    if series is None or wanted is None:
        return series
    hit = [c for c in wanted if c in series.columns]
    return series.select(*keys, *hit) if hit else None


def fuse_one(bars: DataFrame, symbol_series: DataFrame | None, global_series: DataFrame | None, s: FuseSettings) -> DataFrame:
    sym = _pick(symbol_series, ("timestamp", "symbol"), s.symbol_columns)
    glo = None if s.fundamentals_only else _pick(global_series, ("timestamp",), s.global_columns)
    out = joins.fuse(bars, sym, glo)
    added = [c for c in out.columns if c not in bars.columns]
    onchain = [c for c in (glo.columns if glo is not None else []) if c in added]
    if s.rich:
        out = joins.with_rich_flags(joins.with_rich_columns(staged(out, "fused")))
        out = joins.winsorised_z(staged(out, "rich"), [c for c in joins.WINSORISED if c in out.columns])
    if s.max_missing is not None:
        out = joins.drop_sparse_rows(staged(out, "fused"), added, s.max_missing)
    scope = {"onchain": onchain, "all_new": added, "custom": list(s.null_columns)}
    if s.null_scope:
        out = joins.without_nulls(out, [c for c in scope[s.null_scope] if c in out.columns], s.null_method)
    return out


def expert_views(bars: DataFrame, symbol_series: DataFrame | None, global_series: DataFrame | None, experts: Mapping[str, Mapping], base: FuseSettings = FuseSettings()) -> Iterator[tuple[str, DataFrame]]:
    """(expert, dataset) pairs; an expert's settings overlay the common ones. The base is read, not copied."""
    for name, overlay in experts.items():
        yield name, fuse_one(bars, symbol_series, global_series, replace(base, **overlay))


def audit_views(views: Mapping[str, DataFrame], added: Sequence[str]) -> dict[str, DataFrame]:
    """Group summaries over all datasets, and per dataset coverage and continuity."""
    out = {}
    for name, df in views.items():
        present = [c for c in added if c in df.columns]
        out[f"{name}/summary"] = group_summary(df, name)
        out[f"{name}/continuity"] = continuity(df)
        if present:
            out[f"{name}/coverage"] = coverage(df, present)
    return out
