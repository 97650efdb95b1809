"""Name rules: what a column is, read from how it is called."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from barloom.schema import PERIODS

KEY_COLUMNS = ("timestamp", "datetime", "symbol", "period", "time_idx")

# The label names by kind.
CLASS_TARGETS = (
    "target_binarytrend",
    "target_drawdown_prob",
    "target_pullback_prob",
    "target_sideway_detect",
    "target_return_outlier_lower_10",
    "target_return_outlier_upper_90",
    "target_vol_jump_prob",
    "target_breakout_prob",
)

RICH_PREFIXES = ("onchain_", "etf_")
STACK_PREFIXES = (
    "score__",
    "uncertainty__",
    "realized_vol",
    "ewma_vol",
    "volume_change",
    "funding_rate_slope",
    "open_interest_slope",
    "momentum_fast",
    "momentum_slow",
    "atr_slope",
    "structural_gap",
)


def is_target(name: str) -> bool:
    return name.startswith("target_")


def is_class_target(name: str) -> bool:
    return name in CLASS_TARGETS


def is_future(name: str) -> bool:
    return name.startswith("future")


def is_rich(name: str, prefixes: Sequence[str] = RICH_PREFIXES) -> bool:
    return name.startswith(tuple(prefixes))


def feature_candidates(columns: Iterable[str], allow: Iterable[str] | None = None) -> list[str]:
    """Columns a model may read: no keys, no labels of any kind, nothing from the future."""
    allowed = None if allow is None else set(allow)
    return [
        c
        for c in columns
        if c not in KEY_COLUMNS
        and not is_target(c)
        and not is_future(c)
        and (allowed is None or c in allowed)
    ]


def normalise_name(name: str) -> str:
    """Lower case; every run of blanks, dashes, slashes or other signs is one underscore, none outside."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def norm_suffixes(period: str) -> tuple[str, str]:
    w = PERIODS[period].norm_window
    return f"_zn{w}", f"_mm{w}"


def foreign_window_columns(columns: Iterable[str], period: str) -> list[str]:
    """Normalised columns that belong to another period's window."""
    own = PERIODS[period].norm_window
    others = {s.norm_window for s in PERIODS.values()} - {own}
    tails = tuple(f"_{kind}{w}" for w in sorted(others) for kind in ("zn", "mm"))
    return [c for c in columns if c.endswith(tails)]


def match_normalised(wanted: Iterable[str], columns: Iterable[str], period: str) -> dict[str, str]:
    """Map a wanted column to the one carrying this period's window suffix when it is absent."""
    have, w = set(columns), PERIODS[period].norm_window
    out: dict[str, str] = {}
    for name in wanted:
        if name in have:
            out[name] = name
            continue
        m = re.fullmatch(r"(.+_(?:zn|mm))\d*", name)
        if m and f"{m.group(1)}{w}" in have:
            out[name] = f"{m.group(1)}{w}"
    return out


#: Window suffixes at the end of a name, in the syntax that Python and Spark share.
FAMILY_TAIL = r"((_roll_\d+)|(_ewma_\d+)|(_\d+[smhdw]?))+$"


def family_key(name: str) -> str:
    """A name without its window suffixes: x_roll_20, x_ewma_5 and x_24h share the family x."""
    return re.sub(FAMILY_TAIL, "", name) or name


def resolve_features(
    wanted: Sequence[str], synonyms: dict[str, Sequence[str]], columns: Iterable[str]
) -> tuple[list[str], list[str]]:
    """First existing synonym of each wanted name, in order; names without any are reported missing."""
    have = set(columns)
    found: list[str] = []
    missing: list[str] = []
    for name in wanted:
        hit = next((c for c in (name, *synonyms.get(name, ())) if c in have), None)
        if hit is None:
            missing.append(name)
        elif hit not in found:
            found.append(hit)
    return found, missing
