"""Symbol spelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def without_settlement(c: Column) -> Column:
    """BTC/USDT:USDT to BTC/USDT."""
    return F.regexp_replace(c, r":[A-Za-z0-9]+$", "")


def canonical_symbol(c: Column) -> Column:
    """btcusdt, BTC/USDT, BTC-USDT and BTC/USDT:USDT all become BTC_USDT."""
    s = F.upper(F.trim(without_settlement(F.trim(c))))
    s = F.regexp_replace(s, r"[/\-]", "_")
    return F.when(~s.contains("_"), F.regexp_replace(s, r"^([A-Z]+)(USDT|USD|BUSD|USDC)$", "$1_$2")).otherwise(s)


def coin(c: Column) -> Column:
    """Base coin of a pair."""
    return F.split_part(canonical_symbol(c), F.lit("_"), F.lit(1))


def pair(c: Column) -> Column:
    """Pair without a separator."""
    return F.replace(canonical_symbol(c), F.lit("_"), F.lit(""))
