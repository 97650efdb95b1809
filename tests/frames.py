"""Hand-made bar frames."""

import numpy as np
import pandas as pd

STEP = 3_600_000


def bars(n=400, symbols=("AAA_USDT", "BBB_USDT"), seed=0, gap=0.1, period="1h"):
    """Random walks with some bars missing."""
    rng = np.random.default_rng(seed)
    parts = []
    for k, s in enumerate(symbols):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * (1 + rng.random(n) * 0.01)
        low = np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
        ts = 1_700_000_000_000 // STEP * STEP + np.arange(n) * STEP
        keep = rng.random(n) >= gap
        keep[0] = True
        parts.append(
            pd.DataFrame(
                {
                    "timestamp": ts, "open": open_, "high": high, "low": low, "close": close,
                    "volume": rng.integers(1, 50, n).astype(float), "symbol": s, "period": period,
                }
            )[keep]
        )
    return pd.concat(parts, ignore_index=True)


def by_key(df):
    return df.sort_values(["symbol", "period", "timestamp"]).reset_index(drop=True)
