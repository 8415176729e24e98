import datetime
import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from barweave.schemas import BARS

# Real bars and stored indicators, read in place.
GOLDEN = Path(os.environ.get("GOLDEN_BARS", "no-stored-bars"))
needs_golden = pytest.mark.skipif(
    not GOLDEN.exists(), reason="no stored bars to compare with")


def frame(symbol, closes, start="2020-01-01", volume=100.0, days=None):
    """A pandas panel of one symbol on consecutive (or given) days."""
    first = datetime.date.fromisoformat(start)
    days = range(len(closes)) if days is None else days
    return pd.DataFrame({
        "symbol": symbol,
        "date": [first + datetime.timedelta(int(i)) for i in days],
        "open": closes, "high": closes, "low": closes, "close": closes,
        "volume": volume})


def bars(spark, *frames):
    return spark.createDataFrame(pd.concat(frames), BARS)


def walk(seed, n, level=100.0):
    rng = np.random.default_rng(seed)
    return np.round(level * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 2)
