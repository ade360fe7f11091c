"""String similarity by matching blocks, as difflib defines it, in Arrow batches.

The ratio isn't symmetric, so the arguments' order is part of the contract.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff/Obershelp similarity of two texts in lower case; 1 for equal ones, 0 beside a null."""
    if a is None or b is None:
        return 0.0
    x, y = a.lower(), b.lower()
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_column(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)
