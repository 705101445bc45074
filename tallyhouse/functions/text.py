"""The two vectorised Python functions: Unicode folding and the ratio of matching blocks."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(text: str | None) -> str | None:
    """NFKC, one space for white space, case folded."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(fold)


@F.pandas_udf(T.IntegerType())
def match_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks in ten-thousandths."""
    return pd.Series([int(difflib.SequenceMatcher(None, x, y).ratio() * 10000) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")
