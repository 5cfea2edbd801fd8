"""Sequence similarity of two texts, the one measure without a SQL form."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: str | None, b: str | None, autojunk: bool) -> float | None:
    if a is None or b is None:
        return None
    return difflib.SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def sequence_ratio(expected: Column, actual: Column, autojunk: bool = True) -> Column:
    """Matching-block ratio of whole texts (asymmetric, as in the stdlib).

    Equal texts never reach Python.  ``autojunk`` keeps the stdlib default, which
    ignores very frequent characters of texts from 200 characters on.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y, autojunk) for x, y in zip(a, b)], dtype="float64")

    differs = expected != actual
    # the UDF runs for every row of a CASE, so equal pairs are handed over as nulls
    return F.when(~differs, F.lit(1.0)).otherwise(ratio(F.when(differs, expected), F.when(differs, actual)))
