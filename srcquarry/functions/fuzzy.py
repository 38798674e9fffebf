"""Close matches by Ratcliff-Obershelp similarity, which has no built-in form; an Arrow-batched function over distinct names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F


def close_matches(known: list[str], n: int = 3, cutoff: float = 0.6):
    """A column function: the up to ``n`` names of ``known`` that are most alike, best first.  ``known`` is a short literal list."""

    @F.pandas_udf("array<string>")
    def close(names: pd.Series) -> pd.Series:
        return names.map(lambda x: difflib.get_close_matches(x, known, n, cutoff) if isinstance(x, str) else [])

    return close
