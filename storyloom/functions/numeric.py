"""Numbers: clamping and rounding.

``rounded`` is Spark's HALF_UP on the shortest decimal form, evaluated in the JVM. Where the last digit
must be that of correct rounding of the binary value, as Python's ``round`` gives, pass
``exact=True``: a vectorised function at the Arrow boundary. The two differ on decimal ties only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _exact(digits: int):
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits), na_action="ignore").astype("float64")

    return run


def rounded(c: Column, digits: int = 4, exact: bool = False) -> Column:
    c = c.cast("double")
    return _exact(digits)(c) if exact else F.round(c, digits)
