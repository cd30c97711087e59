"""Printed numbers of finished result tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text rounded from the exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form half up instead: 31.25
    prints as 31.3 there and as 31.2 here. Only a few report rows pass through.
    """

    @F.pandas_udf(StringType())
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{digits}f}", na_action="ignore").astype(object)

    return text(c.cast("double"))
