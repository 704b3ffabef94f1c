"""xxHash of bytes with a seed, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def xxh32(value: Column, seed: int = 1234) -> Column:
    """32-bit xxHash of a binary or string column; null for null."""

    @pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: xxhash.xxh32_intdigest(v, seed), na_action="ignore").astype("Int64")

    return hashed(value)


def xxh64(value: Column, seed: int = 0) -> Column:
    """64-bit xxHash as an unsigned decimal; null for null."""

    @pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: str(xxhash.xxh64_intdigest(v, seed)), na_action="ignore")

    return hashed(value).cast("decimal(20,0)")
