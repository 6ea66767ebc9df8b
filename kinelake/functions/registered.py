"""Functions that SQL can call by name: kl_cosine(a, b), kl_timecode(seconds, fps), and the aggregate kl_upper_median(x). DataFrame plans use the column expressions instead."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


@pandas_udf("double")
def kl_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null for vectors that are null, of different lengths or without length."""

    def one(x, y):
        if x is None or y is None or len(x) != len(y):
            return None
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = np.sqrt((x @ x) * (y @ y))
        return float(x @ y / n) if n > 0 else None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf("string")
def kl_timecode(seconds: pd.Series, fps: pd.Series) -> pd.Series:
    """hh:mm:ss:ff without drop-frame."""
    base = fps.clip(lower=1).round().astype("int64")
    n = np.floor(seconds.clip(lower=0) * fps.clip(lower=1) + 0.5).astype("int64")
    s = n // base
    return pd.Series([f"{x // 3600:02d}:{x // 60 % 60:02d}:{x % 60:02d}:{f:02d}" for x, f in zip(s, n % base)])


@pandas_udf("double")
def kl_upper_median(x: pd.Series) -> float:
    x = x.dropna().sort_values()
    return float(x.iloc[len(x) // 2]) if len(x) else None


FUNCTIONS = {"kl_cosine": kl_cosine, "kl_timecode": kl_timecode, "kl_upper_median": kl_upper_median}


def register(spark: SparkSession) -> list[str]:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)
