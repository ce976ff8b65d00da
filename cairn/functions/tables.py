"""Functions that users register with a session: a table function and an aggregate, as examples of what Spark takes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shipped


@F.udtf(returnType=T.StructType([T.StructField("table_id", T.IntegerType())]))
class TablesOfMask:
    """The table ids of an archetype's bits, 63 being the sign."""

    def eval(self, mask: int) -> Iterator[tuple[int]]:
        if mask is not None:
            for i in range(64):
                if mask >> i & 1:
                    yield (i,)


@F.pandas_udf(T.DoubleType())
def geometric_mean(x: pd.Series) -> float:
    """Of positive values; null without any."""
    x = x[x > 0]
    return float(np.exp(np.log(x).mean())) if len(x) else float("nan")


def register(spark: SparkSession) -> None:
    shipped(spark)
    spark.udtf.register("tables_of_mask", TablesOfMask)
    spark.udf.register("geometric_mean", geometric_mean)
