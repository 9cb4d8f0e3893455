"""Pluggable scoring: any object with ``predict(values) -> float`` over raster rows, a
table function for label lines, and a grouped aggregate."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


class Scorer(Protocol):
    def predict(self, values: np.ndarray) -> float: ...


class MeanScorer:
    """Mean brightness, 0 to 1."""

    def predict(self, values: np.ndarray) -> float:
        return float(np.mean(values) / 255)


def scored(rasters: DataFrame, scorer: Scorer, column: str = "values") -> DataFrame:
    """Adds `score` to rows of rasters; the scorer is broadcast once to each executor."""
    shared = rasters.sparkSession.sparkContext.broadcast(scorer)

    def job(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = shared.value.predict
        for pdf in frames:
            yield pdf.assign(score=[predict(np.asarray(v)) for v in pdf[column]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rasters.schema.fields)
    return rasters.mapInPandas(job, f"{fields}, score double")


@udtf(returnType=T.StructType([T.StructField("field", T.IntegerType()), T.StructField("value", T.DoubleType())]))
class LabelFields:
    """One row for each number of a label line; nothing for a line with another field."""

    def eval(self, line: str):
        try:
            values = [float(x) for x in (line or "").split()]
        except ValueError:
            return
        yield from enumerate(values)


@F.pandas_udf(T.DoubleType())
def p80(values: pd.Series) -> float:
    return float(np.percentile(values, 80))
