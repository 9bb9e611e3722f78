"""Forecast models as a table function that SQL can call on any series."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


def register_forecasts(spark: SparkSession, models: Mapping[str, Callable[[np.ndarray, int], np.ndarray]], name: str = "forecast_series") -> None:
    """Register ``name(TABLE(...) PARTITION BY (series) ORDER BY (t), model, horizon)`` with the given models.

    The table has columns series, t and value, one row for each time, null values
    left out; each series is one group, which is as long as its calendar. The
    result has series, model, step (from 1) and forecast. A model is a function of
    the known values and the number of steps; any can be added to ``models``. An
    unknown model fails with the names of the known ones.
    """
    known = dict(models)

    class Forecast:
        def __init__(self):
            self.values: list[float] = []
            self.asked = None

        def eval(self, row: Row, model: str, horizon: int):
            if model not in known:
                raise ValueError(f"no model {model!r}; there are {', '.join(sorted(known))}")
            self.asked = (row["series"], model, horizon)
            if row["value"] is not None:
                self.values.append(float(row["value"]))

        def terminate(self):
            if self.asked is not None and self.values:
                series, model, horizon = self.asked
                for i, v in enumerate(known[model](np.array(self.values), horizon), 1):
                    yield series, model, i, float(v)

    spark.udtf.register(name, F.udtf(Forecast, returnType="series string, model string, step int, forecast double"))
