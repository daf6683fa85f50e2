"""User functions: models and conditions that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fit_predict(df: DataFrame, keys: Sequence[str], model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's model on the rows of each key, as a grouped map: the rows of one key have to fit in a task, so
    keys should name what grows with the data (domains, folds, subjects)."""
    return df.groupBy(*keys).applyInPandas(model, schema)


def run_conditions(df: DataFrame, conditions: dict[str, Column], scores: dict[str, Column], control: str, metric: str) -> DataFrame:
    """The scores under each named condition, and the metric's difference from the control's: a row is under
    all conditions that it meets, in one pass."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    out = df.withColumn("condition", F.explode(met)).groupBy("condition").agg(*[c.alias(n) for n, c in scores.items()])
    base = F.max(F.when(F.col("condition") == control, F.col(metric))).over(Window.partitionBy())
    return out.withColumn("vs_control", F.col(metric) - base)


def condition_function(spark: SparkSession, name: str, floors: dict[str, float]) -> None:
    """Register a table function that yields the conditions whose floor a value reaches."""
    from pyspark.sql.functions import udtf

    class Conditions:
        def eval(self, value: float):
            for condition, floor in floors.items():
                if value is not None and value >= floor:
                    yield (condition,)

    spark.udtf.register(name, udtf(Conditions, returnType="condition string"))
