"""Tolerance clustering as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAGE


def with_cluster(df: DataFrame, key: Column | str, tolerance: Column | float, by: list = PAGE, name: str = "cluster") -> DataFrame:
    """Adds the number (from 0, ascending) of the row's cluster: sorted by key, a gap over the tolerance begins a new one."""
    key = F.col(key) if isinstance(key, str) else key
    over = Window.partitionBy(*by).orderBy("__key")
    df = df.withColumn("__key", key.cast("double"))
    df = df.withColumn("__new", F.coalesce((F.col("__key") > F.lag("__key").over(over) + tolerance).cast("int"), F.lit(0)))
    # rows of one key are peers in a range frame, so they share their cluster
    return df.withColumn(name, F.sum("__new").over(over.rangeBetween(Window.unboundedPreceding, 0))).drop("__key", "__new")


def with_runs(df: DataFrame, label: Column | str, order: list, by: list = PAGE, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal labels that the row is in, in the given order."""
    over = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("__label", F.col(label) if isinstance(label, str) else label)
    df = df.withColumn("__new", (~F.col("__label").eqNullSafe(F.lag("__label").over(over))).cast("int"))
    df = df.withColumn("__new", F.when(F.row_number().over(over) == 1, 0).otherwise(F.col("__new")))
    return df.withColumn(name, F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__label", "__new")
