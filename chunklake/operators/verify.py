"""Integrity: reports of corrupt records, comparison of two stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.operators.latest import with_liveness
from chunklake.schema import keys


def report(df: DataFrame) -> DataFrame:
    """Records, corrupt latest ones (a failure) and corrupt dead ones (not)."""
    x = with_liveness(df)
    bad, live = F.col("corrupt"), F.col("live")
    return x.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad & live).alias("corrupt_latest"), F.count_if(bad & ~live).alias("corrupt_dead"))


def corrupt(df: DataFrame) -> DataFrame:
    return with_liveness(df).where("corrupt")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key by key: payload hashes of two stores (key, h), as same, changed, lost or added."""
    k = keys(old)
    x = old.select(*k, F.col("h").alias("h1"), F.lit(True).alias("a")).join(new.select(*k, F.col("h").alias("h2"), F.lit(True).alias("b")), k, "full_outer")
    state = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(F.col("h1").eqNullSafe(F.col("h2")), "same").otherwise("changed")
    return x.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
