"""Counts with samples, status roll-ups and orders with custom ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings(rows: DataFrame, code: str, sample: str, most: int) -> DataFrame:
    """Per code its count, its `most` smallest samples in order and how many more there are.

    The smallest few of each code and hash part are taken first (a ranking that Spark cuts before the shuffle), then of
    those, so a code with very many rows is never in one task.
    """
    total = rows.groupBy(code).agg(F.count("*").alias("n"))
    part = rows.select(code, sample, F.pmod(F.xxhash64(sample), F.lit(64)).alias("_s"))
    for keys in ([code, "_s"], [code]):
        part = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(sample))).where(F.col("_r") <= most).drop("_r")
    best = part.groupBy(code).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    out = total.join(best, code)
    return out.select(code, "n", "samples", F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("more"))


def anchor_status(seeds: Column, blocked: Column, conditional: Column) -> Column:
    """blocked over conditional over static_candidate; without seeds nothing can be assessed."""
    return F.when(seeds == 0, "not_assessable").when(blocked > 0, "blocked").when(conditional > 0, "conditional").otherwise("static_candidate")


def ranked(value: Column, order: list[str]) -> Column:
    """Place of a value in a fixed order, behind all for others."""
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(value == name, k).otherwise(out)
    return out
