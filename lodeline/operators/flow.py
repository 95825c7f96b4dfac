"""Definitions that reach reads, in DataFrame form: events with a scope and a sequence write and read fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reaching_definitions(events: DataFrame, scope: str, seq: str, is_read: Column, is_write: Column, is_barrier: Column) -> DataFrame:
    """(writer, reader, relation): writers before a read in its scope, from the last barrier on.

    Barriers cut a scope's sequence into epochs, a barrier opening its own, so writers meet readers by an equi-join on
    (scope, epoch) and a comparison of sequences; what lies before the barrier is never paired.
    """
    w = Window.partitionBy(scope).orderBy(seq)
    epoch = F.sum(F.when(is_barrier, 1).otherwise(0)).over(w)
    at = events.withColumn("_epoch", epoch)
    reads = at.where(is_read).select(scope, "_epoch", F.col(seq).alias("reader"))
    writes = at.where(is_write | is_barrier).select(scope, "_epoch", F.col(seq).alias("writer"))
    pairs = reads.join(writes, [scope, "_epoch"]).where("writer < reader")
    n = F.count("*").over(Window.partitionBy("reader"))
    return pairs.select("writer", "reader", F.when(n > 1, "candidate_definition").otherwise("definition").alias("relation"))


def last_value(events: DataFrame, scope: str, seq: str, value: Column) -> Column:
    """The last value of earlier rows in the scope at each row."""
    w = Window.partitionBy(scope).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def opaque_before(events: DataFrame, scope: str, seq: str, is_opaque: Column) -> tuple[Column, Column]:
    """(number, last) of opaque rows before each row in its scope."""
    w = Window.partitionBy(scope).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.count(F.when(is_opaque, 1)).over(w), F.max(F.when(is_opaque, F.col(seq))).over(w)


def prefixes(path: Column, separator: str = "/") -> Column:
    """All proper prefixes of a path at its separators, shortest first."""
    parts = F.split(path, separator)
    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    # A path without a separator has none; sequence(1, 0) would count down.
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<string>"))


def group_overlap(reads: DataFrame, groups: DataFrame, path: str, read: str, group: str, separator: str = "/") -> DataFrame:
    """(group, read) where the read's path lies under the group's: prefixes are exploded, so it is an equi-join."""
    r = reads.select(F.col(read), F.explode(prefixes(F.col(path), separator)).alias("_p"))
    g = groups.select(F.col(group), F.col(path).alias("_p"))
    return g.join(r, "_p").select(group, read)


def compatible_counts(writers: DataFrame, readers: DataFrame, scope: str, guard: str, branch: str, reader: str) -> DataFrame:
    """Per reader the writers of its scope that no guard shared with another branch rules out.

    Counted from totals: all writers of the scope less those with the reader's guard and another branch; no pair is made.
    """
    total = writers.groupBy(scope).agg(F.count("*").alias("_all"))
    same = writers.groupBy(scope, guard).agg(F.count("*").alias("_guarded"))
    fits = writers.groupBy(scope, guard, branch).agg(F.count("*").alias("_fits"))
    out = readers.join(total, scope, "left").join(same, [scope, guard], "left").join(fits, [scope, guard, branch], "left")
    zero = F.lit(0)
    return out.select(reader, (F.coalesce("_all", zero) - F.coalesce("_guarded", zero) + F.coalesce("_fits", zero)).cast("long").alias("n_compatible"))
