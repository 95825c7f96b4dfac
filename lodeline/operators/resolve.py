"""Column builders for alias coalescing, class resolution, flags and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations of a product in one row of the fallback, and how many of them are sent to every task.
PART, MOST_SENT = 1000, 20_000
TRUE_WORDS = ["1", "true", "yes", "y", "on"]


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(v != "", v) for v in values))


def flag(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(TRUE_WORDS)


def class_suffix(name: Column, separator: str = ".") -> Column:
    return F.substring_index(name, separator, -1)


def exact_then_suffix(name: Column, exact: dict[str, str], suffix: dict[str, str], separator: str = ".") -> tuple[Column, Column]:
    """(value, 'exact' or 'suffix' or null): the whole name decides before its last part. Small literal maps only."""

    def lookup(key: Column, table: dict[str, str]) -> Column:
        return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key] if table else F.lit(None).cast("string")

    full = F.lower(F.trim(name))
    a, b = lookup(full, exact), lookup(class_suffix(full, separator), suffix)
    return F.coalesce(a, b), F.when(a.isNotNull(), "exact").when(b.isNotNull(), "suffix")


def normal_reference(value: Column) -> Column:
    return F.replace(value, F.lit("\\"), F.lit("/"))


def reference_class(raw: Column, seen: Column, selector: Column, reference: str) -> Column:
    """CONFIRMED where a selector holds the reference, INFERRED elsewhere in visible text, HIDDEN in comments only."""
    ref = F.lit(reference)
    return (
        F.when(F.contains(normal_reference(selector), ref), "CONFIRMED")
        .when(F.contains(normal_reference(seen), ref), "INFERRED")
        .when(F.contains(normal_reference(raw), ref), "HIDDEN")
        .otherwise("NONE")
    )


def name_targets(value: Column) -> Column:
    """Names in a list separated by , ; or |: each whole and its last path part, folded, without repeats."""
    parts = F.filter(F.transform(F.split(value, "[,;|]"), lambda x: F.rtrim(normal_reference(F.trim(x)), F.lit("/"))), lambda x: x != "")
    both = F.flatten(F.transform(parts, lambda x: F.array(F.lower(x), F.lower(class_suffix(x, "/")))))
    return F.array_distinct(both)


def late_bound(rows: DataFrame, declared: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """rows with null `value` taken from the last declaration of their key."""
    last = declared.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias("_declared"))
    out = rows.join(last, key, "left")
    return out.withColumn(value, F.coalesce(value, "_declared")).drop("_declared")


def linked(callers: DataFrame, caller: str, targets: str, operations: DataFrame, operation: str, product: str) -> DataFrame:
    """(caller, operation, status): every operation of each product that a caller names.

    Only a caller without any target falls back: to the single product, else to the single operation. What names no
    known product is a row with a null operation. Totals are one row, so the fallback is no join of the two sides.
    """
    ops = operations.select(F.col(operation).alias("_op"), F.lower(F.coalesce(F.col(product), F.lit(""))).alias("_key"))
    totals = ops.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("_key") != "", F.col("_key"))).alias("p")).collect()[0]
    asked = callers.select(F.col(caller).alias("_caller"), F.coalesce(targets, F.array().cast("array<string>")).alias("_targets"))
    # A null op marks a name that no product has.
    named = asked.select("_caller", F.explode("_targets").alias("_key")).where("_key <> ''").join(ops.where("_key <> ''"), "_key")
    exact = named.select("_caller", "_op").distinct().withColumn("status", F.lit("EXACT_PRODUCT"))
    # Who has a link is known from the products' names, without the pairs.
    keys = ops.where("_key <> ''").select("_key").distinct()
    met = asked.select("_caller", F.explode("_targets").alias("_key")).join(keys, "_key", "left_semi")
    rest = asked.join(met.select("_caller").distinct(), "_caller", "left_anti")
    free = rest.where(F.size("_targets") == 0).select("_caller")
    code = "NO_API_OPERATION" if not totals["n"] else "AMBIGUOUS_OPERATION_TARGET"
    lost = rest.where(F.size("_targets") > 0).select("_caller")
    fallback = None
    if totals["p"] == 1:
        fallback = (ops.where("_key <> ''"), "SINGLE_PRODUCT_FALLBACK")
    elif totals["n"] == 1:
        fallback = (ops, "SINGLE_OPERATION_FALLBACK")
    out = exact
    if fallback is None:
        lost = rest.select("_caller")
    else:
        # Every caller without a target takes all operations of the one product, so that many rows are the result itself.
        # The operations stand in numbered parts of about PART, and a caller's row is laid out once a part: an
        # equi-join on the part's number, spread over callers, with no pair that is not a row of the result.
        n_parts = -(-totals["n"] // PART)
        parts = fallback[0].groupBy(F.pmod(F.xxhash64("_op"), F.lit(n_parts)).alias("_part")).agg(F.collect_list("_op").alias("_ops"))
        asked_parts = free.select("_caller", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("_part"))
        got = asked_parts.join(F.broadcast(parts) if totals["n"] <= MOST_SENT else parts, "_part").select("_caller", F.explode("_ops").alias("_op"))
        out = exact.unionByName(got.withColumn("status", F.lit(fallback[1])))
    out = out.unionByName(lost.select("_caller", F.lit(None).cast(ops.schema["_op"].dataType).alias("_op"), F.lit(code).alias("status")))
    return out.select(F.col("_caller").alias(caller), F.col("_op").alias(operation), "status")


def mapping_rows(attributes: DataFrame, keys: list[str], name: str, value: str, suffixes: list[str]) -> DataFrame:
    """Flattened prefix_Suffix=value attributes to a row per prefix, with a direction from its flags."""
    pattern = "(?i)^(.+)_(" + "|".join(sorted((s.lstrip("_") for s in suffixes), key=len, reverse=True)) + ")$"
    parts = attributes.select(*keys, F.regexp_extract(name, pattern, 1).alias("prefix"), F.lower(F.regexp_extract(name, pattern, 2)).alias("_k"), F.col(value).alias("_v"))
    parts = parts.where("prefix <> ''")
    is_set = lambda *k: F.max(F.when(F.col("_k").isin(*k), flag(F.col("_v"))).otherwise(False))
    rows = parts.groupBy(*keys, "prefix").agg(is_set("in", "pubin").alias("_i"), is_set("out", "pubout").alias("_o"), F.count("*").alias("n_attributes"))
    way = F.when(F.col("_i") & F.col("_o"), "INOUT").when(F.col("_i"), "INPUT").when(F.col("_o"), "OUTPUT").otherwise("UNKNOWN")
    return rows.select(*keys, "prefix", way.alias("direction"), "n_attributes")


def fingerprint_diff(before: DataFrame, now: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, status): NEW, CHANGED, CACHED or VANISHED."""
    a = before.select(F.col(key).alias("_a"), F.col(mark).alias("_ma"))
    b = now.select(F.col(key).alias("_b"), F.col(mark).alias("_mb"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    status = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "VANISHED").when(F.col("_ma").eqNullSafe(F.col("_mb")), "CACHED").otherwise("CHANGED")
    return both.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))
