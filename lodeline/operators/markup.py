"""Visible markup in string columns: sections that scans skip, start tags, attributes, and structure by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(text: Column, scripts: bool = True) -> Column:
    """Text without comments, CDATA sections and, with `scripts`, script elements."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)<!\[CDATA\[.*?\]\]>", "")
    return F.regexp_replace(out, r"(?s)<script.*?</script>", "") if scripts else out


def start_tags(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """A row per visible start tag."""
    return df.select(*keys, F.explode(F.regexp_extract_all(visible(text), F.lit("<([A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag"))


def tag_attributes(df: DataFrame, text: Column, key: str, names: list[str]) -> DataFrame:
    """(key, ordinal, name, value) of the quoted attributes asked for, in document order."""
    found = F.regexp_extract_all(visible(text), F.lit(f'[ ]((?:{"|".join(names)})="[^"]*")'), 1)
    pair = df.select(key, F.posexplode(found).alias("ordinal", "pair"))
    name = F.substring_index("pair", "=", 1)
    return pair.select(key, "ordinal", name.alias("name"), F.expr("substring(pair, locate('=', pair) + 2, length(pair) - locate('=', pair) - 2)").alias("value"))


def structure(tags: DataFrame, file: str, order: str, tag: str, delta: str) -> DataFrame:
    """Depth and parent of each start tag, from rows with delta +1 (open), -1 (close) and 0 (self-closing).

    The parent of a tag at depth d is the last open tag at depth d - 1 before it. Open tags are put beside the tags one
    level below under one key, so one window per (file, level) finds every parent, whatever the depth.
    """
    w = Window.partitionBy(file).orderBy(order)
    depth = F.sum(delta).over(w) - F.col(delta)
    at = tags.withColumn("depth", depth).where(F.col(delta) >= 0)
    opens = at.where(F.col(delta) == 1).select(file, F.col("depth").alias("_level"), F.col(order).alias("_at"), F.lit(0).alias("_ask"), F.struct(F.col(order).alias("o"), F.col(tag).alias("t")).alias("_open"))
    asks = at.select(file, (F.col("depth") - 1).alias("_level"), F.col(order).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(opens.schema["_open"].dataType).alias("_open"))
    lw = Window.partitionBy(file, "_level").orderBy("_at", F.desc("_ask")).rowsBetween(Window.unboundedPreceding, 0)
    found = opens.unionByName(asks).withColumn("_parent", F.last("_open", ignorenulls=True).over(lw)).where("_ask = 1")
    found = found.select(F.col(file).alias("_f"), F.col("_at").alias("_o"), "_parent")
    out = at.join(found, (F.col(file) == F.col("_f")) & (F.col(order) == F.col("_o")))
    return out.select(file, order, tag, "depth", F.col("_parent.o").alias("parent"), F.col("_parent.t").alias("parent_tag"))
