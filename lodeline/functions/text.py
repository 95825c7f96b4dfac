"""Arrow functions for what Spark lacks, and small column helpers for reports."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions import references, templates


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding; lower() leaves ß and some other letters apart. Null is the empty text."""
    return s.map(lambda x: "" if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def field_references(s: pd.Series) -> pd.Series:
    return s.map(lambda x: references.field_references(x or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def condition_references(s: pd.Series) -> pd.Series:
    return s.map(lambda x: references.condition_references(x or ""))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("n_guards", T.IntegerType())])))
def template_variants(s: pd.Series) -> pd.Series:
    found = s.map(lambda x: templates.template(x or "", variants=True)["variants"])
    return found.map(lambda v: [{"template": i["template"], "n_guards": len(i["guards"])} for i in v])


def joined_path(base: Column, path: Column) -> Column:
    """An endpoint and a path with one slash between them; a path that is a URL stays as it is."""
    b, p = F.coalesce(base, F.lit("")), F.coalesce(path, F.lit(""))
    both = F.concat(F.rtrim(b, F.lit("/")), F.lit("/"), F.ltrim(p, F.lit("/")))
    return F.when((b == "") | p.rlike("^(?i)https?://"), p).when(p == "", b).otherwise(both)


def duration(seconds: float) -> str:
    """Hours, minutes and seconds, the leading ones left out while they are zero."""
    hours, rest = divmod(max(0, int(seconds)), 3600)
    return f"{hours}h {rest // 60:02d}m {rest % 60:02d}s" if hours else f"{rest // 60}m {rest % 60:02d}s" if rest >= 60 else f"{rest}s"
