"""Model cutoffs as a table that the caller gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cutoffs of corpora, and none at all. Models are added by the caller's table.
CORPORA = [("stack-v1", "2023-07-01"), ("stack-v2", "2024-03-15"), ("common-crawl", "2024-06-01"), ("none", "9999-12-31")]


def lookup(names: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(name, cutoff): the cutoff of each distinct name, whatever its case and whether parts are joined by - _ or blank."""
    form = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-")
    table = cutoffs.select(form(F.col("name")).alias("k"), F.col("cutoff").cast("date").alias("cutoff")).groupBy("k").agg(F.min("cutoff").alias("cutoff"))
    return names.select("name").distinct().withColumn("k", form(F.col("name"))).join(table, "k", "left").select("name", "cutoff")
