"""Bloom filters with a fixed bit layout: sizing, building, probing, statistics."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at a false positive rate p between 1e-9 and 0.5."""
    p = min(max(p, 1e-9), 0.5)
    m = max(64, int(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, int(m / max(1, n) * math.log(2)))


def positions(key: Column, m: int, k: int) -> Column:
    """array<bigint>: (h1 + i * h2) mod m, h1 and h2 being the first two little-endian words of the SHA-256 of the key."""
    h = F.sha2(F.encode(key, "UTF-8"), 256)
    word = lambda at: F.conv(F.concat(*[F.substring(h, at + i, 2) for i in range(14, -1, -2)]), 16, 10).cast("decimal(38,0)")
    h1, h2 = word(1), word(17)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i.cast("decimal(5,0)") * h2, F.lit(m).cast("decimal(20,0)")).cast("bigint"))


def build(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """(pos): the distinct positions of set bits, as a table that grows with m at most."""
    return keys.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), m, k)).alias("pos")).distinct()


def probe(keys: DataFrame, key: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """(key, member) of the distinct non-null keys: a member has all its bits set, so no true member is missed."""
    distinct = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    found = distinct.select("key", F.explode(F.array_distinct(positions(F.col("key"), m, k))).alias("pos")).join(bits.withColumn("hit", F.lit(1)), "pos", "left")
    return found.groupBy("key").agg((F.count("*") == F.count("hit")).alias("member"))


def false_positive_rate(n: int, m: int, k: int) -> float:
    return (1 - math.exp(-k * n / m)) ** k


def save(bits: DataFrame, path: str, n: int, m: int, k: int) -> None:
    """Store the positions of set bits beside a one-row header with the sizes."""
    spark = bits.sparkSession
    bits.select("pos").write.mode("overwrite").parquet(f"{path}/bits")
    spark.createDataFrame([(json.dumps({"format": 1, "n": n, "m": m, "k": k}),)], "header string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load(spark, path: str) -> tuple[DataFrame, int, int]:
    """(bits, m, k) of a stored filter; sizes beyond the format's limits are refused."""
    head = json.loads(spark.read.text(f"{path}/header").first()[0])
    if head.get("format") != 1 or not 0 < head["m"] <= 10**9 or not 0 < head["k"] <= 20 or not 0 <= head["n"] <= head["m"]:
        raise ValueError(f"not a usable filter: {head}")
    return spark.read.parquet(f"{path}/bits"), head["m"], head["k"]


def from_lines(spark, path: str) -> DataFrame:
    """(repo) of a text file with an owner/name a line, trimmed and in lower case; other lines are left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("repo")).where(F.contains("repo", F.lit("/")))
