"""Pairs of rows that share a key, made in blocks so that no task holds a whole hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_pairs(rows: DataFrame, key: str, ident: str, block: int = 512, payload: tuple[str, ...] = ()) -> DataFrame:
    """Each unordered pair of different ``ident`` values under an equal ``key``.

    ``rows`` has one row per (key, ident). Keys of one row vanish before any pair is made. A key of n rows is
    cut into ceil(n / block) blocks, and every pair of blocks is a group of its own, so a group holds at most about
    two blocks. Result: ``a``, ``b`` (a < b) and, for each payload column p, ``a_p`` and ``b_p``; a pair that shares
    several keys comes once per key. Null keys and null idents form no pair.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(ident).alias("i"), *payload).where("k is not null and i is not null")
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("i", F.lit(7)), blocks.cast("long")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")),
    )
    placed = rows.join(counts, "k").withColumn("own", own).withColumn("cell", F.explode(cells))
    grouped = placed.groupBy("k", "cell").agg(F.collect_list(F.struct("i", "own", *payload)).alias("g")).where(F.size("g") > 1)
    wanted = lambda p, q: (p["i"] < q["i"]) & ((F.col("cell.x") == F.col("cell.y")) | (p["own"] != q["own"]))
    flat = F.flatten(F.transform("g", lambda p: F.transform(F.filter("g", lambda q: wanted(p, q)), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    return grouped.select(F.explode(flat).alias("e")).select(
        F.col("e.p.i").alias("a"),
        F.col("e.q.i").alias("b"),
        *[F.col(f"e.{s}.{c}").alias(f"{t}_{c}") for c in payload for s, t in (("p", "a"), ("q", "b"))],
    )
