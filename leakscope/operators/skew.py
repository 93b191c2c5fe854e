"""Per-key work with a few keys that hold most rows: fragment-replicate by estimated load."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_TASK = 8
SHARDS_PER_TASK = 4


def _partition_of(values: np.ndarray, n: int) -> np.ndarray:
    """The partition that Spark's hash partitioning into n gives to int values (Murmur3, seed 42, as Spark defines it)."""
    u, m = np.uint32, np.uint64(0xFFFFFFFF)
    mul = lambda x, c: ((x.astype(np.uint64) * np.uint64(c)) & m).astype(u)
    rot = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    k = mul(rot(mul(values.astype(np.int32).view(u), 0xCC9E2D51), 15), 0x1B873593)
    h = ((mul(rot(np.full(len(values), 42, u) ^ k, 13), 5).astype(np.uint64) + np.uint64(0xE6546B64)) & m).astype(u)
    h ^= u(4)
    h ^= h >> u(16)
    h = mul(h, 0x85EBCA6B)
    h ^= h >> u(13)
    h = mul(h, 0xC2B2AE35)
    h ^= h >> u(16)
    return np.mod(h.view(np.int32).astype(np.int64), n)


def route_values(n: int) -> list[int]:
    """For each of n partitions an int that hash partitioning puts there."""
    found: dict[int, int] = {}
    start = 0
    while len(found) < n:
        block = np.arange(start, start + 16 * n + 64)
        for v, p in zip(block.tolist(), _partition_of(block, n).tolist()):
            found.setdefault(p, v)
        start = int(block[-1]) + 1
    return [found[p] for p in range(n)]


@dataclass(frozen=True)
class ShardPlan:
    """Which tasks hold which keys: ``heavy`` maps a key, as text, to the routes of its shards, ``light`` a bucket to its route."""

    tasks: int
    heavy: dict
    light: list[int]
    loads: list[int]
    hashes: dict

    def routes(self, key: Column) -> Column:
        """Column array<int>: all routes that hold rows of the key.

        The plan is a folded constant; a heavy key is looked up in a hash table of twice as many slots as there are such
        keys, so the cost of a row doesn't grow with their number.
        """
        bucket = F.pmod(F.xxhash64(key), F.lit(len(self.light))).cast("int")
        light = F.array(F.from_json(F.lit(json.dumps(self.light)), "array<int>")[bucket])
        if not self.heavy:
            return light
        slots: list[list] = [[] for _ in range(2 * len(self.heavy))]
        for k, routes in self.heavy.items():
            slots[self.hashes[k] % len(slots)].append({"k": str(k), "r": routes})
        table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<k:string,r:array<int>>>>")
        slot = table[F.pmod(F.xxhash64(key), F.lit(len(slots))).cast("int")]
        return F.coalesce(F.get(F.filter(slot, lambda x: x["k"] == key.cast("string")), F.lit(0))["r"], light)


def plan_shards(rows: DataFrame, key: str, tasks: int | None = None) -> ShardPlan:
    """Plan for spreading ``rows`` over ``tasks`` partitions by the counted load of their keys.

    Keys are counted with partial aggregation. Only keys above 1 / (SHARDS_PER_TASK * tasks) of all rows, at most
    SHARDS_PER_TASK * tasks of them, reach the driver by name; all others are hashed into BUCKETS_PER_TASK * tasks buckets
    and reach it as loads of buckets. A heavy key is cut into shards of about that share; shards and buckets are
    packed onto the tasks, the largest first, each on the least loaded task that doesn't hold the same key yet.
    """
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_TASK * tasks
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).persist()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(1, total // (SHARDS_PER_TASK * tasks))
    named = counts.where(F.col("n") > limit).select(F.col(key).cast("string"), "n", F.xxhash64(key)).collect()
    heavy, hashes = {r[0]: r[1] for r in named}, {r[0]: r[2] for r in named}
    light = dict(
        counts.where(F.col("n") <= limit).groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b")).agg(F.sum("n")).collect()
    )
    counts.unpersist()
    route = route_values(tasks)
    heap = [(0, t) for t in range(tasks)]
    placed: dict = {}
    buckets_at = [route[b % tasks] for b in range(buckets)]
    for load, k in sorted(((n, k) for k, n in heavy.items()), key=lambda x: (-x[0], str(x[1]))):
        parts = min(tasks, -(-load // limit))
        took = [heapq.heappop(heap) for _ in range(parts)]
        placed[k] = [route[t] for _, t in took]
        for n, t in took:
            heapq.heappush(heap, (n + load // parts, t))
    for b, load in sorted(light.items(), key=lambda x: (-x[1], x[0])):
        n, t = heapq.heappop(heap)
        buckets_at[b] = route[t]
        heapq.heappush(heap, (n + load, t))
    return ShardPlan(tasks, placed, buckets_at, [n for n, _ in sorted(heap, key=lambda x: x[1])], hashes)


def spread_by_load(rows: DataFrame, key: str, plan: ShardPlan, salt: list[str] | None = None) -> DataFrame:
    """``rows`` with a column ``_route``, placed so that each partition holds its planned load; null keys are dropped.

    A row of a heavy key goes to the shard that the hash of the ``salt`` columns (all columns by default) picks.
    """
    routes = plan.routes(F.col(key))
    pick = F.pmod(F.xxhash64(*(salt or rows.columns)), F.size("_routes").cast("long")).cast("int")
    return (
        rows.where(F.col(key).isNotNull()).withColumn("_routes", routes).withColumn("_route", F.col("_routes")[pick]).drop("_routes").repartition(plan.tasks, "_route")
    )


def balanced_aggregate(rows: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], plan: ShardPlan | None = None, salt: list[str] | None = None) -> DataFrame:
    """Aggregates per key without a task that holds a whole hot key.

    ``partial`` is computed in each shard of a key, ``final`` over the partial columns of all its shards. Null keys form no
    group, an empty input gives an empty result, and a ``salt`` that identifies a thing keeps all its rows in one shard.
    """
    plan = plan or plan_shards(rows, key)
    parts = spread_by_load(rows, key, plan, salt).groupBy("_route", key).agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def fragment_replicate_join(big: DataFrame, other: DataFrame, key: str, how: str = "inner", plan: ShardPlan | None = None, salt: list[str] | None = None) -> DataFrame:
    """Equi-join of a skewed side with another one: heavy keys are cut into shards, and the rows of the other side go only
    to the shards of their key. Each side is shuffled once; nothing is broadcast. ``how`` is inner, left or left_semi.

    Null keys match nothing (a left join keeps them). Columns of equal names on both sides, other than the key, raise an
    error. An empty side is fine.
    """
    clash = (set(big.columns) & set(other.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    # lets the join use the placement by _route though it also compares the key
    big.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    plan = plan or plan_shards(big, key)
    left = spread_by_load(big, key, plan, salt)
    if how == "left_semi":  # an inner join with distinct keys, since the optimizer moves semi joins below the placement
        other, how = other.select(key).distinct(), "inner"
    right = other.where(F.col(key).isNotNull()).withColumn("_route", F.explode(F.array_distinct(plan.routes(F.col(key))))).repartition(plan.tasks, "_route")
    joined = left.join(right, ["_route", key], how).drop("_route")
    if how == "left":
        joined = joined.unionByName(big.where(F.col(key).isNull()), allowMissingColumns=True)
    return joined
