"""Filling containers of fixed capacity: best-fit decreasing, certified by dual-feasible functions, with repacking of gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs together, so its memory is bounded.
GROUP = 50_000


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Fewest containers that sizes of at most ``capacity`` can take, by three families of dual-feasible functions.

    With ``counts`` each size stands for that many items, so that the capacity bounds the input, whatever the data.
    """
    if not (sizes > 0).any():
        return 0
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, sizes, 1 if counts is None else counts)
    count[0] = 0
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # large sizes count as a container, sizes below a threshold as nothing
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    low = np.arange(0, capacity // 2 + 1)
    whole = n[capacity + 1] - n[capacity - low + 1]
    best = max(best, int((whole + -(-(s[capacity - low + 1] - s[low]) // capacity)).max()))
    # sizes above half take a container each, the rest fill what these leave
    half = n[capacity - low + 1] - n[capacity // 2 + 1]
    left = half * capacity - (s[capacity - low + 1] - s[capacity // 2 + 1])
    small = s[capacity // 2 + 1] - s[low]
    best = max(best, int((whole + half + np.maximum(0, -(-(small - left) // capacity))).max()))
    # sizes rounded down to multiples of 1/k
    for k in range(1, 33):
        x = (k + 1) * size
        exact = x % capacity == 0
        weight = np.where(exact, size * k, (x // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int((count * weight).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill of each container); sizes are at most ``capacity``, larger ones go first."""
    place = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_rooms = 0  # bit r is set if a container has r left
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = values[i]
        fit = open_rooms >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
            fills[k] += s
            r -= s
        else:
            k, r = len(fills), capacity - s
            fills.append(s)
        room[r].append(k)
        open_rooms |= 1 << r
        place[i] = k
    return place, np.array(fills, np.int64)


def _pack(table: pa.Table) -> pa.Table:
    capacity = table.column("capacity")[0].as_py()
    sizes = table.column("size").to_numpy().astype(np.int64)
    place, fills = best_fit_decreasing(sizes, capacity)
    gap = len(fills) - lower_bound(sizes, capacity)
    return table.append_column("k", pa.array(place)).append_column("fill", pa.array(fills[place])).append_column("gap", pa.array(np.full(len(place), gap, np.int64)))


def pack(items: DataFrame, bins: DataFrame, rounds: int = 3, group: int = GROUP, trace: list | None = None) -> DataFrame:
    """(bin_name, container, id, piece, size, first_token): every item in a container of each kind in ``bins``.

    ``items`` has (id, tokens), ``bins`` (bin_name, capacity), a short table. An item above the capacity is cut into full
    pieces, which are containers of their own, and a rest; no other is cut. The rest is packed in groups of about ``group``
    items, placed by hash, best fit first, larger items first. A dual-feasible lower bound certifies each group; the items
    of the containers with room left in groups above their bound are exchanged (hashed anew into fewer groups) and packed
    again, up to ``rounds`` times. No group grows with the data; what one leaves open, the next one closes. ``trace``
    receives a table per round: (round, bin_name, part, items, containers, lower_bound) of each group.

    Null ids and tokens are ignored, repeated rows (equal id and tokens) count once, an item of 0 tokens goes where a
    container is, and a capacity that is null or below 1 is ignored. Empty tables give an empty result.
    """
    spark = items.sparkSession
    kinds = [(r[0], r[1]) for r in bins.select("bin_name", F.col("capacity").cast("int")).where("capacity >= 1 and bin_name is not null").distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    kind_rows = F.array(*[F.struct(F.lit(n).alias("bin_name"), F.lit(c).alias("capacity")) for n, c in kinds]) if kinds else None
    base = items.select("id", F.col("tokens").cast("long").alias("tokens")).where("id is not null and tokens >= 0").distinct()
    id_type = dict(base.dtypes)["id"]
    schema = f"bin_name string, capacity int, id {id_type}, piece int, size long, part int"
    if not kinds:
        return spark.createDataFrame([], f"bin_name string, container string, id {id_type}, piece int, size long, first_token long")
    base = base.withColumn("b", F.explode(kind_rows)).select("b.bin_name", "b.capacity", "id", "tokens").persist()
    full = (
        base.where("tokens > capacity")
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.floor(F.col("tokens") / F.col("capacity")).cast("int"))))
        .select("bin_name", F.concat(F.lit("f-"), F.col("id").cast("string"), F.lit("-"), "piece").alias("container"), "id", "piece", F.col("capacity").cast("long").alias("size"), ((F.col("piece") - 1) * F.col("capacity")).cast("long").alias("first_token"))
    )
    rest = (
        base.where("tokens <= capacity or tokens % capacity > 0")
        .withColumn("piece", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity")) + 1).otherwise(1).cast("int"))
        .withColumn("size", F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")))
        .select("bin_name", "capacity", "id", "piece", "size")
    )
    left, result = rest, full
    for r in range(rounds):
        per_kind = {x[0]: x[1] for x in left.groupBy("bin_name").count().collect()}
        if not per_kind:
            break
        groups = F.create_map(*[x for n, c in per_kind.items() for x in (F.lit(n), F.lit(max(1, -(-c // group))))])[F.col("bin_name")]
        part = F.pmod(F.xxhash64("id", "piece", F.lit(r)), groups.cast("long")).cast("int")
        packed = left.withColumn("part", part).groupBy("bin_name", "part").applyInArrow(_pack, schema + ", k long, fill long, gap long").persist()
        if trace is not None:
            trace.append(packed.groupBy("bin_name", "part").agg(F.max("k").alias("k"), F.max("gap").alias("gap"), F.count("*").alias("items")).select(F.lit(r).alias("round"), "bin_name", "part", "items", (F.col("k") + 1).alias("containers"), (F.col("k") + 1 - F.col("gap")).alias("lower_bound")))
        closed = (F.col("gap") <= 0) | (F.col("fill") >= F.col("capacity")) | F.lit(r == rounds - 1) | (groups <= 1)
        result = result.union(
            packed.where(closed).select("bin_name", F.concat_ws("-", F.lit(f"r{r}"), "part", "k").alias("container"), "id", "piece", "size", ((F.col("piece") - 1) * F.col("capacity")).cast("long").alias("first_token"))
        )
        left = packed.where(~closed).select("bin_name", "capacity", "id", "piece", "size")
    return result


def packing_report(packed: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin_name, capacity, containers, tokens, fill, lower_bound): how full the containers are, against the least number.

    The bound is computed from the histogram of sizes, whose length the capacity bounds.
    """
    def bound(table: pa.Table) -> pa.Table:
        sizes, counts = (table.column(x).to_numpy().astype(np.int64) for x in ("size", "n"))
        return pa.table({"bin_name": table.column("bin_name")[:1], "lower_bound": pa.array([lower_bound(sizes, table.column("capacity")[0].as_py(), counts)])})

    caps = bins.select("bin_name", F.col("capacity").cast("int").alias("capacity")).distinct()
    hist = packed.groupBy("bin_name", "size").agg(F.count("*").alias("n")).join(caps, "bin_name")
    bounds = hist.groupBy("bin_name").applyInArrow(bound, "bin_name string, lower_bound long")
    used = packed.groupBy("bin_name", "container").agg(F.sum("size").alias("t")).groupBy("bin_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return used.join(caps, "bin_name").join(bounds, "bin_name").select("bin_name", "capacity", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"), "lower_bound")


def exchange_report(items: DataFrame, bins: DataFrame, group: int, rounds: int = 3) -> DataFrame:
    """(bin_name, round, groups, items, containers, certified, gap) of a packing in groups of about ``group`` items.

    For each round of the exchange: how many groups and items it packed, into how many containers, how many groups their own
    lower bound certifies, and by how many containers the others exceed theirs. The containers of the last round count
    the final ones of what was still open.
    """
    trace: list[DataFrame] = []
    pack(items, bins, rounds, group, trace)
    if not trace:
        return items.sparkSession.createDataFrame([], "bin_name string, round int, groups long, items long, containers long, certified long, gap long")
    each = trace[0]
    for t in trace[1:]:
        each = each.union(t)
    excess = F.col("containers") - F.col("lower_bound")
    return each.groupBy("bin_name", "round").agg(
        F.count("*").alias("groups"), F.sum("items").alias("items"), F.sum("containers").alias("containers"), F.count_if(excess <= 0).alias("certified"), F.sum(excess).alias("gap")
    )
