"""Near-duplicate texts by HyperMinHash sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.words import U, flat_lists, gram_hashes, mix, word_hashes
from leakscope.operators.components import connected_components
from leakscope.operators.pairs import key_pairs
from leakscope.session import spread

SEEDS, BUCKETS, MANTISSA, ROWS = 8, 16, 10, 3
REGISTERS = SEEDS * BUCKETS
BANDS = REGISTERS // ROWS
EMPTY = np.uint16(0xFFFF)
#: Factor of the expected chance collisions of registers with a mantissa (HyperMinHash paper).
COLLISION = 0.169919487159739
_SALT = mix(np.arange(1, SEEDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def sketch(grams: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Registers, uint16[count, REGISTERS], of ``count`` sets given as flat (gram, owner) arrays.

    Under each of SEEDS hash functions a gram falls into one of BUCKETS by its upper bits; the bucket keeps the least of
    the remaining bits, as the number of its leading zeros (6 bits) and the MANTISSA bits that follow the first one.
    """
    out = np.full((count, SEEDS, BUCKETS), EMPTY, np.uint16)
    for s in range(SEEDS):
        h = mix(grams ^ _SALT[s])
        least = np.full(count * BUCKETS, np.iinfo(U).max, U)
        np.minimum.at(least, owner * BUCKETS + (h >> U(60)).astype(np.int64), h << U(4) | U(8))
        used = least != np.iinfo(U).max
        v = least[used]
        zeros = np.minimum(64 - np.frexp(v.astype(np.float64))[1], 61).astype(U)
        reg = np.full(count * BUCKETS, EMPTY, np.uint16)
        reg[used] = (zeros << U(MANTISSA) | (v << (zeros + U(1))) >> U(64 - MANTISSA)).astype(np.uint16)
        out[:, s, :] = reg.reshape(count, BUCKETS)
    return out.reshape(count, REGISTERS)


def bands(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys [count, BANDS] and whether a band has any register in use."""
    r = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U)
    key = np.arange(BANDS, dtype=U) << U(48) | r[..., 2] << U(32) | r[..., 1] << U(16) | r[..., 0]
    return mix(key).view(np.int64), (r != U(EMPTY)).any(axis=2)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates with the expected chance collisions taken off, and the number of registers they rest on."""
    either = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
    equal = ((x == y) & (x != EMPTY)).sum(axis=1)
    ratio = np.minimum(nx, ny) / np.maximum(1, np.maximum(nx, ny))
    chance = either * COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - chance) / np.maximum(1, either), 0, 1), either


def _summarise(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offs = flat_lists(batch.column("w"))
            values = values.view(U)
            sets, keep = [], []
            for i in range(len(batch)):
                g = gram_hashes(values[offs[i] : offs[i + 1]], words)
                if len(g):
                    sets.append(np.unique(g))
                    keep.append(i)
            if not keep:
                continue
            sizes = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            regs = sketch(flat, owner, len(sets))
            keys, used = bands(regs)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            fp = mix(np.add.reduceat(mix(flat * U(0x2545F4914F6CDD1D)), starts) + sizes.astype(U)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)), pa.array(keys[used]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep)), pa.array(fp), pa.array(sizes.astype(np.int32)), lists, pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "fp", "n", "bands", "regs", "grams"],
            )

    return run


def _estimated(threshold: float):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            est, rests = estimate(x, y, na, nb)
            ok = est >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(1, rests))
            ok &= np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verified(threshold: float):
    def run(batches):
        for b in batches:
            sims = []
            for x, y in zip(b.column("ga").to_pylist(), b.column("gb").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(both / (len(x) + len(y) - both))
            sims = np.array(sims, np.float64)
            t = b.select(["a", "b"]).append_column("similarity", pa.array(sims))
            yield t.filter(pa.array(sims >= threshold))

    return run


def near_duplicate_classes(texts: DataFrame, ident: str, text: str, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts whose sets of ``words``-word sequences have a Jaccard similarity of ``threshold`` or more.

    ``members``: (id, fp), fp being the class of texts with equal sets. ``links``: (a, b, similarity), one row for each
    pair of classes a < b that are alike enough; inside a class every pair has similarity 1. Copies are never expanded
    into pairs. Method: HyperMinHash registers, banding of the compressed registers (BANDS bands of ROWS registers:
    a pair at 0.6 is missed with probability 4e-5, at 0.8 with 1e-13), collision-corrected estimate with five standard
    deviations of leeway, then the exact similarity on 64-bit hashes of the sequences.

    Null or empty ids and texts, and texts of fewer than ``words`` words, are in no class. Repeated rows (equal id and
    text) count once. An id with several texts is a member of several classes. Empty input gives empty results. Other
    columns are ignored.
    """
    src = spread(texts.select(F.col(ident).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null"))
    id_type = dict(src.dtypes)["id"]
    rows = src.select("id", word_hashes(F.col("t")).alias("w")).mapInArrow(_summarise(words), f"id {id_type}, fp long, n int, bands array<long>, regs binary, grams binary").persist()
    reps = rows.drop("id").dropDuplicates(["fp"])
    light = rows.select("fp", "bands").dropDuplicates(["fp"]).select("fp", F.explode("bands").alias("band"))
    pairs = key_pairs(light, "band", "fp").distinct()
    side = lambda df, s, **cols: df.select(F.col("fp").alias(s), *[F.col(c).alias(k) for k, c in cols.items()])
    sketches = reps.select("fp", "n", "regs")
    likely = (
        pairs.join(side(sketches, "a", na="n", ra="regs"), "a")
        .join(side(sketches, "b", nb="n", rb="regs"), "b")
        .mapInArrow(_estimated(threshold), "a long, b long")
    )
    # the sets are far larger than the pairs, so they are moved once and met by both ends of each pair
    ends = likely.select("a", "b", F.explode(F.array("a", "b")).alias("fp")).join(reps.select("fp", "grams"), "fp")
    end = lambda s: F.max(F.when(F.col("fp") == F.col(s), F.col("grams"))).alias(f"g{s}")
    links = ends.groupBy("a", "b").agg(end("a"), end("b")).mapInArrow(_verified(threshold), "a long, b long, similarity double")
    return rows.select("id", "fp").distinct(), links


def near_duplicate_pairs(texts: DataFrame, ident: str, text: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: every pair of different ids, copies expanded. See near_duplicate_classes."""
    members, links = near_duplicate_classes(texts, ident, text, words, threshold)
    across = (
        links.join(members.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b")
        .where("x != y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    )
    within = key_pairs(members, "fp", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.lit(1.0).alias("similarity"))
    return across.union(within).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_groups(texts: DataFrame, ident: str, text: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per id and class: (id, class_id, class_size, links, group_id).

    A class is named by the least of its ids, a group by the least of all ids reachable over links. ``links`` counts the
    classes its class is linked to. See near_duplicate_classes.
    """
    members, links = near_duplicate_classes(texts, ident, text, words, threshold)
    links = links.persist()
    sizes = members.groupBy("fp").agg(F.count("*").alias("class_size"), F.min("id").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    classes = sizes.join(degree, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).persist()
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return members.join(classes.join(groups, "root"), "fp").select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"), "group_id")
