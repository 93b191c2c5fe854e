"""MinHash signatures and banding that other implementations of the same definition can reproduce bit by bit."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES, BANDS, ROWS, SEED = 128, 32, 4, 42
#: Tokens a side that a pair of blocks holds in memory, 32 MB as hashes.
BLOCK_TOKENS = 4_000_000


def salts(count: int = HASHES, seed: int = SEED, prefix: str = "leakscope") -> list[str]:
    """Salt i is the SHA-256 of {prefix}-{seed}-{i}, in hex. An index made elsewhere is read with its own prefix."""
    return [hashlib.sha256(f"{prefix}-{seed}-{i}".encode()).hexdigest() for i in range(count)]


def token_hash(salt: Column, token: Column) -> Column:
    """The first eight bytes of SHA-256(salt, token), read backwards, as 16 hex digits, whose order is that of the number."""
    h = F.substring(F.sha2(F.concat(F.unhex(salt), F.encode(token, "UTF-8")), 256), 1, 16)
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def signature(tokens: Column, count: int = HASHES) -> Column:
    """array<string> of the least hash under each salt; zeros for an empty set."""
    table = F.array(*[F.lit(s) for s in salts(count)])
    return F.transform(table, lambda s: F.coalesce(F.array_min(F.transform(tokens, lambda t: token_hash(s, t))), F.lit("0" * 16)))


#: Distinct tokens whose hashes a task keeps: 128 hashes of 8 bytes each, 64 MB.
KEPT_TOKENS = 65_536


def _signature_rows(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = [hashlib.sha256(bytes.fromhex(x)) for x in salts(count)]
        known: dict[str, np.ndarray] = {}

        def hashes(token: str) -> np.ndarray:
            if token not in known:
                if len(known) >= KEPT_TOKENS:
                    known.clear()
                data, out = token.encode("utf-8", "surrogatepass"), bytearray()
                for base in bases:
                    h = base.copy()
                    h.update(data)
                    out += h.digest()[:8]
                known[token] = np.frombuffer(bytes(out), "<u8")
            return known[token]

        for b in batches:
            sets = [[t for t in ts or () if t is not None] for ts in b.column("tokens").to_pylist()]
            keep = pa.array([i for i, ts in enumerate(sets) if ts], pa.int64())
            sigs = [np.min([hashes(t) for t in ts], axis=0).view(np.int64) for ts in sets if ts]
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * count), flat)
            yield pa.RecordBatch.from_arrays([b.column("id").take(keep), b.column("tokens").take(keep), lists], names=["id", "tokens", "sig"])

    return run


def signatures(sets: DataFrame, ident: str, tokens: str, count: int = HASHES) -> DataFrame:
    """(id, tokens, sig): the least hash under each salt as 64 bits in an array<bigint>; local to the row, without a shuffle.

    The hashes of a token are computed once per task as long as it stays among the last KEPT_TOKENS. Sets that are null or
    without tokens have no row.
    """
    src = sets.select(F.col(ident).alias("id"), F.col(tokens).alias("tokens"))
    return src.mapInArrow(_signature_rows(count), f"id {dict(src.dtypes)['id']}, tokens array<string>, sig array<bigint>")


def hex_hashes(sig: Column) -> Column:
    """array<string> of 16 hex digits each."""
    return F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))


def band_hashes(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """array<string> of one hash per band of an array<bigint>: SHA-256 of the tuple of its unsigned numbers in decimal, 16 hex digits."""
    def band(b):
        numbers = F.transform(F.slice(sig, b * rows + 1, rows), lambda x: F.conv(F.hex(x), 16, 10))
        return F.substring(F.sha2(F.concat(F.lit("("), F.array_join(numbers, ", "), F.lit(")")), 256), 1, 16)

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)


def estimate(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures of one length."""
    return F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"])) / F.size(a)


def fast_signature(tokens: Column, count: int = HASHES) -> Column:
    """array<bigint> of the least xxHash64 under each of ``count`` seeds; row-local and without a shuffle. Null if empty."""
    seeds = F.sequence(F.lit(1), F.lit(count))
    return F.when(F.size(tokens) > 0, F.transform(seeds, lambda s: F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, s)))))


def fast_bands(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(sig, b * rows + 1, rows)))


def index_table(sets: DataFrame, least_tokens: int = 3, sha: bool = False) -> DataFrame:
    """(id, tokens, sig) of (id, tokens) sets that have enough tokens: all that later matching needs of one side."""
    kept = sets.where(F.size("tokens") >= least_tokens).select("id", "tokens")
    return signatures(kept, "id", "tokens") if sha else kept.withColumn("sig", fast_signature(F.col("tokens")))


def write_index(sets: DataFrame, path: str, parts: int = 64, **how) -> None:
    """Store an index as two Parquet tables: files by id, and bands in ``parts`` folders by band for readers that probe by band.

    match_index reads the files only, since bands miss most pairs of a low Jaccard.
    """
    table = index_table(sets, **how).persist()
    table.write.mode("overwrite").parquet(f"{path}/files")
    bands = table.select("id", F.explode((band_hashes if how.get("sha") else fast_bands)(F.col("sig"))).alias("band"))
    part = F.pmod(F.xxhash64("band"), F.lit(parts)).cast("int")
    bands.withColumn("part", part).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/bands")
    table.unpersist()


def match_index(left: DataFrame, path: str, **how) -> DataFrame:
    """content_matches of (id, tokens) sets against a stored index."""
    return content_matches(left, left.sparkSession.read.parquet(f"{path}/files"), **how)


def content_matches(left: DataFrame, right: DataFrame, least: float = 0.1, least_tokens: int = 3, keep: int = 10, sha: bool = False) -> DataFrame:
    """(left_id, right_id, similarity, rank) of (id, tokens) sets whose Jaccard is ``least`` or more.

    The ``keep`` best of each left id by similarity, then id, out of all pairs: nothing is left to bands or estimates, so
    ``sha``, the kind of signatures of an index, makes no difference here. Tokens are compared as 64-bit hashes. Both sides
    are cut into blocks of about BLOCK_TOKENS tokens, each pair of blocks is a group of its own that counts common tokens
    through an inverted index, and only its best rows leave it. Work and, beyond a few blocks, what is shuffled grow with the
    product of both sides, as the pairs at such a Jaccard do.
    """
    hashed = lambda df: df.where("id is not null").where(F.size("tokens") >= least_tokens).select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")).persist()
    a, b = hashed(left), hashed(right)
    least_blocks = math.ceil(math.sqrt(2 * left.sparkSession.sparkContext.defaultParallelism))
    n, m = (max(least_blocks, math.ceil((x.agg(F.sum(F.size("h"))).first()[0] or 0) / BLOCK_TOKENS)) for x in (a, b))
    of = lambda count: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(count))
    cells = lambda df, cell, count: df.select("id", "h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), cell)).alias("cell"))
    x = cells(a, lambda j: of(n) * m + j, m).groupBy("cell")
    y = cells(b, lambda i: i.cast("long") * m + of(m), n).groupBy("cell")
    ids = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    best = x.cogroup(y).applyInArrow(_best_of_cell(least, keep), f"left_id {ids[0]}, right_id {ids[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= keep)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("h").combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _best_of_cell(least: float, keep: int):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, cols, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if a.num_rows and b.num_rows:
            b = b.sort_by("id")  # so that places in the block are in the order of ids
            (left, cut), (right, ends) = _lists(a), _lists(b)
            size = np.diff(ends)
            order = np.argsort(right, kind="stable")
            holder = np.repeat(np.arange(len(size)), size)[order]
            kinds, first = np.unique(right[order], return_index=True)
            last = np.append(first[1:], len(right))
            at = np.minimum(np.searchsorted(kinds, left), len(kinds) - 1)
            known = kinds[at] == left
            begin, end = first[at].tolist(), last[at].tolist()
            for i in range(a.num_rows):
                runs = [holder[begin[k] : end[k]] for k in range(cut[i], cut[i + 1]) if known[k]]
                if not runs:
                    continue
                both = np.bincount(np.concatenate(runs), minlength=len(size))
                alike = both / (cut[i + 1] - cut[i] + size - both)
                j = np.flatnonzero(alike >= least)
                j = j[np.lexsort((j, -alike[j]))[:keep]]
                rows.append(np.full(len(j), i))
                cols.append(j)
                found.append(alike[j])
        return pa.table({"left_id": a.column("id").take(pa.array(np.concatenate(rows))), "right_id": b.column("id").take(pa.array(np.concatenate(cols))), "similarity": np.concatenate(found)})

    return run
