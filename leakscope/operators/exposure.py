"""Multiset overlap of two arrays per row, without comparing elements in pairs and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions import text


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive ones."""
    if n == 1 or len(hashes) < n:
        return hashes if n == 1 else hashes[:0]
    x, out = hashes.view(np.uint64), np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        y = (out ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out = y ^ (y >> np.uint64(29))
    return out.view(np.int64)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays without copying; null rows as empty ones."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield values[offsets[i] : offsets[i + 1]] if valid else values[:0]


def _overlaps(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, matched = [], []
            for q, s in zip(_lists(b.column("q")), _lists(b.column("s"))):
                q, s = runs(q, n), runs(s, n)
                (x, i), (y, j) = np.unique(q, return_counts=True), np.unique(s, return_counts=True)
                _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                total.append(len(q))
                matched.append(int(np.minimum(i[at], j[to]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total, pa.int64()), pa.array(matched, pa.int64())], names=["id", "total", "matched"])

    return run


def _schema(ident: str, df: DataFrame, rest: str) -> str:
    return f"{ident} {dict(df.dtypes)[ident]}, {rest}"


def exposures(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(id, total, matched) of rows (id, q, s): how many elements of the array ``q`` the array ``s`` holds too.

    With ``n`` the runs of n consecutive elements are counted instead. An element counts as often as both sides have it.
    The work is local to the row: elements become 64-bit hashes inside the JVM, runs are counted on packed arrays, and nothing
    is shuffled. Null arrays and arrays without a run stay, with zeros.
    """
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    return pairs.select("id", hashed("q"), hashed("s")).mapInArrow(_overlaps(n), _schema("id", pairs, "total long, matched long"))


def _gram_counts(t: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n characters, packed 21 bits each, and their counts."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    packed = np.zeros(len(c) - n + 1, np.uint64)
    for k in range(n):
        packed = packed << np.uint64(21) | c[k : len(c) - n + 1 + k]
    return np.unique(packed, return_counts=True)


def _gram_sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [_gram_counts(t or "", n)[1] for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([len(c) for c in counts], pa.int64())], names=["id", "n", "n_distinct"])

    return run


def char_gram_sizes(texts: DataFrame, ident: str, x: str, n: int = 3) -> DataFrame:
    """(id, n, n_distinct): runs of n characters (three at most) of each text in lower case with white space collapsed, and different ones.

    Local to the row, on packed arrays; null and shorter texts have none.
    """
    src = texts.select(F.col(ident).alias("id"), text.collapse(F.lower(F.col(x))).alias("t"))
    return src.mapInArrow(_gram_sizes(n), _schema("id", src, "n long, n_distinct long"))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for q, s in zip(b.column("q").to_pylist(), b.column("s").to_pylist()):
            (x, m), (y, n) = _gram_counts(q, 3), _gram_counts(s, 3)
            if not len(x) or not len(y):
                out.append(None)
                continue
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            out.append(float((m[i] * n[j]).sum() / (np.sqrt(float((m * m).sum())) * np.sqrt(float((n * n).sum())))))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.float64())], names=["id", "cosine"])


def char_cosine(pairs: DataFrame) -> DataFrame:
    """(id, cosine) of the counts of three-character runs of two texts ``q`` and ``s``, lower case, white space collapsed.

    Whole texts count. Null where a text has under three characters. The work is
    local to the row and done on packed arrays: exploding thousands of runs a pair into a shuffle costs ten times as much.
    """
    form = lambda c: text.collapse(F.lower(F.coalesce(c, F.lit("")))).alias(c)
    return pairs.select("id", form("q"), form("s")).mapInArrow(_cosines, f"id {dict(pairs.dtypes)['id']}, cosine double")


def _gram_table(texts: DataFrame, ident: str, n: int) -> DataFrame:
    """(ident, g, a): hashes of the runs of n tokens of each text and how often it has them."""
    grams = text.let(text.tokens("text"), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, n)))))
    return texts.select(ident, F.explode(grams).alias("g")).groupBy(ident, "g").agg(F.count("*").alias("a"))


def containment_join(items: DataFrame, docs: DataFrame, n: int = 8, least: float = 0.5) -> DataFrame:
    """(item_id, doc_id, total, matched): documents that hold at least ``least`` of the runs of n tokens of an item.

    ``items`` (item_id, text) against all ``docs`` (doc_id, text), runs counted as often as both have them. No pair is made
    that can't qualify: a document with that share has one of the item's rarest runs, of which just so many are taken that
    the others fall short of the share. Runs are counted over all documents; a run that stands nowhere costs nothing. The few
    pairs left are counted on their own tokens, row by row. Null ids and texts, and items under n tokens, match nothing; repeated rows count once.
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null").distinct()
    mine = _gram_table(items, "item_id", n)
    theirs = _gram_table(docs, "doc_id", n).join(mine.select("g").distinct(), "g", "left_semi").select("doc_id", "g").persist()
    df = theirs.groupBy("g").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "g")
    ranked = mine.join(df, "g", "left").withColumn("before", F.sum("a").over(rare_first) - F.col("a")).withColumn("total", F.sum("a").over(Window.partitionBy("item_id")))
    keys = ranked.where((F.col("total") - F.col("before") >= least * F.col("total")) & F.col("df").isNotNull()).select("item_id", "g")
    pairs = keys.join(theirs, "g").select("item_id", "doc_id").distinct()
    side = lambda d, i, c: d.select(i, text.tokens("text").alias(c))
    both = pairs.join(side(items, "item_id", "q"), "item_id").join(side(docs, "doc_id", "s"), "doc_id")
    found = exposures(both.select(F.struct("item_id", "doc_id").alias("id"), "q", "s"), n)
    return found.where(F.col("matched") >= least * F.col("total")).where("total > 0").select("id.item_id", "id.doc_id", "total", "matched")
