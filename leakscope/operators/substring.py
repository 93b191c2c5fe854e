"""Exact substring join without comparing every pattern with every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions import text as T
from leakscope.operators.exposure import runs
from leakscope.session import small

#: Characters of the keys of patterns without a whole word inside.
CHARS = 4


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, ns, ks = [], [], []
        for i, (t, sizes) in enumerate(zip(b.column("f").to_pylist(), b.column("sizes").to_pylist())):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            for n in sizes:
                if len(c) >= n:
                    at.append(i)
                    ns.append(n)
                    ks.append(np.unique(runs(c, n)))
        ends = np.cumsum([0, *(len(k) for k in ks)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ks) if ks else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(ns, pa.int32()), lists], names=["id", "n", "ks"])


def _char_runs(rows: DataFrame) -> DataFrame:
    """(id, n, ks) of (id, f, sizes): different hashes of the runs of n characters of a text, for each of the sizes."""
    return rows.mapInArrow(_cut, f"id {dict(rows.dtypes)['id']}, n int, ks array<bigint>")


def substring_join(patterns: DataFrame, texts: DataFrame, words: int = 3, match: Callable[[Column, Column], Column] = F.contains, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, text_id) for each (id, pattern) that stands verbatim in a (text_id, text).

    A pattern is keyed by one window of whole words inside it, the one with most letters, and meets only texts that
    have this window; ``contains`` decides. The first and last word of a pattern may be parts of longer ones, so they
    aren't used; a pattern with fewer inner words is keyed by all it has. One without any, such as a phrase in a script
    that doesn't part words, is keyed by one run of CHARS of its characters, or by all of them if it is shorter; texts are cut into
    such runs only if there are such patterns. Equal patterns and texts are compared once. Nulls and empty strings
    match nothing. The keys of few patterns are broadcast (see session.small), so that the windows of the texts never leave their
    task; those of many meet them in a shuffle.

    ``match`` (text, pattern) may decide by another form of both, as long as it keeps the words and ``form`` of a
    pattern stands in ``form`` of every text that it matches.
    """
    p = patterns.select("id", F.col("pattern").alias("p")).where("p != ''").distinct()
    q = T.once(p.select("p").distinct(), "w", T.let(T.words("p"), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))))
    sized = q.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(words)))
    windows = sized.select("p", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("k"))
    best = Window.partitionBy("p").orderBy(F.desc(F.length("k")), "k")
    keyed = windows.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.xxhash64("p").alias("h"), "n", F.xxhash64(F.split("k", " ")).alias("k"))
    t = texts.select("text_id", F.col("text").alias("t")).where("t != ''").distinct()
    every = T.once(t, "w", T.words("t"))
    run = lambda a, n: F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.xxhash64(F.slice(a, i, n)))
    lengths = F.explode(F.sequence(F.lit(1), F.lit(words)))
    grams = every.select("text_id", "w", lengths.alias("n")).where(F.size("w") >= F.col("n"))
    keys = grams.select("text_id", "n", F.explode(F.array_distinct(run(F.col("w"), F.col("n")))).alias("k"))
    by_word = keys.join(small(keyed, patterns), ["n", "k"]).select("text_id", "h")

    shape = lambda c: F.col(c) if form is None else form(F.col(c))
    bare = q.where(F.size("w") == 0).select("p", shape("p").alias("f")).withColumn("n", F.least(F.length("f"), F.lit(CHARS))).where("n > 0")
    marks = _char_runs(bare.select(F.col("p").alias("id"), "f", F.array("n").alias("sizes"))).select(F.xxhash64("id").alias("h"), "n", F.array_min("ks").alias("k"))
    sizes = bare.agg(F.collect_set("n").alias("sizes"))  # one row of at most CHARS numbers
    cut = t.join(F.broadcast(sizes), F.size("sizes") > 0).select(F.col("text_id").alias("id"), shape("t").alias("f"), "sizes")
    by_char = _char_runs(cut).select(F.col("id").alias("text_id"), "n", F.explode("ks").alias("k")).join(small(marks, patterns), ["n", "k"]).select("text_id", "h")

    pairs = by_word.union(by_char).distinct().join(q.select(F.xxhash64("p").alias("h"), "p"), "h").select("text_id", "p")
    return pairs.join(t, "text_id").where(match(F.col("t"), F.col("p"))).join(p, "p").select("id", "text_id").distinct()
