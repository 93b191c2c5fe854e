"""Long exact stretches of characters shared between texts, by relative Lempel-Ziv parsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.words import U, mix, power_tables, sliding_min
from leakscope.operators.pairs import key_pairs
from leakscope.session import spread

_CHUNK = 1 << 24


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k characters."""
    n = len(chars)
    if n < k:
        return np.empty(0, U)
    up, down = power_tables(n)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((chars.astype(U) + U(1)) * up[:n], dtype=U)])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def anchors(chars: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of k-stretches such that any stretch of ``length`` characters holds one, the same in each text.

    The least hash of each ``length - k + 1`` neighbouring ones is taken, the leftmost of equal ones.
    """
    w, found, values = length - k + 1, [], []
    for start in range(0, max(1, len(chars) - length + 1), _CHUNK - length):
        part = chars[start : start + _CHUNK]
        x = char_hashes(part, k)
        if len(x) < w:
            continue
        low = U(_CHUNK - 1)
        best = sliding_min((x & ~low) | np.arange(len(x), dtype=U), w)
        at = np.unique((best & low).astype(np.int64))
        found.append(at + start)
        values.append(x[at])
    if not found:
        return np.empty(0, U), np.empty(0, np.int64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return np.concatenate(values)[first], pos


def relative_spans(doc: np.ndarray, ref: np.ndarray, k: int, length: int) -> list[tuple[int, int]]:
    """Merged [start, end) parts of ``doc`` that consist of stretches of ``length`` or more characters found in ``ref``.

    The document is parsed from the left: where the next k characters occur in the reference, they start a factor that
    runs as far as the two agree; elsewhere a character is a literal. A factor of ``length`` is a span. A stretch that
    the parse cut in two lies across a factor boundary, so the windows across each boundary are looked up as well.
    """
    kd, kr = char_hashes(doc, k), char_hashes(ref, k)
    if len(doc) < length or len(ref) < length:
        return []
    order = np.argsort(kr, kind="stable")
    keys = kr[order]
    slot = np.minimum(np.searchsorted(keys, kd), len(keys) - 1)
    hits = np.flatnonzero(keys[slot] == kd)
    marks, spans, p, grams = [], [], 0, None
    while True:
        i = np.searchsorted(hits, p)
        if i == len(hits):
            break
        p = int(hits[i])
        q = int(order[slot[p]])
        n = min(len(doc) - p, len(ref) - q)
        differ = np.flatnonzero(doc[p : p + n] != ref[q : q + n])
        size = int(differ[0]) if len(differ) else n
        if size < k:  # an equal hash of other characters
            p += 1
            continue
        if size >= length:
            spans.append((p, p + size))
        marks += [p, p + size]
        p += size
    if not marks:
        return []
    edges = np.zeros(len(doc) + 1, np.int64)
    for s, e in spans:
        edges[s] += 1
        edges[e] -= 1
    # windows that begin and end with characters that occur in the reference, across a boundary, and in no long factor yet
    ok = np.zeros(len(doc) - length + 1, bool)
    for m in set(marks):
        ok[max(0, m - length + 1) : max(0, m)] = True
    inner = np.zeros(len(kd), bool)
    inner[hits] = True
    ok &= inner[: len(ok)] & inner[length - k : length - k + len(ok)]
    for s, e in spans:
        ok[s : max(s, e - length + 1)] = False
    at = np.flatnonzero(ok)
    if len(at):
        grams = np.sort(char_hashes(ref, length))
        own = char_hashes(doc, length)[at]
        place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        at = at[grams[place] == own]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
    cover = np.concatenate([[0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]])
    step = np.diff(cover)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _anchor_rows(k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners = [], []
            for fp, text in zip(b.column("fp").to_pylist(), b.column("t").to_pylist()):
                h = np.unique(anchors(code_points(text), k, length)[0])
                keys.append(h.view(np.int64))
                owners.append(np.full(len(h), fp, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["h", "fp"])

    return run


def _parsed(k: int, length: int):
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sa, sb = [], [], []
            for i, (x, y) in enumerate(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())):
                x, y = code_points(x), code_points(y)
                if one := relative_spans(x, y, k, length):
                    keep.append(i)
                    sa.append([{"s": s, "e": e} for s, e in one])
                    sb.append([{"s": s, "e": e} for s, e in relative_spans(y, x, k, length)])
            ids = b.select(["a", "b"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(sa, span), pa.array(sb, span)], names=["a", "b", "sa", "sb"])

    return run


def shared_span_classes(texts: DataFrame, ident: str, text: str, length: int = 200, k: int = 128) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of equal texts, and the pairs of classes that share a stretch of ``length`` characters.

    ``members``: (id, fp, n), n being the number of characters. ``links``: (a, b, sa, sb) with a < b and the shared parts
    of either text as arrays of (s, e). Candidates share an anchor of k characters, which any common stretch of ``length``
    characters contains; each is then parsed against the other. Nothing is normalised.

    Null ids, and texts that are null or shorter than ``length``, belong to no class. Repeated rows count once. Texts of
    any length are read whole. Empty input gives empty results; other columns are ignored.
    """
    src = spread(texts.select(F.col(ident).alias("id"), F.col(text).alias("t")).where("id is not null").where(F.length("t") >= length))
    src = src.withColumn("fp", F.xxhash64("t"))
    one = src.select("fp", "t").dropDuplicates(["fp"]).persist()
    pairs = key_pairs(one.mapInArrow(_anchor_rows(k, length), "h long, fp long"), "h", "fp").distinct()
    side = lambda s, t: one.select(F.col("fp").alias(s), F.col("t").alias(t))
    links = (
        pairs.join(side("a", "ta"), "a").join(side("b", "tb"), "b").mapInArrow(_parsed(k, length), "a long, b long, sa array<struct<s:int,e:int>>, sb array<struct<s:int,e:int>>")
    )
    return src.select("id", "fp", F.length("t").alias("n")).distinct(), links


def shared_span_pairs(texts: DataFrame, ident: str, text: str, length: int = 200) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different ids whose texts share ``length`` consecutive characters."""
    members, links = shared_span_classes(texts, ident, text, length)
    across = (
        links.select("a", "b")
        .join(members.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b")
        .where("x != y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    within = key_pairs(members, "fp", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return across.union(within).distinct()


#: Different surroundings of one anchor that a task compares in memory; those of a more common one are spread over all tasks.
VARIANTS = 4096


def _block_rows(k: int, length: int):
    """(h, fp, pos, left, right) of each anchor of a text that other texts have too, with what may belong to a stretch around it."""
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, fps, at, left, right = [], [], [], [], []
            for fp, text, wanted in zip(b.column("fp").to_pylist(), b.column("t").to_pylist(), b.column("hs").to_pylist()):
                h, pos = anchors(code_points(text), k, length)
                keep = np.isin(h.view(np.int64), np.array(wanted, np.int64))
                for x, p in zip(h[keep].view(np.int64).tolist(), pos[keep].tolist()):
                    hs.append(x)
                    fps.append(fp)
                    at.append(p)
                    left.append(text[max(0, p - reach) : p])
                    right.append(text[p + k : p + length])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(fps, pa.int64()), pa.array(at, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["h", "fp", "pos", "left", "right"])

    return run


def _shared_offsets(h: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[str], right: list[str], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset at which a window around an anchor also stands in another text; -1 if none does.

    At offset o the window has o characters before the anchor and reach - o behind it. Equal windows are found by hashes
    of both parts, which grow by a character a step, for all rows at once.
    """
    n = len(h)
    chars = np.zeros((2, n, reach), np.uint64)
    size = np.zeros((2, n), np.int64)
    for i, (x, y) in enumerate(zip(left, right)):
        x, y = code_points(x)[::-1], code_points(y)
        size[:, i] = len(x), len(y)
        chars[0, i, : len(x)], chars[1, i, : len(y)] = x, y
    parts = np.zeros((2, reach + 1, n), U)
    for o in range(reach):
        parts[:, o + 1] = mix((parts[:, o] + chars[:, :, o] + U(1)) * U(0x9E3779B97F4A7C15))
    first, last = np.full(n, -1), np.full(n, -1)
    for o in range(reach + 1):
        rows = np.flatnonzero((size[0] >= o) & (size[1] >= reach - o))
        if not len(rows):
            continue
        key = mix(h[rows].view(U) + mix(parts[0, o, rows] + U(o))) + parts[1, reach - o, rows]
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        differ = np.minimum.reduceat(low[rows][order], start) != np.maximum.reduceat(high[rows][order], start)
        hit = rows[order][np.repeat(differ, np.diff(np.r_[start, len(rows)]))]
        first[hit] = np.where(first[hit] < 0, o, first[hit])
        last[hit] = o
    return first, last


def _compare_variants(k: int, length: int):
    """Rows sorted by anchor; whole anchors are compared together, the last one waits for the next batch."""

    def done(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy() for c in ("h", "low", "high")}
        first, last = _shared_offsets(cols["h"], cols["low"], cols["high"], table.column("left").to_pylist(), table.column("right").to_pylist(), length - k)
        keep = np.flatnonzero(last >= 0)
        return pa.RecordBatch.from_arrays([table.column("v").combine_chunks().take(pa.array(keep)), pa.array(first[keep].astype(np.int32)), pa.array(last[keep].astype(np.int32))], names=["v", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if cut:
                yield done(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def shared_spans(texts: DataFrame, ident: str, text: str, length: int = 200, k: int = 128) -> tuple[DataFrame, DataFrame]:
    """(members, spans): members as in shared_span_classes, spans (fp, s, e) cover all that a class of texts shares with others.

    Linear in the text however many texts share a block: no pair of texts is ever made. Any stretch of ``length`` holds an
    anchor, the same in every text. The surroundings of the anchors that several classes have are the reference blocks,
    one for each different content, so copies of a common block fold into one with partial aggregation. A block of several
    classes is shared as a whole. The others, at the ends of shared stretches, are compared with the blocks of their anchor
    only, by hashes of their windows; where an anchor has more than VARIANTS blocks, window by window in one aggregate.
    """
    reach = length - k
    src = spread(texts.select(F.col(ident).alias("id"), F.col(text).alias("t")).where("id is not null").where(F.length("t") >= length)).withColumn("fp", F.xxhash64("t"))
    one = src.select("fp", "t").dropDuplicates(["fp"]).persist()
    rows = one.mapInArrow(_anchor_rows(k, length), "h long, fp long")
    shared = rows.groupBy("h").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("h")
    mine = rows.join(shared, "h").groupBy("fp").agg(F.collect_set("h").alias("hs"))
    blocks = one.join(mine, "fp").select("fp", "t", "hs").mapInArrow(_block_rows(k, length), "h long, fp long, pos int, left string, right string").withColumn("v", F.xxhash64("h", "left", "right")).persist()
    variants = blocks.groupBy("h", "v", "left", "right").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).persist()
    whole = variants.where("low != high").select("v", F.greatest(F.lit(0), F.lit(reach) - F.length("right")).alias("first"), F.length("left").alias("last")).where("first <= last")
    counts = variants.groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("low") == F.col("high")).alias("single")).where("n > 1 and single > 0").select("h", "n")
    open_ = variants.join(counts, "h")
    few = open_.where(F.col("n") <= VARIANTS).select("h", "v", "low", "high", "left", "right").repartition("h").sortWithinPartitions("h").mapInArrow(_compare_variants(k, length), "v long, first int, last int")
    offsets = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(reach) - F.length("right")), F.length("left")))
    many = open_.where((F.col("n") > VARIANTS) & (F.length("left") + F.length("right") >= reach)).select("h", "v", "low", "high", "left", "right", offsets.alias("o"))
    window = F.xxhash64("h", "o", F.substr("left", F.length("left") - F.col("o") + 1), F.substr("right", F.lit(1), F.lit(reach) - F.col("o")))
    many = many.select("v", "o", "low", "high", window.alias("w"))
    hot = many.groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("w")
    most = many.select("v", "o", "w").join(hot, "w").groupBy("v").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    found = whole.union(few).union(most).groupBy("v").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = blocks.select("fp", "v", "pos").join(found, "v").select("fp", (F.col("pos") - F.col("last")).alias("s"), (F.col("pos") + F.lit(length) - F.col("first")).alias("e"))
    return src.select("id", "fp", F.length("t").alias("n")).distinct(), spans.distinct()


def shared_share(texts: DataFrame, ident: str, text: str, length: int = 200) -> DataFrame:
    """(id, n_chars, shared_chars, shared_share, stretches) of each id that shares a stretch with another.

    ``shared_chars`` counts the characters inside any shared stretch once; ``stretches`` the parts of the text they form.
    A text that stands under several ids is shared as a whole. See shared_spans for what is ignored and how it scales.
    """
    members, spans = shared_spans(texts, ident, text, length)
    before = Window.partitionBy("fp").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.withColumn("done", F.coalesce(F.max("e").over(before), F.lit(-1)))
        .groupBy("fp")
        .agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "done"))).alias("shared"), F.count_if(F.col("s") > F.col("done")).alias("stretches"))
    )
    sizes = members.groupBy("fp").agg(F.count("*").alias("copies"))
    rows = members.join(sizes, "fp").join(covered, "fp", "left").where("copies > 1 or shared is not null")
    copied = F.col("copies") > 1
    shared = F.when(copied, F.col("n")).otherwise(F.col("shared")).cast("long")
    return rows.select("id", F.col("n").alias("n_chars"), shared.alias("shared_chars"), F.round(shared / F.col("n"), 6).alias("shared_share"), F.when(copied, 1).otherwise(F.col("stretches")).cast("long").alias("stretches"))
