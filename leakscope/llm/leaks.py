"""Evaluation texts inside a corpus, by canonical template windows and an exact check of each candidate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.words import U, flat_binaries, flat_lists, gram_hashes, mix, power_tables, sliding_min, word_array
from leakscope.session import spread

WINDOW = 5
#: Letters that make a window of five words telling, words that do so in a wide template, and its greatest length.
LETTERS, REAL, WIDEST = 32, 5, 40
#: Fixed list of words for units.
UNITS = "ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years kb mb gb tb kib mib gib b byte bytes percent px km m cm mm kg g mg hz khz mhz ghz times lines rows records".split()
#: Lists looked at before the search for consistent slots of one pair gives up and calls them inconsistent.
SEARCH = 5_000_000
_NUM32, _UNIT32, _NAME32 = (np.uint32(x) for x in (3, 4, 6))


def coded_words(text):
    """Column array<bigint>: a word as 57 bits of its hash, 6 bits of its length (63 at most) and whether it begins with a digit."""
    return F.transform(
        word_array(text),
        lambda w: F.xxhash64(w).bitwiseAND(F.lit(-128))
        .bitwiseOR(F.shiftleft(F.least(F.length(w), F.lit(63)), 1).cast("long"))
        .bitwiseOR(((w >= "0") & (w < ":")).cast("long")),
    )


def _narrow(words: np.ndarray) -> np.ndarray:
    """25 bits of hash, 6 of length and the digit flag in 32 bits."""
    return ((words >> U(39)) << U(7) | (words & U(127))).astype(np.uint32)


def _member(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return kinds[np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)] == x if len(kinds) else np.zeros(len(x), bool)


def canonical(words: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(placeholders for numbers, units and listed names, else the words; lengths, 1 for a placeholder).

    What becomes of a word depends on that word alone, so equal words give equal templates wherever they stand.
    """
    number = (words & np.uint32(1)).astype(bool)
    out, size = words.copy(), ((words >> np.uint32(1)) & np.uint32(63)).astype(np.int64)
    out[number] = _NUM32
    out[_member(words, _UNIT_WORDS)] = _UNIT32
    if len(names):
        out[_member(words, names)] = _NAME32
    size[out < 8] = 1
    return out, size


def _word_codes(words) -> np.ndarray:
    """Codes of given lower-case words, computed as the JVM does."""
    import xxhash

    values = [(xxhash.xxh64(w.encode(), seed=42).intdigest() & ~127) | min(len(w), 63) << 1 | ("0" <= w < ":") for w in words]
    return _narrow(np.array(values, U)) if values else np.empty(0, np.uint32)


_UNIT_WORDS = np.unique(_word_codes(UNITS))


def wide_templates(code: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """For each word the hash of the template that begins there and is as long as it takes to hold REAL words, no less than ``span``.

    A window of little but placeholders says nothing, so it is widened until it does. At WIDEST words it ends in any case.
    No window (all bits set) where the text ends before.
    """
    n = len(code)
    real = np.concatenate([[0], np.cumsum(code >= 8)])
    end = np.searchsorted(real, real[:-1] + REAL)
    end = np.minimum(np.maximum(end, np.arange(n) + span), np.arange(n) + WIDEST)
    last = np.repeat(offsets[1:], np.diff(offsets))
    up, down = power_tables(n)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(code.astype(U) + U(1)) * up[:n], dtype=U)])
    inside = end <= last
    stop = np.where(inside, end, np.arange(n))
    return np.where(inside, mix((sums[stop] - sums[:-1]) * down[:n] + (stop - np.arange(n)).astype(U)), ~U(0))


def template_anchors(words: np.ndarray, offsets: np.ndarray, names: np.ndarray, run: int, refilled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of the text) of windows of canonical words of many texts, given as flat words and offsets.

    Any ``run`` consecutive windows hold one, the same in every text. The window with the most letters is preferred, since
    it is rarest, then the least hash. Where even that one has fewer than LETTERS letters (fixed phrases, rows of numbers),
    there are two keys instead: that of the run's words as they stand, for verbatim copies, and, if ``refilled`` and a
    placeholder is among them, the least hash of four neighbouring wide templates, for copies with other values. A text gives
    each key once.
    """
    span = WINDOW + run - 1
    starts = len(words) - span + 1
    if starts < 1:
        return np.empty(0, U), np.empty(0, np.int64)
    code, size = canonical(words, names)
    h = gram_hashes(code.astype(U), WINDOW)
    sums = np.concatenate([[0], np.cumsum(size)])
    rank = (U(511) - np.minimum(sums[WINDOW:] - sums[:-WINDOW], 511).astype(U)) << U(55) | h >> U(9)
    best = sliding_min(rank, run)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:starts] == owner[span - 1 :]
    fresh = np.ones(starts, bool)
    fresh[1:] = (best[1:] != best[:-1]) | (owner[1:starts] != owner[: starts - 1]) | ~inside[:-1]
    plain = best >> U(55) > U(511 - LETTERS)
    rich = np.flatnonzero(inside & fresh & ~plain)
    poor = np.flatnonzero(inside & plain)
    raw = mix(words.astype(U) + U(1))
    poor_keys = raw[poor]
    for k in range(1, span):
        poor_keys = poor_keys * U(0xC2B2AE3D27D4EB4F) + raw[poor + k]
    slotted = np.concatenate([[0], np.cumsum(code < 8)])
    slotted = slotted[span:] > slotted[:-span]
    each = np.where(inside & plain & slotted, wide_templates(code, offsets, span)[:starts], ~U(0)) if refilled else np.full(starts, ~U(0))
    wide = each.copy()
    for k in range(1, min(4, starts)):
        wide[:-k] = np.where(owner[: starts - k] == owner[k:starts], np.minimum(wide[:-k], each[k:]), wide[:-k])
    wide_at = np.flatnonzero((each != ~U(0)) & (wide != ~U(0)))
    keys = np.concatenate([best[rich], mix(poor_keys), wide[wide_at]])
    owners = np.concatenate([owner[rich], owner[poor], owner[wide_at]])
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[once], owners[once]


def _token_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offs = flat_lists(b.column("w"))
            values = values.view(U)
            keep = np.flatnonzero(np.diff(offs) >= least)
            narrow = _narrow(values)
            keys, tokens = [], []
            for i in keep:
                part = narrow[offs[i] : offs[i + 1]]
                tokens.append(part.tobytes())
                keys.append(int(mix(np.sum(mix(values[offs[i] : offs[i + 1]] + np.arange(len(part), dtype=U) * U(0x9E3779B97F4A7C15)), dtype=U, keepdims=True)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["w"]).take(pa.array(keep)).columns, pa.array(keys, pa.int64()), pa.array(tokens, pa.binary())], names=[*(n for n in b.schema.names if n != "w"), "key", "tokens"])

    return run


def _anchor_rows(names: np.ndarray, run_length: int, refilled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners = template_anchors(*flat_binaries(b.column("tokens"), np.uint32), names, run_length, refilled)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column("key").take(pa.array(owners))], names=["h", "key"])

    return run


class Prepared:
    """The windows of one text that comparisons need, each made once."""

    def __init__(self, words: np.ndarray, names: np.ndarray):
        self.words, self.names = words, names
        self.code = canonical(words, names)[0]
        self.windows = gram_hashes(self.code.astype(U), WINDOW)

    @cached_property
    def kinds(self) -> np.ndarray:
        return np.unique(self.windows)

    @cached_property
    def plain(self) -> np.ndarray:
        return gram_hashes(self.words.astype(U), WINDOW)

    @cached_property
    def plain_kinds(self) -> np.ndarray:
        return np.unique(self.plain)


def _longest(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def filled_slots(field: Prepared, doc: Prepared, found: np.ndarray) -> tuple[dict[int, int], bool]:
    """(value of the document for each value in a slot of the field, whether each is always replaced alike).

    ``found`` are the field's windows whose templates the document has. They are consistent if values can be replaced alike
    so that each window stands somewhere in the document. Where a template recurs, its places are those of the longest
    matching runs that agree with each other. A window that fits nowhere doesn't count if it continues neither of the runs
    beside it, nor lies in a longer run that was refused: the copy was cut there, and its template stands in the document for
    other reasons. Otherwise all places of all windows are tried.
    """
    slotted = field.code < 8
    order = np.argsort(doc.windows, kind="stable")
    ranked = doc.windows[order]
    low, high = (np.searchsorted(ranked, field.windows[found], side) for side in ("left", "right"))
    places = {int(i): order[a:b] for i, a, b in zip(found, low, high) if slotted[i : i + WINDOW].any()}
    first: dict[int, int] = {}
    if all([_agrees(first, field, doc, i, int(j[0])) for i, j in places.items()]):
        return first, True
    offset = np.zeros(len(field.windows) + len(doc.windows), bool)
    for i, j in places.items():
        offset[j - i + len(field.windows)] = True
    runs = []
    for d in (np.flatnonzero(offset) - len(field.windows)).tolist():
        a, b = max(0, -d), min(len(field.windows), len(doc.windows) - d)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (field.windows[a:b] == doc.windows[a + d : b + d]).view(np.int8), [0]]))) + a
        runs += [(int(x - y), int(x), d) for x, y in zip(edges[::2], edges[1::2])]
    runs.sort()
    slots: dict[int, int] = {}
    put: dict[int, int] = {}
    longest, reach = 0, np.zeros(len(field.windows), np.int64)
    for size, start, d in runs:
        reach[start : start - size] = np.maximum(reach[start : start - size], -size)
        mine = [i for i in range(start, start - size) if i in places and i not in put]
        if mine:
            trial = dict(slots)
            if all(_agrees(trial, field, doc, i, i + d) for i in mine):
                slots, longest = trial, max(longest, -size)
                put |= dict.fromkeys(mine, d)
    for i in places.keys() - put.keys():
        for j in places[i].tolist():
            trial = dict(slots)
            if _agrees(trial, field, doc, i, j):
                slots = trial
                put[i] = j - i
                break
    known = np.array(sorted(put), np.int64)
    cut = True
    for i in places.keys() - put.keys():
        k = int(np.searchsorted(known, i))
        beside = {put[int(x)] for x in known[max(0, k - 1) : k + 1]}
        cut &= reach[i] <= longest and bool(beside) and not any(0 <= i + d < len(doc.windows) and doc.windows[i + d] == field.windows[i] for d in beside)
    if cut:
        return slots, True
    rows: dict[tuple, list] = {}
    for i, js in places.items():
        at = np.flatnonzero(slotted[i : i + WINDOW])
        xs = (int(field.windows[i]), *field.words[i + at].tolist())
        if xs not in rows:
            ys = np.unique(doc.words[js[:, None] + at], axis=0).tolist()
            rows[xs] = [y for y in ys if len(set(zip(xs[1:], y))) == len(set(xs[1:]))]
    solved = _alike([(xs[1:], ys) for xs, ys in rows.items()])
    return (first, False) if solved is None else (solved, True)


def _agrees(slots: dict[int, int], field: Prepared, doc: Prepared, i: int, j: int) -> bool:
    """Adds the slots of the field's window at ``i``, put at ``j`` of the document; whether none was filled differently before."""
    same = True
    for k in range(WINDOW):
        if field.code[i + k] < 8:
            y = int(doc.words[j + k])
            same &= slots.setdefault(int(field.words[i + k]), y) == y
    return same


def _alike(rows: list[tuple[tuple, list]], steps: int = SEARCH) -> dict[int, int] | None:
    """One value for each value so that every row (values, lists that may replace them) gets one of its lists, or None.

    Lists that no other row can agree with are struck out until none is left to strike; only then one is tried.
    """
    stack = [rows]
    while stack:
        rows, before = stack.pop(), -1
        while (total := sum(len(ys) for _, ys in rows)) != before:
            before, steps = total, steps - total
            may: dict[int, set] = {}
            for xs, ys in rows:
                for k, x in enumerate(xs):
                    seen = {y[k] for y in ys}
                    may[x] = may[x] & seen if x in may else seen
            rows = [(xs, [y for y in ys if all(y[k] in may[x] for k, x in enumerate(xs))]) for xs, ys in rows]
        if not all(ys for _, ys in rows):
            continue
        free = min((k for k in range(len(rows)) if len(rows[k][1]) > 1), key=lambda k: len(rows[k][1]), default=None)
        if free is None:
            return {x: y for xs, ys in rows for x, y in zip(xs, ys[0])}
        if steps < 0:
            return None
        xs, ys = rows[free]
        stack += [[*rows[:free], (xs, [y]), *rows[free + 1 :]] for y in reversed(ys)]
    return None


def compare(field: Prepared, doc: Prepared, run: int, share: float, least: int, slots: bool = True) -> tuple[bool, float, float, int, bool]:
    """(leaked, share of windows, share of template windows, changed slots, slots consistent) of one field in one document.

    Without ``slots`` the last two aren't looked at.
    Equal windows have equal templates, so a pair whose templates reach neither bound is settled by these alone.
    """
    both = _member(field.windows, doc.kinds)
    template = float(_member(field.kinds, doc.kinds).mean()) if len(field.kinds) else 0.0
    need = run - WINDOW + 1
    if template < share and _longest(both) < need:
        # without placeholders template shares are those of the words; with some, the words' share is at most as many windows
        if len(field.words) < least or both.sum() < share * len(field.plain_kinds):
            return False, 0.0, template, 0, True
    part = float(_member(field.plain_kinds, doc.plain_kinds).mean()) if len(field.plain_kinds) else 0.0
    leaked = len(field.words) >= least and part >= share
    if not leaked and len(field.words) >= run and _longest(_member(field.plain, doc.plain_kinds)) >= need:
        leaked = bool(np.isin(gram_hashes(field.words.astype(U), run), gram_hashes(doc.words.astype(U), run)).any())
    changed, steady = 0, True
    if slots and not leaked and template >= share:
        filled, steady = filled_slots(field, doc, np.flatnonzero(both))
        changed = sum(x != y for x, y in filled.items())
    return leaked, part, template, changed, steady


def _compared(names: np.ndarray, run_words: int, share: float, least: int, slots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, Prepared] = {}

        def prepared(side: str, key: int, tokens: bytes) -> Prepared:
            if (side, key) not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[side, key] = Prepared(np.frombuffer(tokens, np.uint32), names)
            return kept[side, key]

        for b in batches:
            f, d = b.column("f").to_pylist(), b.column("d").to_pylist()
            out = [compare(prepared("f", i, x), prepared("d", j, y), run_words, share, least, slots) for i, j, x, y in zip(f, d, b.column("tf").to_pylist(), b.column("td").to_pylist())]
            cols = list(zip(*out)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()))]
            t = pa.RecordBatch.from_arrays([b.column("f"), b.column("d"), *arrays], names=["f", "d", "leaked", "share", "template_share", "changed", "consistent"])
            yield t.filter(pa.array([x[0] or x[2] >= share for x in out], pa.bool_()))

    return run


def leak_candidates(items: DataFrame, docs: DataFrame, names: list[str] = (), run: int = 20, share: float = 0.5, least: int = 40, refilled: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item members, document members, links) of item texts that stand in documents, fully or in part.

    ``items`` (item_id, field, text) and ``docs`` (doc_id, text). Members map ids to classes of equal word sequences
    (f and d); links are (f, d, leaked, share, template_share, changed, consistent), a row for each pair of classes where
    ``leaked`` holds or ``share`` of the item's template windows stand in the document. ``leaked``: the document has
    ``run`` consecutive words of the item, or ``share`` of its distinct five-word windows, the item having ``least`` words.
    ``changed`` counts placeholders filled differently, ``consistent`` says whether each value was always replaced alike.

    Candidates share a template window (five words, in which placeholders stand for numbers, units and ``names``) that is first in
    rank among four consecutive ones or, where windows say too little, the words of eight as they stand and, if ``refilled``,
    a wider template; without it only copies with other values are lost, never a ``leaked`` one. Any copied stretch of eight words has such a window on both sides. At least half
    of an item of 40 words cannot be kept without a stretch of eight, whatever is replaced, inserted or moved.

    Null ids and texts and texts of under 20 words are ignored; repeated rows count once; hot copies are compared once per
    class. ``names`` is a bounded list given by the caller. Empty input gives empty results.
    """
    codes = np.unique(_word_codes({w for n in names for w in n.lower().split()}))
    short = min(run, 20)
    f_rows = spread(items.select("item_id", "field", "text").where("item_id is not null and text is not null")).select("item_id", "field", coded_words(F.col("text")).alias("w"))
    d_rows = spread(docs.select("doc_id", "text").where("doc_id is not null and text is not null")).select("doc_id", coded_words(F.col("text")).alias("w"))
    kinds = dict(items.dtypes) | dict(docs.dtypes)
    f_rows = f_rows.mapInArrow(_token_rows(short), f"item_id {kinds['item_id']}, field string, key long, tokens binary")
    d_rows = d_rows.mapInArrow(_token_rows(short), f"doc_id {kinds['doc_id']}, key long, tokens binary")
    f_one, d_one = (x.select("key", "tokens").dropDuplicates(["key"]).persist() for x in (f_rows, d_rows))
    f_anchor, d_anchor = (x.mapInArrow(_anchor_rows(codes, 4, refilled), "h long, key long") for x in (f_one, d_one))
    pairs = f_anchor.withColumnRenamed("key", "f").join(d_anchor.withColumnRenamed("key", "d"), "h").select("f", "d").distinct()
    links = (
        pairs.join(f_one.select(F.col("key").alias("f"), F.col("tokens").alias("tf")), "f")
        .join(d_one.select(F.col("key").alias("d"), F.col("tokens").alias("td")), "d")
        .mapInArrow(_compared(codes, run, share, least, refilled), "f long, d long, leaked boolean, share double, template_share double, changed int, consistent boolean")
    )
    return f_rows.select("item_id", "field", F.col("key").alias("f")).distinct(), d_rows.select("doc_id", F.col("key").alias("d")).distinct(), links


def leaks(items: DataFrame, docs: DataFrame, names: list[str] = (), **how) -> DataFrame:
    """(doc_id, item_id, field, share): every document that holds a leaked item. See leak_candidates."""
    f, d, links = leak_candidates(items, docs, names, refilled=False, **how)
    return links.where("leaked").join(f, "f").join(d, "d").select("doc_id", "item_id", "field", F.round("share", 6).alias("share"))


def reparameterised(items: DataFrame, docs: DataFrame, names: list[str] = (), **how) -> DataFrame:
    """(doc_id, item_id, field, template_share, changed): items that stand in a document with other values in their slots."""
    f, d, links = leak_candidates(items, docs, names, **how)
    return (
        links.where("not leaked and consistent and changed > 0").join(f, "f").join(d, "d")
        .select("doc_id", "item_id", "field", F.round("template_share", 6).alias("template_share"), "changed")
    )
