"""Mixing sources to target token shares by soft membership and projected-gradient least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.tokens import token_counts

#: Hashed tokens of the classifier. Its model is sources x BUCKETS numbers, whatever the data.
BUCKETS, MAX_SOURCES, STEPS, PASSES, TRIES, TOPUPS = 4096, 1000, 12, 2, 1025, 2
#: Each document is judged by a classifier that was fitted on the other halves.
FOLDS = 2


def _unpack(feats: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(feats, np.uint16).reshape(2, -1)
    return both[0].astype(np.int64), both[1].astype(np.float64)


def _bucket_sums(labels: list[str]):
    """Counts of hashed tokens and of documents by fold and label, summed in each task before they are sent."""
    index = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((FOLDS * len(labels), BUCKETS)), np.zeros(FOLDS * len(labels))
        for b in batches:
            for s, f, x in zip(b.column("source").to_pylist(), b.column("fold").to_pylist(), b.column("feats").to_pylist()):
                kinds, n = _unpack(x)
                total[f * len(labels) + index[s], kinds] += np.log1p(n)
                docs[f * len(labels) + index[s]] += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, np.arange(len(docs))])), pa.array(np.concatenate([j, np.full(len(docs), -1)])), pa.array(np.concatenate([total[i, j], docs]))], names=["label", "bucket", "n"])

    return run


class Classifier:
    """Multinomial naive Bayes on hashed tokens, with evidence damped by the length of the text."""

    def __init__(self, labels: list[str], counts: np.ndarray, docs: np.ndarray):
        self.labels = labels
        smooth = counts + 0.1
        self.weight = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.prior = np.log((docs + 1) / (docs + 1).sum())

    def posterior(self, feats: bytes) -> np.ndarray:
        kinds, n = _unpack(feats)
        n = np.log1p(n)
        score = self.prior + (self.weight[:, kinds] @ n) / np.sqrt(max(1.0, n.sum() / 16))
        p = np.exp(score - score.max())
        return p / p.sum()


def _fold(ident: str = "id"):
    return F.pmod(F.xxhash64(ident, F.lit("fold")), F.lit(FOLDS)).cast("int")


def fit_classifiers(rows: DataFrame, labels: list[str]) -> list[Classifier]:
    """A classifier for each fold from the labelled rows of the others, and at the end one from all.

    Sums are merged per (fold, label, bucket), whose number is bounded.
    """
    known = rows.where(F.col("source").isin(labels)).select("source", _fold().alias("fold"), "feats")
    sums = known.mapInArrow(_bucket_sums(labels), "label long, bucket long, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, docs = np.zeros((FOLDS * len(labels), BUCKETS)), np.zeros(FOLDS * len(labels))
    label, bucket, n = (sums.column(i).to_numpy() for i in range(3))
    docs[label[bucket < 0]] = n[bucket < 0]
    counts[label[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    counts, docs = counts.reshape(FOLDS, len(labels), BUCKETS), docs.reshape(FOLDS, len(labels))
    others = [Classifier(labels, counts.sum(axis=0) - counts[f], docs.sum(axis=0) - docs[f]) for f in range(FOLDS)]
    return [*others, Classifier(labels, counts.sum(axis=0), docs.sum(axis=0))]


def fit_classifier(rows: DataFrame, labels: list[str]) -> Classifier:
    """The classifier from all rows whose source is a label."""
    return fit_classifiers(rows, labels)[-1]


def _members(models: list[Classifier]):
    labels = models[0].labels
    index = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([models[f].posterior(x) for f, x in zip(b.column("fold").to_pylist(), b.column("feats").to_pylist())]).reshape(len(b), len(labels)).astype(np.float32)
            known = np.array([index.get(s, -1) for s in b.column("source").to_pylist()], np.int64)
            label = np.where(known >= 0, known, p.argmax(axis=1) if len(b) else known)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tokens"), pa.array(label.astype(np.int32)), pa.array([r.tobytes() for r in p], pa.binary())], names=["id", "tokens", "label", "p"])

    return run


def _rates(p: np.ndarray, cap: np.ndarray, start: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """Rates after the given gradient steps, each projected to between 0 and the cap; a rate follows from its row alone."""
    r = start.copy()
    for m in moves:
        np.clip(r - p @ m, 0.0, cap, out=r)
    return r


def _expected(labels: int, caps: np.ndarray, start: np.ndarray, moves: list[np.ndarray]):
    """Expected tokens by domain at the present rates, and the matrix of shared membership, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, matrix = np.zeros(labels), np.zeros((labels, labels))
        for b in batches:
            p = np.frombuffer(b"".join(b.column("p").to_pylist()), np.float32).reshape(-1, labels).astype(np.float64)
            t, label = b.column("tokens").to_numpy().astype(np.float64), b.column("label").to_numpy()
            r = _rates(p, caps[label], start[label], moves)
            total += (r * t) @ p
            free = (r > 1e-9) & (r < caps[label] - 1e-9)
            matrix += (p[free] * t[free, None]).T @ p[free]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(labels * (labels + 1))), pa.array(np.concatenate([total, matrix.ravel()]))], names=["i", "x"])

    return run


class Uses:
    """Whole uses of documents: rates times a scale per label, rounded by a fixed draw per document; then top-ups.

    A top-up (limit, threshold), both by label, adds one use to each document of at most ``limit`` tokens whose next draw
    lies below the threshold, as long as its cap allows. Uses follow from the row alone.
    """

    def __init__(self, labels: int, caps: np.ndarray, start: np.ndarray, moves: list[np.ndarray]):
        self.labels, self.caps, self.start, self.moves = labels, caps, start, moves
        self.scale: np.ndarray | None = None
        self.topups: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(self, b: pa.RecordBatch):
        p = np.frombuffer(b"".join(b.column("p").to_pylist()), np.float32).reshape(-1, self.labels).astype(np.float64)
        label = b.column("label").to_numpy()
        rate = np.maximum(_rates(p, self.caps[label], self.start[label], self.moves), 1e-3 * self.start[label])
        return rate, b.column("tokens").to_numpy().astype(np.float64), label, self.caps[label], b.column("u").to_numpy()

    def fixed(self, rate, t, label, cap, u) -> np.ndarray:
        n = np.minimum(cap, np.floor(rate * self.scale[label] + u))
        for j, (limit, threshold) in enumerate(self.topups):
            n += (n < cap) & (t <= limit[label]) & ((u * (7919 + 2 * j)) % 1.0 < threshold[label])
        return n

    def totals(self, grid: np.ndarray, limit: np.ndarray | None = None):
        """Tokens by label for each column of a grid of scales or, with a limit, of thresholds of a further top-up."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((self.labels, grid.shape[1]))
            for b in batches:
                rate, t, label, cap, u = self.rows(b)
                if limit is not None:
                    n = self.fixed(rate, t, label, cap, u)
                    may, draw = (n < cap) & (t <= limit[label]), (u * (7919 + 2 * len(self.topups))) % 1.0
                for j in range(grid.shape[1]):
                    now = np.minimum(cap, np.floor(rate * grid[label, j] + u)) if limit is None else n + (may & (draw < grid[label, j]))
                    total[:, j] += np.bincount(label, now * t, self.labels)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

        return run

    def chosen(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate, t, label, cap, u = self.rows(b)
            n = self.fixed(rate, t, label, cap, u).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("tokens"), pa.array(n), pa.array(rate), b.column("p")], names=["id", "label", "tokens", "repeats", "rate", "p"]).filter(pa.array(n > 0))


def _search(sums, make, want: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """For each label the greatest value found whose total doesn't pass what is wanted, and that total."""
    n = len(want)
    low, high, reached = np.zeros(n), np.full(n, top), np.zeros(n)
    for _ in range(PASSES):
        grid = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, TRIES)[None, :]
        got = sums(make(grid)).reshape(n, TRIES)
        at = np.maximum((got <= want[:, None] + 1e-6).sum(axis=1) - 1, 0)
        reached = got[np.arange(n), at]
        low, high = grid[np.arange(n), at], grid[np.arange(n), np.minimum(at + 1, TRIES - 1)]
    return low, reached


def mix(documents: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, total: int | None = None) -> DataFrame:
    """(id, source, tokens, repeats, rate): documents of one mixture whose token shares meet the targets.

    ``targets`` has (source, target_share, max_repeats), at most MAX_SOURCES rows. ``total`` is the size of the mixture in
    tokens, by default the largest that no source's cap forbids. Naive Bayes classifiers fitted on all labelled rows give
    each document its domain posteriors, each from the rows of the other fold. Projected gradient steps, preconditioned by the matrix of shared memberships,
    find rates between 0 and the cap whose expected domain totals match the targets in least squares; each step is one
    pass of sums. The rates are then rounded to whole uses, scaled per source so that real shares just don't pass the
    targets, and topped up with documents small enough for what is missing. Sources without a document, and a target that no scale reaches, leave a smaller share.

    A document whose source is null or no target counts under its likeliest domain. Null ids and texts are ignored,
    repeated rows count once, empty texts have no size and are not used, shares are normalised to sum to 1. Other columns
    are ignored. Empty tables give an empty result.
    """
    return _mixture(documents, targets, ident, text, source, tokenizer, total)[0].select("id", "source", "tokens", "repeats", "rate")


def _mixture(documents: DataFrame, targets: DataFrame, ident: str, text: str, source: str, tokenizer: str | None, total: int | None) -> tuple[DataFrame, list[str], np.ndarray]:
    """The mixture with the posteriors of its documents, the domains in order, and their expected tokens at the fitted rates."""
    spark = documents.sparkSession
    goal = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null and target_share > 0 and max_repeats > 0").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    id_type = dict(documents.dtypes)[ident]
    schema = f"id {id_type}, label int, tokens long, repeats int, rate double, p binary"
    labels = [g[0] for g in goal]
    docs = documents.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = token_counts(docs, "id", "text", tokenizer, ("source",), BUCKETS).where("tokens > 0").dropDuplicates(["id"]).persist()
    if not labels or rows.isEmpty():
        return spark.createDataFrame([], schema).select("id", F.lit("").alias("source"), "tokens", "repeats", "rate", "p"), labels, np.zeros(len(labels))
    caps = np.array([g[2] for g in goal], np.float64)
    share = np.array([g[1] for g in goal]) / sum(g[1] for g in goal)
    models = fit_classifiers(rows, labels)
    members = rows.withColumn("fold", _fold()).mapInArrow(_members(models), f"id {id_type}, tokens long, label int, p binary").withColumn("u", (F.pmod(F.xxhash64("id", F.lit("use")), F.lit(1 << 30)) + 0.5) / (1 << 30)).persist()
    have = np.zeros(len(labels))
    for k, t in members.groupBy("label").agg(F.sum("tokens")).collect():
        have[k] = t
    there = have > 0
    reach = float((have[there] * caps[there] / share[there]).min())
    size = float(min(total, reach) if total else reach)
    want = np.where(there, share, 0.0)
    want = want / want.sum() * size
    start = np.where(there, np.minimum(caps, want / np.maximum(have, 1)), 0.0)
    moves: list[np.ndarray] = []
    last = 0.0
    sums = lambda f: np.array([r[1] for r in sorted(members.mapInArrow(f, "i long, x double").groupBy("i").agg(F.sum("x")).collect())])
    n = len(labels)
    fitted = np.zeros(n)
    for _ in range(STEPS):
        x = sums(_expected(n, caps, start, moves))
        off, matrix = x[:n] - want, x[n:].reshape(n, n)
        if moves and np.square(off).sum() > last:
            moves[-1] = moves[-1] / 2  # it led too far
            continue
        fitted = x[:n]
        if np.abs(off).max() <= 1e-3 * size or (moves and np.square(off).sum() > 0.99 * last):
            break
        last = np.square(off).sum()
        moves.append(0.7 * np.linalg.solve(matrix + np.eye(n) * (1e-3 * np.trace(matrix) / n + 1e-9), off))
    else:
        moves = moves[:-1]
    uses = Uses(n, caps, start, moves)
    uses.scale, reached = _search(sums, uses.totals, want, 4096.0)
    for _ in range(TOPUPS):
        limit = (want - reached) / 4
        threshold, reached = _search(sums, lambda grid: uses.totals(grid, limit), want, 1.0)
        uses.topups.append((limit, threshold))
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("label") + 1)
    return members.mapInArrow(uses.chosen, schema).select("id", name.alias("source"), "tokens", "repeats", "rate", "p"), labels, fitted


def _expected_uses(labels: int):
    """Expected tokens by domain of whole uses, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(labels)
        for b in batches:
            p = np.frombuffer(b"".join(b.column("p").to_pylist()), np.float32).reshape(-1, labels).astype(np.float64)
            total += (b.column("tokens").to_numpy().astype(np.float64) * b.column("repeats").to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(labels)), pa.array(total)], names=["i", "x"])

    return run


def mixture_report(documents: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, total: int | None = None) -> DataFrame:
    """(source, target_share, actual_share, fitted_share, expected_share, tokens, documents, most_repeats) of each target.

    ``actual_share`` counts tokens under the label of each document; ``fitted_share`` is the expected share under the
    posteriors at the rates of the least squares, before they were rounded to whole uses; ``expected_share`` that of the
    uses themselves. What the last two are away from the target is the residual before and after rounding.
    """
    spark = documents.sparkSession
    mixture, labels, fitted = _mixture(documents, targets, ident, text, source, tokenizer, total)
    mixture = mixture.persist()
    shares = targets.select("source", "target_share").distinct()
    soft = np.zeros(len(labels))
    if labels:
        for i, x in mixture.mapInArrow(_expected_uses(len(labels)), "i long, x double").groupBy("i").agg(F.sum("x")).collect():
            soft[i] = x
    part = lambda x: (x / (x.sum() or 1.0)).tolist()
    known = spark.createDataFrame(list(zip(labels, part(fitted), part(soft))), "source string, fitted_share double, expected_share double")
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = used.agg(F.sum("tokens")).first()[0] or 1
    zero = lambda c: F.coalesce(c, F.lit(0))
    return shares.join(used, "source", "left").join(known, "source", "left").select(
        "source", "target_share", F.round(zero("tokens") / F.lit(whole), 6).alias("actual_share"), F.round(zero("fitted_share"), 6).alias("fitted_share"), F.round(zero("expected_share"), 6).alias("expected_share"),
        zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"),
    )
