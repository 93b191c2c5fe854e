"""An audit as one lazy plan: instances beside their source diffs, similarity columns, verdicts, evidence rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import diff, risk, text
from leakscope.operators.exposure import char_cosine, exposures
from leakscope.operators.skew import fragment_replicate_join


@dataclass(frozen=True)
class AuditConfig:
    """``mode`` is pr_diff (each instance has a source diff) or solution (no diff is expected).

    With ``reported_only`` statements and tests below the threshold count as not exposed.
    """

    mode: str = "pr_diff"
    threshold: float = 0.82
    cutoff: str = "2024-03-15"
    reported_only: bool = True

    def __post_init__(self) -> None:
        if not 0.1 <= self.threshold <= 1.0:
            raise ValueError("threshold must be between 0.1 and 1.0")
        if self.mode not in ("pr_diff", "solution"):
            raise ValueError(f"unknown mode {self.mode}")


def exposure_table(pairs: DataFrame) -> DataFrame:
    """Similarity of (id, patch, source): one row per id with all signals; null texts count as empty.

    Rows whose source holds the whole patch are settled at once. The others' changed lines, eight-token grams and three-character
    runs are counted row by row on packed arrays; the parts meet again by id.
    """
    p = pairs.select("id", F.coalesce("patch", F.lit("")).alias("q"), F.coalesce("source", F.lit("")).alias("s")).persist()
    whole = (F.col("q") != "") & F.contains("s", "q")
    exact, rest = p.where(whole), p.where(~whole)
    changed = exact.select("id", F.size(diff.changed_lines("q")).cast("long").alias("n"))
    done = changed.select(
        "id", F.lit(True).alias("verbatim_match"), F.lit(True).alias("normalized_match"), F.col("n").alias("exposed_changed_lines"), F.col("n").alias("total_changed_lines"),
        F.lit(1.0).alias("jaccard_similarity"), F.lit(1.0).alias("ngram_overlap_8"), F.lit(1.0).alias("embedding_similarity"),
    )
    long = lambda c: F.filter(diff.changed_lines(c), lambda s: F.length(s) >= 10)
    by_line = exposures(rest.select("id", long("q").alias("q"), long("s").alias("s"))).select("id", F.col("matched").alias("exposed_changed_lines"), F.col("total").alias("total_changed_lines"))
    by_gram = exposures(rest.select("id", text.tokens("q").alias("q"), text.tokens("s").alias("s")), 8)
    by_char = char_cosine(rest)
    norm = rest.select("id", ((text.collapse("q") != "") & F.contains(text.collapse("s"), text.collapse("q"))).alias("normalized_match"), text.jaccard(text.word_shingles("q"), text.word_shingles("s")).alias("jaccard_similarity"))
    part = (
        norm.join(by_line, "id").join(by_gram.select("id", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0).alias("ngram_overlap_8")), "id")
        .join(by_char.select("id", F.coalesce("cosine", F.lit(0.0)).alias("embedding_similarity")), "id")
        .withColumn("verbatim_match", F.lit(False))
    )
    return done.unionByName(part.select(done.columns))


def circular(patch: Column, source: Column) -> Column:
    """Whether a match proves nothing: the patch stands whole in a source that begins, within 20 lines, like a diff."""
    head = F.slice(text.lines(source), 1, 20)
    is_diff = F.exists(head, lambda s: s.startswith("diff --git") | s.startswith("---") | s.startswith("+++"))
    return F.coalesce((patch != "") & (source != "") & F.contains(source, patch) & is_diff, F.lit(False))


def _by_id(df: DataFrame | None, columns: dict[str, str], spark) -> DataFrame:
    """(instance_id, *columns) with the given types; without a table, no rows."""
    if df is None:
        return spark.createDataFrame([], ", ".join(["instance_id string", *(f"{c} {t}" for c, t in columns.items())]))
    return df.groupBy("instance_id").agg(*[F.max(F.col(c).cast(t)).alias(c) for c, t in columns.items()])


def audit(instances: DataFrame, source_diffs: DataFrame, members: DataFrame, config: AuditConfig = AuditConfig(), merge_dates: DataFrame | None = None, content: DataFrame | None = None, replication: DataFrame | None = None) -> DataFrame:
    """One row per instance: signals, each step of the verdict, the first kind of evidence, and whether it could be evaluated.

    ``source_diffs`` has (repo, pr_number, diff_text), ``members`` (repo), the repositories of a corpus, ``merge_dates`` (repo,
    pr_number, merged_at), ``content`` (instance_id, similarity, matches) from matches against an index, ``replication``
    (instance_id, independent_hits, non_vendor_hits, vendor_like_hits, matched_lines, total_lines) from verified copies elsewhere. The last three may be missing.

    An instance without a diff gets no exposures and in pr_diff mode counts as not evaluated; copies elsewhere still count
    for it. In solution mode its corpus and copies decide. No failure of one instance loses another. Repositories are
    very unequal, so the small sides meet the instances through a fragment-replicate join: no task holds a hot repository.
    """
    spark = instances.sparkSession
    i = instances.where("instance_id is not null and instance_id != ''").dropDuplicates(["instance_id"]).drop("merge_date")
    d = source_diffs.groupBy("repo", "pr_number").agg(F.max("diff_text").alias("source"))
    m = members.select("repo", F.lit(True).alias("member")).where("repo is not null").distinct()
    i = fragment_replicate_join(i, m, "repo", "left")
    if merge_dates is not None:
        i = i.join(merge_dates.groupBy("repo", "pr_number").agg(F.min("merged_at").alias("merge_date")), ["repo", "pr_number"], "left")
    else:
        i = i.withColumn("merge_date", F.lit(None).cast("string"))
    j = i.join(d, ["repo", "pr_number"], "left")
    j = j.join(_by_id(content, {"similarity": "double", "matches": "long"}, spark).withColumnsRenamed({"similarity": "codeseal_similarity", "matches": "codeseal_matches"}), "instance_id", "left")
    j = j.join(_by_id(replication, {c: "long" for c in ("independent_hits", "non_vendor_hits", "vendor_like_hits")}, spark), "instance_id", "left")
    x = exposure_table(j.where("source is not null").select(F.col("instance_id").alias("id"), "patch", "source")).withColumnRenamed("id", "instance_id")
    rate = risk.clamp(F.when(F.col("total_changed_lines") > 0, F.col("exposed_changed_lines") / F.col("total_changed_lines")))
    whole = lambda c: F.coalesce((F.col(c) != "") & F.contains("source", c), F.lit(False))
    near = lambda c: text.jaccard(text.word_shingles(c), text.word_shingles("source"))
    wide = j.join(x, "instance_id", "left").withColumn("missing", F.col("source").isNull())
    wide = wide.withColumn("patch_exposure", rate).withColumn("statement_verbatim", whole("problem_statement")).withColumn("test_verbatim", whole("test_patch"))
    for c, v in (("problem_statement", "statement_verbatim"), ("test_patch", "test_verbatim")):
        part = F.when(F.col(v), 1.0).otherwise(near(c))
        wide = wide.withColumn(f"{c}_exposure", risk.clamp(F.when(part >= config.threshold, part) if config.reported_only else part))
    out = risk.verdicts(wide.withColumn("repo_in_training_corpus", F.coalesce("member", F.lit(False))), config.cutoff, config.threshold)
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    return out.select(
        "instance_id", "repo", "patch_exposure", "problem_statement_exposure", "test_patch_exposure",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("verbatim_match", "normalized_match", "statement_verbatim", "test_verbatim")],
        *[zero(c, "double") for c in ("jaccard_similarity", "ngram_overlap_8", "embedding_similarity", "codeseal_similarity")],
        *[zero(c, "long") for c in ("codeseal_matches", "independent_hits", "non_vendor_hits", "vendor_like_hits")],
        "repo_in_training_corpus", "merge_date", circular(F.col("patch"), F.col("source")).alias("circular_match"), F.col("risk_1").alias("risk_before_cutoff"),
        *[f"risk_{k}" for k in range(1, 7)], F.col("risk_6").alias("risk"), "top_match", (F.col("missing") & F.lit(config.mode == "pr_diff")).alias("not_evaluated"),
    )


def evidence_rows(risks: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """(instance_id, match_type, similarity): each kind of evidence in a row of its own, never merged into one score."""
    p = F.col("patch_exposure")
    kind = risk.patch_match(F.col("verbatim_match"), F.col("normalized_match"), p, config.threshold)
    row = lambda c, m, s: F.when(c, F.struct(m.alias("match_type"), s.alias("similarity")))
    lit = F.lit
    text_kind = lambda v, name: F.when(F.col(v), f"{name}_verbatim").otherwise(f"{name}_near_duplicate")
    rows = F.array_compact(F.array(
        row(kind.isNotNull(), kind, p),
        row(F.col("problem_statement_exposure") >= config.threshold, text_kind("statement_verbatim", "problem_statement"), F.col("problem_statement_exposure")),
        row(F.col("test_patch_exposure") >= config.threshold, text_kind("test_verbatim", "test_patch"), F.col("test_patch_exposure")),
        row(F.col("codeseal_matches") > 0, lit("codeseal_content_hit"), F.col("codeseal_similarity")),
        row((F.col("embedding_similarity") >= 0.85) & (F.col("ngram_overlap_8") < 0.5), lit("embedding_similarity_hit"), F.col("embedding_similarity")),
        row(F.col("independent_hits") > 0, lit("independent_source_hit"), lit(1.0)),
        row(F.col("repo_in_training_corpus"), lit("repo_in_training_corpus"), lit(1.0)),
    ))
    return risks.select("instance_id", F.explode(rows).alias("e")).select("instance_id", "e.*")
