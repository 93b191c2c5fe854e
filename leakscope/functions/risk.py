"""Verdicts as Column expressions; every step is a column of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("clean", "low", "medium", "high", "critical")


def clamp(x: Column) -> Column:
    """Between 0 and 1; NaN counts as 1, null as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def severity(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def base_risk(patch: Column, statement: Column, test: Column, in_corpus: Column) -> Column:
    top = F.greatest(patch, statement, test)
    return (
        F.when((patch >= 0.95) & in_corpus, "critical").when(patch >= 0.95, "high").when((patch >= 0.80) & in_corpus, "high")
        .when(patch >= 0.80, "medium").when(top >= 0.5, "medium").when(top > 0, "low").otherwise("clean")
    )


def to_date(text: Column) -> Column:
    """The day in UTC of an ISO text, else null; other orders of day, month and year are not guessed.

    A time with a zone is moved to UTC, one without counts as UTC, and what follows a date otherwise is ignored.
    """
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    part = lambda i: F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?([+-])(\d{2}):?(\d{2})$", i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0))
    ahead = (number(4) * 60 + number(5)) * F.when(part(3) == "-", -1).otherwise(1)
    return F.date_add(day, F.floor((number(1) * 60 + number(2) - ahead) / F.lit(1440)).cast("int"))


def after_cutoff(risk: Column, merged: Column, cutoff: Column) -> Column:
    """One level less, but not below low, if the merge date is known and not before the cutoff."""
    late = F.coalesce(merged >= cutoff, F.lit(False))
    return F.when(late & (risk == "critical"), "high").when(late & (risk == "high"), "medium").when(late & (risk == "medium"), "low").otherwise(risk)


def with_content(risk: Column, similarity: Column) -> Column:
    strong = similarity >= 0.3
    return F.when((similarity > 0) & (risk == "clean"), F.when(strong, "medium").otherwise("low")).when(strong & (risk == "low"), "medium").otherwise(risk)


def with_paraphrase(risk: Column, cosine: Column, ngram: Column) -> Column:
    return F.when((cosine >= 0.85) & (ngram < 0.5) & risk.isin("clean", "low", "medium"), "high").otherwise(risk)


def with_independent(risk: Column, hits: Column, non_vendor: Column) -> Column:
    return F.when((hits > 0) & (non_vendor >= 3), "critical").when((hits > 0) & risk.isin("clean", "low", "medium"), "high").otherwise(risk)


def pro_risk(contaminated: Column, confidence: Column, exposure: Column) -> Column:
    """Verdict of the consensus mode: by the share of methods that agree and by the share of lines found."""
    return (
        F.when(~contaminated, "clean").when((confidence >= 0.75) | (exposure >= 0.5), "critical").when((confidence >= 0.5) | (exposure >= 0.2), "high").otherwise("medium")
    )


#: What speaks first in the verdict of an instance, if several kinds of evidence do.
MATCH_ORDER = ("patch", "problem_statement", "test_patch", "codeseal_content_hit", "embedding_similarity_hit", "independent_source_hit")


def patch_match(verbatim: Column, normalized: Column, rate: Column, threshold: float) -> Column:
    """The kind of match of a patch with its source: word for word, in normal form, nearly, or null."""
    return F.when(verbatim, "patch_verbatim").when(normalized | (rate >= 0.95), "patch_normalized").when(rate >= threshold, "patch_near_duplicate")


def verdicts(df: DataFrame, cutoff: str, threshold: float = 0.82) -> DataFrame:
    """Adds risk_1 to risk_6 and ``top_match`` to rows of signals; each step of the order is a column of its own.

    Base risk, cutoff, content, paraphrase, independent copies, cutoff again. A row whose source could not be had
    (``missing``) has no exposures and skips the first two steps and the last. ``top_match`` is the first kind of
    MATCH_ORDER that speaks. Expects patch_exposure, problem_statement_exposure, test_patch_exposure,
    repo_in_training_corpus, merge_date, codeseal_similarity, codeseal_matches, embedding_similarity, ngram_overlap_8,
    independent_hits, non_vendor_hits, verbatim_match, normalized_match, statement_verbatim, test_verbatim and missing;
    nulls count as zero or false.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    gone, edge = yes("missing"), F.lit(cutoff).cast("date")
    p, s, t = (F.when(gone, 0.0).otherwise(clamp(F.col(f"{c}_exposure"))) for c in ("patch", "problem_statement", "test_patch"))
    content = F.when(num("codeseal_matches") > 0, clamp(F.col("codeseal_similarity"))).otherwise(0.0)
    cosine, grams = F.when(gone, 0.0).otherwise(num("embedding_similarity")), num("ngram_overlap_8")
    day = to_date(F.col("merge_date"))
    df = df.withColumn("risk_1", F.when(gone, "clean").otherwise(base_risk(p, s, t, yes("repo_in_training_corpus"))))
    df = df.withColumn("risk_2", after_cutoff(F.col("risk_1"), day, edge))
    df = df.withColumn("risk_3", F.when(num("codeseal_matches") > 0, F.when(F.col("risk_2") == "clean", F.when(content >= 0.3, "medium").otherwise("low")).when((F.col("risk_2") == "low") & (content >= 0.3), "medium").otherwise(F.col("risk_2"))).otherwise(F.col("risk_2")))
    df = df.withColumn("risk_4", with_paraphrase(F.col("risk_3"), cosine, grams))
    df = df.withColumn("risk_5", with_independent(F.col("risk_4"), num("independent_hits"), num("non_vendor_hits")))
    df = df.withColumn("risk_6", F.when(~gone & (num("independent_hits") > 0) & F.coalesce(day >= edge, F.lit(False)) & (F.col("risk_5") == "critical"), "high").otherwise(F.col("risk_5")))
    text = lambda c, name: F.when(yes(f"{c}_verbatim"), f"{name}_verbatim").when(num(f"{name}_exposure") >= threshold, f"{name}_near_duplicate")
    top = F.coalesce(
        F.when(~gone, F.coalesce(patch_match(yes("verbatim_match"), yes("normalized_match"), p, threshold), text("statement", "problem_statement"), text("test", "test_patch"))),
        F.when(num("codeseal_matches") > 0, "codeseal_content_hit"), F.when((cosine >= 0.85) & (grams < 0.5), "embedding_similarity_hit"), F.when(num("independent_hits") > 0, "independent_source_hit"),
    )
    return df.withColumn("top_match", top)
