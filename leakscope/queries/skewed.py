"""Queries over keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.repos import canonical_repo
from leakscope.operators.skew import balanced_aggregate, fragment_replicate_join, plan_shards
from leakscope.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "instances").select("instance_id", canonical_repo("repo").alias("repo")).where("instance_id is not null")
    counts = balanced_aggregate(rows, "repo", {"p": F.countDistinct("instance_id")}, {"n": F.sum("p")}, salt=["instance_id"]).persist()
    total = rows.select(F.count_distinct("instance_id")).first()[0]
    return counts.where(F.col("n") * 20 > total).select("repo")


def p2_repo_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: verdicts, exposures and the default branch, the branch being joined to the rows of the hot keys."""
    risk = table(spark, sf_dir, "instance_risk").select("instance_id", canonical_repo("repo").alias("repo"), "risk", "patch_exposure", "evidence_count")
    repos = table(spark, sf_dir, "repos").select(canonical_repo("repo").alias("repo"), "default_branch").groupBy("repo").agg(F.min("default_branch").alias("default_branch"))
    plan = plan_shards(risk, "repo")
    joined = fragment_replicate_join(risk, repos, "repo", "left", plan, ["instance_id"])
    return balanced_aggregate(
        joined, "repo",
        {"i": F.count("*"), "f": F.count_if(F.col("risk") != "clean"), "e": F.sum("evidence_count"), "x": F.sum(F.col("patch_exposure").cast("decimal(20,6)")), "b": F.min(F.coalesce("default_branch", F.lit("main")))},
        {"instances": F.sum("i").cast("long"), "flagged": F.sum("f").cast("long"), "evidence_rows": F.sum("e").cast("long"), "exposure_sum": F.sum("x").cast("double"), "default_branch": F.min("b")},
        plan, ["instance_id"],
    )


_REPO = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(repo), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '^[a-z][a-z0-9+.-]*://[^/]*/', ''), '/+$', ''), '\.git$', '')"

QUERIES = {"p2_found": p2_found, "p2_repo_risk": p2_repo_risk}
SQL = {
    "p2_found": f"WITH r AS (SELECT DISTINCT instance_id, {_REPO} AS repo FROM instances) SELECT repo FROM r GROUP BY repo HAVING count(DISTINCT instance_id) * 20 > (SELECT count(DISTINCT instance_id) FROM instances)",
    "p2_repo_risk": f"WITH b AS (SELECT {_REPO} AS repo, min(default_branch) AS default_branch FROM repos GROUP BY 1), r AS (SELECT {_REPO} AS repo, risk, evidence_count, patch_exposure FROM instance_risk) SELECT repo, count(*)::BIGINT AS instances, count(*) FILTER (risk <> 'clean')::BIGINT AS flagged, sum(evidence_count)::BIGINT AS evidence_rows, sum(patch_exposure::DECIMAL(20,6))::DOUBLE AS exposure_sum, min(coalesce(default_branch, 'main')) AS default_branch FROM r LEFT JOIN b USING (repo) GROUP BY repo",
}
