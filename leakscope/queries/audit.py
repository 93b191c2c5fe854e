"""Verdicts, summaries, rankings, sampling, identity of instances, links and replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope.functions import diff, links, risk, text
from leakscope.functions.repos import canonical_repo
from leakscope.operators.sampling import round_robin_sample
from leakscope.functions import cutoffs
from leakscope.operators.substring import substring_join
from leakscope.operators.search import candidate_files, search_identifiers
from leakscope.plans.consensus import squeezed
from leakscope.queries.sqltext import REPO, lines_sql, strip_sql
from leakscope.queries.texts import instances
from leakscope.session import spread, table

CUTOFF = "2024-03-15"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "instance_risk")


def evidence(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Evidence without re-delivered rows."""
    return table(spark, sf_dir, "evidence").select("evidence_id", *cols).where("evidence_id is not null").dropDuplicates(["evidence_id"])


_CLAMP = lambda c: f"greatest(0, least(1, coalesce({c}, 0)))"
_BASE = "CASE WHEN p >= 0.95 AND c THEN 'critical' WHEN p >= 0.95 THEN 'high' WHEN p >= 0.8 AND c THEN 'high' WHEN p >= 0.8 THEN 'medium' WHEN greatest(p, s, t) >= 0.5 THEN 'medium' WHEN greatest(p, s, t) > 0 THEN 'low' ELSE 'clean' END"


def day_sql(c: str) -> str:
    part = lambda i: f"coalesce(try_cast(nullif(regexp_extract({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ](\\d{{2}}):(\\d{{2}})(?::\\d{{2}}(?:\\.\\d+)?)?([+-])(\\d{{2}}):?(\\d{{2}})$', {i}), '') AS INT), 0)"
    sign = f"CASE WHEN regexp_matches({c}, '-\\d{{2}}:?\\d{{2}}$') AND regexp_matches({c}, '[T ]\\d{{2}}:') THEN -1 ELSE 1 END"
    return f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substring({c}, 1, 10) AS DATE) + floor(({part(1)} * 60 + {part(2)} - ({part(4)} * 60 + {part(5)}) * ({sign})) / 1440.0)::INT END"


_DAY = day_sql("merge_date")
_R = f"x AS (SELECT *, {_CLAMP('patch_exposure')} AS p, {_CLAMP('problem_statement_exposure')} AS s, {_CLAMP('test_patch_exposure')} AS t, repo_in_training_corpus AS c, {_DAY} AS day FROM instance_risk), r1 AS (SELECT *, {_BASE} AS risk_1 FROM x)"
_R2 = "r2 AS (SELECT *, CASE WHEN coalesce(day >= DATE '2024-03-15', false) AND risk_1 IN ('critical', 'high', 'medium') THEN CASE risk_1 WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE risk_1 END AS risk_2 FROM r1), r3 AS (SELECT *, CASE WHEN codeseal_similarity > 0 AND risk_2 = 'clean' THEN CASE WHEN codeseal_similarity >= 0.3 THEN 'medium' ELSE 'low' END WHEN codeseal_similarity >= 0.3 AND risk_2 = 'low' THEN 'medium' ELSE risk_2 END AS risk_3 FROM r2), r4 AS (SELECT *, CASE WHEN embedding_similarity >= 0.85 AND ngram_overlap_8 < 0.5 AND risk_3 IN ('clean', 'low', 'medium') THEN 'high' ELSE risk_3 END AS risk_4 FROM r3), r5 AS (SELECT *, CASE WHEN independent_hits > 0 AND non_vendor_hits >= 3 THEN 'critical' WHEN independent_hits > 0 AND risk_4 IN ('clean', 'low', 'medium') THEN 'high' ELSE risk_4 END AS risk_5 FROM r4)"


def _scored(spark, sf_dir) -> DataFrame:
    x = risks(spark, sf_dir)
    one = x.withColumn("risk_1", risk.base_risk(*[risk.clamp(F.col(f"{c}_exposure")) for c in ("patch", "problem_statement", "test_patch")], F.col("repo_in_training_corpus")))
    late = F.coalesce(risk.to_date(F.col("merge_date")) >= F.lit(CUTOFF).cast("date"), F.lit(False))
    two = one.withColumn("risk_2", risk.after_cutoff(F.col("risk_1"), risk.to_date(F.col("merge_date")), F.lit(CUTOFF).cast("date")))
    three = two.withColumn("risk_3", risk.with_content(F.col("risk_2"), F.col("codeseal_similarity")))
    four = three.withColumn("risk_4", risk.with_paraphrase(F.col("risk_3"), F.col("embedding_similarity"), F.col("ngram_overlap_8")))
    five = four.withColumn("risk_5", risk.with_independent(F.col("risk_4"), F.col("independent_hits"), F.col("non_vendor_hits")))
    return five.withColumn("risk_6", F.when(late & (F.col("risk_5") == "critical"), "high").otherwise(F.col("risk_5")))


@query(f"WITH {_R}, {_R2} SELECT instance_id, risk_1, risk_2, risk_3, risk_4, risk_5, CASE WHEN coalesce(day >= DATE '2024-03-15', false) AND risk_5 = 'critical' THEN 'high' ELSE risk_5 END AS risk_6 FROM r5")
def risk_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("instance_id", *[f"risk_{i}" for i in range(1, 7)])


_NE = "(not_evaluated OR (snippet = '(PR diff not available)' AND patch_exposure = 0))"


@query(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (patch_exposure > 0)::BIGINT AS patch_exposed, count(*) FILTER (problem_statement_exposure > 0)::BIGINT AS statement_exposed, count(*) FILTER (test_patch_exposure > 0)::BIGINT AS tests_exposed, count(*) FILTER (repo_in_training_corpus)::BIGINT AS in_corpus, count(*) FILTER ({_NE})::BIGINT AS not_evaluated, " + ", ".join(f"count(*) FILTER (risk = '{x}')::BIGINT AS n_{x}" for x in risk.LEVELS) + ", round(count(*) FILTER (risk <> 'clean') / count(*), 6) AS contamination_rate FROM instance_risk")
def audit_summary(spark, sf_dir):
    n = lambda c, a: F.count_if(c).alias(a)
    skipped = F.col("not_evaluated") | ((F.col("snippet") == "(PR diff not available)") & (F.col("patch_exposure") == 0))
    return risks(spark, sf_dir).agg(
        F.count("*").alias("total"), n(F.col("patch_exposure") > 0, "patch_exposed"), n(F.col("problem_statement_exposure") > 0, "statement_exposed"),
        n(F.col("test_patch_exposure") > 0, "tests_exposed"), n(F.col("repo_in_training_corpus"), "in_corpus"), n(skipped, "not_evaluated"),
        *[n(F.col("risk") == x, f"n_{x}") for x in risk.LEVELS], F.round(F.count_if(F.col("risk") != "clean") / F.count("*"), 6).alias("contamination_rate"),
    )


@query("SELECT risk, count(*)::BIGINT AS n FROM instance_risk GROUP BY risk")
def verdict_histogram(spark, sf_dir):
    return risks(spark, sf_dir).groupBy("risk").agg(F.count("*").alias("n"))


_SRC = "(patch_exposure > 0 OR problem_statement_exposure > 0 OR test_patch_exposure > 0)"
_COR = "(repo_in_training_corpus OR codeseal_matches > 0)"


@query(f"SELECT {REPO} AS repo, count(*)::BIGINT AS total, count(*) FILTER {_SRC}::BIGINT AS source, count(*) FILTER (independent_hits > 0 OR {_COR})::BIGINT AS signal, count(*) FILTER (independent_hits > 0)::BIGINT AS independent, count(*) FILTER {_COR}::BIGINT AS corpus, count(*) FILTER (risk <> 'clean')::BIGINT AS risk_flagged, round_even(100.0 * count(*) FILTER (independent_hits > 0 OR {_COR}) / count(*), 0)::BIGINT AS rate FROM instance_risk GROUP BY 1")
def per_repo_signals(spark, sf_dir):
    src = F.expr(_SRC)
    cor, ind = F.expr(_COR), F.col("independent_hits") > 0
    return risks(spark, sf_dir).groupBy(canonical_repo("repo").alias("repo")).agg(
        F.count("*").alias("total"), F.count_if(src).alias("source"), F.count_if(ind | cor).alias("signal"), F.count_if(ind).alias("independent"),
        F.count_if(cor).alias("corpus"), F.count_if(F.col("risk") != "clean").alias("risk_flagged"), F.bround(F.lit(100.0) * F.count_if(ind | cor) / F.count("*"), 0).cast("long").alias("rate"),
    ).orderBy(F.desc(F.col("signal") / F.col("total")), F.desc(F.col("source") / F.col("total")), "repo")


_BINS = ["1-5", "6-10", "11-15", "16-20", "21-25", "26-30", "31+"]


@query("WITH b AS (SELECT unnest(['" + "', '".join(_BINS) + "']) AS bin, unnest(range(0, 7)) AS k), c AS (SELECT least((independent_hits - 1) // 5, 6) AS k, count(*) AS n FROM instance_risk WHERE independent_hits > 0 GROUP BY 1), j AS (SELECT bin, coalesce(n, 0)::BIGINT AS n FROM b LEFT JOIN c USING (k)) SELECT bin, n, coalesce(round_even(100.0 * n / nullif(max(n) OVER (), 0), 0), 0)::BIGINT AS pct FROM j")
def hit_histogram(spark, sf_dir):
    """Instances by number of independent hits, in seven bins; the window runs over the seven rows only."""
    k = F.least(F.floor((F.col("independent_hits") - 1) / 5), F.lit(6)).cast("int")
    counts = risks(spark, sf_dir).where("independent_hits > 0").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    bins = spark.createDataFrame(list(enumerate(_BINS)), "k int, bin string")
    both = bins.join(counts, "k", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.lit(1)))
    return both.withColumn("pct", F.coalesce(F.bround(F.lit(100.0) * F.col("n") / F.nullif(top, F.lit(0)), 0), F.lit(0)).cast("long"))


@query(f"WITH c AS (SELECT {REPO} AS repo, count(*)::BIGINT AS n FROM instance_risk WHERE independent_hits > 0 GROUP BY 1), t AS (SELECT count(*) AS repos, sum(n) AS hits FROM c) SELECT repo, n, round(n / hits, 6) AS share FROM c, t WHERE repos >= 2 ORDER BY n DESC, repo LIMIT 1")
def repo_concentration(spark, sf_dir):
    c = risks(spark, sf_dir).where("independent_hits > 0").groupBy(canonical_repo("repo").alias("repo")).agg(F.count("*").alias("n"))
    t = c.agg(F.count("*").alias("repos"), F.sum("n").alias("hits")).first()
    return c.where(F.lit(t.repos >= 2)).withColumn("share", F.round(F.col("n") / F.lit(t.hits), 6)).orderBy(F.desc("n"), "repo").limit(1)


@query("SELECT count(*) FILTER (codeseal_matches > 0)::BIGINT AS content, count(*) FILTER (repo_in_training_corpus)::BIGINT AS members, count(DISTINCT CASE WHEN repo_in_training_corpus THEN " + REPO + f" END)::BIGINT AS member_repos, count(*) FILTER (independent_hits > 0 AND {_DAY} < DATE '2024-03-15')::BIGINT AS early_independent, count(*) FILTER (independent_hits > 0)::BIGINT AS independent, round(avg(independent_hits) FILTER (independent_hits > 0), 6) AS mean_hits, max(independent_hits)::BIGINT AS most_hits FROM instance_risk")
def corpus_signals(spark, sf_dir):
    day, ind = risk.to_date(F.col("merge_date")), F.col("independent_hits") > 0
    return risks(spark, sf_dir).agg(
        F.count_if(F.col("codeseal_matches") > 0).alias("content"), F.count_if("repo_in_training_corpus").alias("members"),
        F.count_distinct(F.when(F.col("repo_in_training_corpus"), canonical_repo("repo"))).alias("member_repos"),
        F.count_if(ind & (day < F.lit(CUTOFF).cast("date"))).alias("early_independent"), F.count_if(ind).alias("independent"),
        F.round(F.avg(F.when(ind, F.col("independent_hits"))), 6).alias("mean_hits"), F.max("independent_hits").cast("long").alias("most_hits"),
    )


_E = "e AS (SELECT DISTINCT ON (evidence_id) * FROM evidence)"


@query(f"WITH {_E} SELECT match_type, source_kind, count(*)::BIGINT AS n, count(DISTINCT instance_id)::BIGINT AS instances, sum(matched_lines)::BIGINT AS matched_lines, sum(total_lines)::BIGINT AS total_lines FROM e GROUP BY ALL")
def evidence_kind_counts(spark, sf_dir):
    e = evidence(spark, sf_dir, "match_type", "source_kind", "instance_id", "matched_lines", "total_lines")
    return e.groupBy("match_type", "source_kind").agg(F.count("*").alias("n"), F.count_distinct("instance_id").alias("instances"), F.sum("matched_lines").alias("matched_lines"), F.sum("total_lines").alias("total_lines"))


@query(f"WITH {_E} SELECT instance_id, count(*)::BIGINT AS n, max(similarity) AS best, arg_max(evidence_id, (similarity, -evidence_id)) AS best_id FROM e GROUP BY instance_id")
def evidence_by_instance(spark, sf_dir):
    e = evidence(spark, sf_dir, "instance_id", "similarity")
    return e.groupBy("instance_id").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), F.max_by("evidence_id", F.struct("similarity", -F.col("evidence_id"))).alias("best_id"))


_SEV = "list_position(['clean', 'low', 'medium', 'high', 'critical'], risk) - 1"


@query(f"SELECT instance_id, risk, patch_exposure FROM instance_risk ORDER BY {_SEV} DESC, patch_exposure DESC, instance_id LIMIT 20")
def top_contaminated(spark, sf_dir):
    return risks(spark, sf_dir).orderBy(F.desc(risk.severity(F.col("risk"))), F.desc("patch_exposure"), "instance_id").limit(20).select("instance_id", "risk", "patch_exposure")


@query("SELECT instance_id, patch_exposure FROM instance_risk ORDER BY patch_exposure DESC, instance_id LIMIT 20")
def top_pro(spark, sf_dir):
    return risks(spark, sf_dir).orderBy(F.desc("patch_exposure"), "instance_id").limit(20).select("instance_id", "patch_exposure")


@query(f"SELECT instance_id, independent_hits, codeseal_matches, risk FROM instance_risk ORDER BY independent_hits DESC, codeseal_matches DESC, repo_in_training_corpus::INT DESC, {_SEV} DESC, instance_id LIMIT 10")
def deep_dive_top10(spark, sf_dir):
    keys = [F.desc("independent_hits"), F.desc("codeseal_matches"), F.desc(F.col("repo_in_training_corpus").cast("int")), F.desc(risk.severity(F.col("risk"))), "instance_id"]
    return risks(spark, sf_dir).orderBy(*keys).limit(10).select("instance_id", "independent_hits", "codeseal_matches", "risk")


@query(f"WITH {_E}, k AS (SELECT instance_id, evidence_id, similarity, row_number() OVER (PARTITION BY instance_id ORDER BY similarity DESC, evidence_id) AS rank FROM e) SELECT instance_id, evidence_id, similarity, rank::INT AS rank FROM k WHERE rank <= 10")
def top_matches(spark, sf_dir):
    w = Window.partitionBy("instance_id").orderBy(F.desc("similarity"), "evidence_id")
    return evidence(spark, sf_dir, "instance_id", "similarity").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("instance_id", "evidence_id", "similarity", "rank")


@query(f"WITH i AS (SELECT instance_id, min({REPO}) AS grp FROM instances GROUP BY 1), r AS (SELECT instance_id, grp, row_number() OVER (PARTITION BY grp ORDER BY instance_id) AS round, min(instance_id) OVER (PARTITION BY grp) AS first FROM i) SELECT instance_id, grp, round::INT AS round FROM r ORDER BY round, first LIMIT 200")
def stratified_sample(spark, sf_dir):
    i = instances(spark, sf_dir, canonical_repo("repo").alias("grp"))
    return round_robin_sample(i, "grp", "instance_id", 200)


@query("SELECT coalesce(source_kind, '') AS source_kind, coalesce(vendor_like, false)::INT AS vendor, count(*)::BIGINT AS n FROM evidence GROUP BY ALL UNION ALL SELECT 'risk', circular_match::INT, count(*)::BIGINT FROM instance_risk GROUP BY ALL")
def union_shards(spark, sf_dir):
    """Rows of several tables under one schema, missing columns filled."""
    e = table(spark, sf_dir, "evidence").select(F.coalesce("source_kind", F.lit("")).alias("source_kind"), F.coalesce("vendor_like", F.lit(False)).cast("int").alias("vendor")).groupBy("source_kind", "vendor").agg(F.count("*").alias("n"))
    r = risks(spark, sf_dir).groupBy(F.col("circular_match").cast("int").alias("vendor")).agg(F.count("*").alias("n"))
    return e.unionByName(r, allowMissingColumns=True).fillna("risk", ["source_kind"])


@query("SELECT count(*)::BIGINT AS deliveries, count(DISTINCT instance_id)::BIGINT AS instances, (count(*) - count(DISTINCT instance_id))::BIGINT AS repeated, count(DISTINCT " + REPO + ")::BIGINT AS repos FROM instances")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "instances").agg(
        F.count("*").alias("deliveries"), F.count_distinct("instance_id").alias("instances"), (F.count("*") - F.count_distinct("instance_id")).alias("repeated"), F.count_distinct(canonical_repo("repo")).alias("repos")
    )


_CLEAN = lambda c: f"coalesce(CASE WHEN lower(trim({c})) IN ('nan', 'none', 'null') THEN '' ELSE {c} END, '')"


@query(f"WITH i AS (SELECT DISTINCT instance_id, repo, base_commit, patch, test_patch, problem_statement, created_at, pr_number, pr_url FROM instances) SELECT instance_id, coalesce(nullif({REPO}, ''), 'unknown/repo') AS repo, length({_CLEAN('patch')})::BIGINT AS patch_chars, length({_CLEAN('test_patch')})::BIGINT AS test_chars, length({_CLEAN('problem_statement')})::BIGINT AS statement_chars, CASE WHEN {REPO} = 'unknown/repo' THEN 'solution' ELSE 'pr_diff' END AS audit_type FROM i")
def schema_normalize(spark, sf_dir):
    from leakscope.sources.instances import blank_null_text, normalise

    i = normalise(table(spark, sf_dir, "instances")).dropDuplicates(["instance_id"])
    n = lambda c: F.length(blank_null_text(F.col(c))).cast("long")
    kind = F.when(F.col("repo") == "unknown/repo", "solution").otherwise("pr_diff")
    return i.select("instance_id", "repo", n("patch").alias("patch_chars"), n("test_patch").alias("test_chars"), n("problem_statement").alias("statement_chars"), kind.alias("audit_type"))


_IDP = "regexp_extract(instance_id, '^([^_]+)__([^/]+)-(\\d+)$', {})"


@query(f"WITH i AS (SELECT DISTINCT instance_id, {REPO} AS repo, pr_number, pr_url FROM instances) SELECT instance_id, coalesce(try_cast(regexp_extract(pr_url, '/pull/(\\d+)', 1) AS INT), pr_number, CASE WHEN lower({_IDP.format(1)} || '/' || {_IDP.format(2)}) = repo THEN try_cast({_IDP.format(3)} AS INT) END, 0) AS pr FROM i")
def pr_identity(spark, sf_dir):
    """The number of the pull request: from the link, the column, or the id if that encodes the repository."""
    from leakscope.sources.instances import pr_number

    i = instances(spark, sf_dir, canonical_repo("repo").alias("repo"), "pr_number", "pr_url")
    return i.select("instance_id", F.coalesce(pr_number(), F.lit(0)).alias("pr"))


@query("WITH i AS (SELECT DISTINCT instance_id, " + REPO + " AS repo, pr_number FROM instances), m AS (SELECT " + REPO + " AS repo, pr_number, min(merged_at) AS merged_at FROM pr_meta GROUP BY ALL) SELECT instance_id, merged_at FROM i LEFT JOIN m USING (repo, pr_number)")
def merge_dates(spark, sf_dir):
    m = table(spark, sf_dir, "pr_meta").groupBy(canonical_repo("repo").alias("repo"), "pr_number").agg(F.min("merged_at").alias("merged_at"))
    return instances(spark, sf_dir, canonical_repo("repo").alias("repo"), "pr_number").join(m, ["repo", "pr_number"], "left").select("instance_id", "merged_at")


@query(f"WITH d AS (SELECT independent_hits > 0 AS ind, risk <> 'clean' AS bad, {_DAY} AS day FROM instance_risk) SELECT count(*) FILTER (day < DATE '{CUTOFF}')::BIGINT AS before, count(*) FILTER (day >= DATE '{CUTOFF}')::BIGINT AS after, count(*) FILTER (day IS NULL)::BIGINT AS unknown, count(*) FILTER (bad AND day < DATE '{CUTOFF}')::BIGINT AS bad_before, count(*) FILTER (bad AND day >= DATE '{CUTOFF}')::BIGINT AS bad_after, count(*) FILTER (ind AND day < DATE '{CUTOFF}')::BIGINT AS independent_before, count(*) FILTER (ind AND day >= DATE '{CUTOFF}')::BIGINT AS independent_after FROM d")
def temporal_counts(spark, sf_dir):
    day, cut = risk.to_date(F.col("merge_date")), F.lit(CUTOFF).cast("date")
    bad, ind = F.col("risk") != "clean", F.col("independent_hits") > 0
    n = lambda c, a: F.count_if(c).alias(a)
    return risks(spark, sf_dir).agg(n(day < cut, "before"), n(day >= cut, "after"), n(day.isNull(), "unknown"), n(bad & (day < cut), "bad_before"), n(bad & (day >= cut), "bad_after"), n(ind & (day < cut), "independent_before"), n(ind & (day >= cut), "independent_after"))


@query("WITH d AS (SELECT DISTINCT instance_id, " + REPO + " AS repo, " + day_sql("created_at") + " AS day FROM instances) SELECT min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) FILTER (day < DATE '2023-07-01')::BIGINT AS before_v1, count(*) FILTER (day < DATE '2024-03-15')::BIGINT AS before_v2, bool_and(repo IN (SELECT " + REPO + " FROM repos))::INT AS all_listed, count(*) FILTER (repo NOT IN (SELECT " + REPO + " FROM repos))::BIGINT AS unlisted FROM d")
def provenance_facts(spark, sf_dir):
    day = risk.to_date(F.col("created_at"))
    known = table(spark, sf_dir, "repos").select(canonical_repo("repo").alias("repo"), F.lit(True).alias("known")).distinct()
    i = instances(spark, sf_dir, canonical_repo("repo").alias("repo"), day.alias("day")).join(known, "repo", "left")
    listed = F.coalesce("known", F.lit(False))
    return i.agg(
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count_if(F.col("day") < F.lit("2023-07-01").cast("date")).alias("before_v1"),
        F.count_if(F.col("day") < F.lit(CUTOFF).cast("date")).alias("before_v2"), F.bool_and(listed).cast("int").alias("all_listed"), F.count_if(~listed).alias("unlisted"),
    )


_URL = "trim(coalesce(source_url, ''))"
_HOST = f"regexp_extract({_URL}, '^https://([^/?#]+)/+[^/?#]', 1)"
_OWN = f"regexp_extract({_URL}, '^https://[^/?#]+/+([^/?#]+)', 1)"
_NAM = f"regexp_extract({_URL}, '^https://[^/?#]+/+[^/?#]+/+([^/?#]+)', 1)"
_OWNERS = ", ".join(f"'{o}'" for o in links.PLACEHOLDER_OWNERS)


@query(f"WITH {_E}, u AS (SELECT evidence_id, {_URL} AS url, lower({_HOST}) AS host, lower({_OWN}) AS own, '/' || {_OWN} || '/' || {_NAM} || '/' AS path, lower(coalesce(source_kind, '')) AS k, lower(coalesce(verification_status, '')) AS v FROM e) SELECT evidence_id, CASE WHEN url = '' THEN 'missing_url' WHEN host <> 'forge.example' THEN 'foreign_host' WHEN own IN ({_OWNERS}) OR regexp_matches(path, '{links.PLACEHOLDER}') THEN 'placeholder' WHEN NOT (contains(k, 'code_search') OR contains(k, 'issue_search') OR contains(k, 'source_pr') OR contains(v, 'exact') OR contains(v, 'issue')) THEN 'not_evidence' ELSE 'eligible' END AS status FROM u")
def evidence_link_gate(spark, sf_dir):
    e = evidence(spark, sf_dir, "source_url", "source_kind", "verification_status")
    return e.select("evidence_id", links.gate(F.col("source_url"), F.col("source_kind"), F.col("verification_status"), "forge.example").alias("status"))


_MARK = ", ".join(f"'{m}'" for m in links.VENDOR_MARKERS)


@query(f"SELECT doc_id, (len(list_intersect(string_split(lower(replace(path, '\\', '/')), '/'), [{_MARK}])) > 0 OR list_contains(string_split(lower(replace(path, '\\', '/')), '/'), split_part({REPO}, '/', -1)))::INT AS vendor_like FROM documents WHERE path IS NOT NULL AND repo IS NOT NULL")
def vendor_like(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("path is not null and repo is not null")
    return d.select("doc_id", links.vendor_like(F.col("path"), canonical_repo("repo")).cast("int").alias("vendor_like"))


from leakscope.operators.search import BLOCKED  # noqa: E402
from leakscope.queries.texts import _FORM  # noqa: E402

_IDENT = "'^[a-z_][\\p{L}\\p{N}_]{%s}$'"
_SCORE = f"CASE WHEN regexp_matches(w, {_IDENT % '4,'}) THEN length(w) WHEN regexp_matches(w, {_IDENT % '1,'}) THEN 2 ELSE 0 END"
_PLAIN = f"regexp_matches(w, {_IDENT % '3,'})"
_DIST = "(w NOT IN (" + ", ".join(f"'{b}'" for b in dict.fromkeys(BLOCKED)) + ") AND (contains(w, '_') OR regexp_matches(w, '[0-9]') OR length(w) >= 12))"


def _best(value: str) -> str:
    sums = f"list_transform(range(1, len(t) - 6), lambda i: list_sum(list_transform(t[i:i + 7], lambda w: {value})))"
    return f"list_filter(t[list_position({sums}, list_max({sums})):list_position({sums}, list_max({sums})) + 7], lambda w: {_PLAIN})"


_IDS = f"i AS (SELECT DISTINCT instance_id, {REPO} AS repo, patch FROM instances WHERE patch IS NOT NULL), k AS (SELECT instance_id, repo, regexp_extract_all({_FORM}, '{text.TOKEN}') AS t FROM i), b AS (SELECT instance_id, repo, {_best(_SCORE)} AS one, {_best('(' + _PLAIN + ')::INT')} AS two FROM k WHERE len(t) >= 8), s AS (SELECT instance_id, repo, list_filter(CASE WHEN len(one) >= 2 THEN one ELSE two END, lambda w: {_DIST}) AS ids FROM b), q AS (SELECT instance_id, repo, ids[1:5] AS ids FROM s WHERE len(ids) >= 2)"


@query(f"WITH {_IDS}, n AS (SELECT instance_id, repo, len(list_distinct(ids)) AS need, unnest(list_distinct(ids)) AS w FROM q), d AS (SELECT doc_id, {REPO} AS file_repo, unnest(list_distinct(regexp_extract_all(lower(text), '{text.WORD}'))) AS w FROM documents WHERE text IS NOT NULL AND kind IN ('source_file', 'diff')) SELECT instance_id, doc_id FROM n JOIN d USING (w) WHERE coalesce(file_repo <> repo, true) GROUP BY instance_id, doc_id, need HAVING count(*) = need")
def candidate_hits(spark, sf_dir):
    """Source files of other repositories that hold all identifiers a patch is searched by."""
    return _candidates(spark, sf_dir).select("instance_id", "doc_id")


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and kind in ('source_file', 'diff')")
    return spread(d.select("doc_id", canonical_repo("repo").alias("file_repo"), "path", "text"))


def _searched(spark, sf_dir):
    return instances(spark, sf_dir, canonical_repo("repo").alias("repo"), "patch").where("patch is not null")


def _candidates(spark, sf_dir):
    return candidate_files(_searched(spark, sf_dir), _files(spark, sf_dir))


@query(f"WITH {_IDS} SELECT instance_id, array_to_string(ids, ' ') AS query FROM q")
def search_queries(spark, sf_dir):
    return search_identifiers(_searched(spark, sf_dir)).select("instance_id", F.array_join("ids", " ").alias("query"))


_CH = lambda c: f"list_filter(list_transform(list_filter({lines_sql(c)}, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: {strip_sql('substring(x, 2)')}), lambda x: NOT regexp_matches(x, '{diff.BOILERPLATE}') AND NOT regexp_matches(x, '{diff.SIGNATURE}'))"
_NORM2 = lambda x: f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^\ufeff', ''), '#.*$', ''), '//.*$', ''), '[{text.WS}]+', '', 'g'))"


def _head_sql(field: str, norm: str) -> str:
    return f"WITH i AS (SELECT DISTINCT instance_id, {REPO} AS repo, {field}, {day_sql('created_at')} AS day FROM instances), a AS (SELECT instance_id, repo, day, unnest(list_filter(list_transform({_CH(field)}, lambda x: {norm}), lambda x: x <> '')) AS line FROM i), h AS (SELECT repo, line, min(crawled_at)::DATE AS seen FROM (SELECT {REPO} AS repo, crawled_at, unnest(list_transform({lines_sql('text')}, lambda x: {norm.replace('x,', strip_sql('x') + ',', 1) if norm != 'x' else strip_sql('x')})) AS line FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL) GROUP BY ALL) SELECT instance_id, count(*)::BIGINT AS lines, count(h.line)::BIGINT AS in_head, count(h.line) FILTER (NOT coalesce(seen < day, false))::BIGINT AS head_only FROM a LEFT JOIN h USING (repo, line) GROUP BY instance_id"


def _head_minus_base(spark, sf_dir, field: str, norm) -> DataFrame:
    """Added lines that files of the repository hold now, and of these those that none held before the instance's day.

    Files are reduced to the first day of each (repository, line) before they meet the patches, in one equi-join.
    """
    added = instances(spark, sf_dir, canonical_repo("repo").alias("repo"), field, risk.to_date(F.col("created_at")).alias("day"))
    a = added.select("instance_id", "repo", "day", F.explode(diff.added_lines(field)).alias("l")).select("instance_id", "repo", "day", norm(F.col("l")).alias("line")).where("line != ''")
    d = spread(table(spark, sf_dir, "documents").where("text is not null and repo is not null").select(canonical_repo("repo").alias("repo"), "crawled_at", "text"))
    h = d.select("repo", "crawled_at", F.explode(text.lines("text")).alias("l")).groupBy("repo", norm(text.strip("l")).alias("line")).agg(F.min("crawled_at").cast("date").alias("seen"), F.lit(1).alias("hit"))
    return a.join(h, ["repo", "line"], "left").groupBy("instance_id").agg(
        F.count("*").alias("lines"), F.count("hit").alias("in_head"), F.count_if(F.col("hit").isNotNull() & ~F.coalesce(F.col("seen") < F.col("day"), F.lit(False))).alias("head_only")
    )


@query(_head_sql("patch", "x"))
def head_minus_base_m1(spark, sf_dir):
    return _head_minus_base(spark, sf_dir, "patch", lambda x: x)


@query(_head_sql("patch", _NORM2("x")))
def head_minus_base_m2(spark, sf_dir):
    return _head_minus_base(spark, sf_dir, "patch", squeezed)


@query(_head_sql("test_patch", "x"))
def head_minus_base_m3(spark, sf_dir):
    return _head_minus_base(spark, sf_dir, "test_patch", lambda x: x)


@query("SELECT evidence_id, regexp_extract(source_url, '([^/?#]+)/([^/?#]+)/pull/\\d+', 1) AS owner, url_encode(coalesce(evidence_snippet, '')) AS query FROM (SELECT DISTINCT ON (evidence_id) * FROM evidence) WHERE source_url <> ''")
def search_urls(spark, sf_dir):
    e = evidence(spark, sf_dir, "source_url", "evidence_snippet").where("source_url != ''")
    return e.select("evidence_id", F.regexp_extract("source_url", r"([^/?#]+)/([^/?#]+)/pull/\d+", 1).alias("owner"), links.percent_encoded(F.coalesce("evidence_snippet", F.lit(""))).alias("query"))


@query("SELECT status, count(*)::BIGINT AS n, count(*) FILTER (contaminated)::BIGINT AS contaminated, count(*) FILTER (len(matched_files) > 0)::BIGINT AS with_files, sum(len(matched_files))::BIGINT AS files, sum(patch_tokens)::BIGINT AS tokens FROM codeseal_matches GROUP BY status")
def content_status(spark, sf_dir):
    c = table(spark, sf_dir, "codeseal_matches")
    return c.groupBy("status").agg(F.count("*").alias("n"), F.count_if("contaminated").alias("contaminated"), F.count_if(F.size("matched_files") > 0).alias("with_files"), F.sum(F.size("matched_files")).alias("files"), F.sum("patch_tokens").alias("tokens"))


@query("SELECT instance_id, line_overlap, round(exposed_changed_lines / nullif(total_changed_lines, 0), 6) AS rate, CASE WHEN verbatim_match THEN 'verbatim' WHEN normalized_match OR coalesce(exposed_changed_lines / nullif(total_changed_lines, 0), 0) >= 0.95 THEN 'normalized' WHEN coalesce(exposed_changed_lines / nullif(total_changed_lines, 0), 0) >= 0.82 THEN 'near_duplicate' ELSE 'none' END AS match, (embedding_similarity >= 0.85 AND ngram_overlap_8 < 0.5)::INT AS paraphrase FROM patch_exposure")
def exposure_classes(spark, sf_dir):
    rate = F.col("exposed_changed_lines") / F.nullif("total_changed_lines", F.lit(0))
    known = F.coalesce(rate, F.lit(0.0))
    match = F.when(F.col("verbatim_match"), "verbatim").when(F.col("normalized_match") | (known >= 0.95), "normalized").when(known >= 0.82, "near_duplicate").otherwise("none")
    return table(spark, sf_dir, "patch_exposure").select("instance_id", "line_overlap", F.round(rate, 6).alias("rate"), match.alias("match"), ((F.col("embedding_similarity") >= 0.85) & (F.col("ngram_overlap_8") < 0.5)).cast("int").alias("paraphrase"))


_FILLED = f"{strip_sql('p')} <> '' AND lower({strip_sql('p')}) NOT IN ('nan', 'none', 'null')"


@query(f"WITH e AS (SELECT DISTINCT evidence_id, evidence_snippet AS p FROM evidence WHERE evidence_snippet <> '') SELECT evidence_id, doc_id FROM e JOIN documents ON contains(text, p) WHERE {_FILLED}")
def snippet_hits(spark, sf_dir):
    """Documents that hold a snippet verbatim; blank snippets and nulls written as text are none."""
    p = evidence(spark, sf_dir, F.col("evidence_snippet").alias("pattern")).withColumnRenamed("evidence_id", "id")
    p = p.where((text.strip("pattern") != "") & ~F.lower(text.strip("pattern")).isin("nan", "none", "null"))
    return substring_join(p, docs(spark, sf_dir)).select(F.col("id").alias("evidence_id"), F.col("text_id").alias("doc_id"))


def docs(spark, sf_dir, *kinds: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = d.where(F.col("kind").isin(*kinds)) if kinds else d
    return spread(d.select(F.col("doc_id").alias("text_id"), "text"))


_PHRASE = "trim(substring(trim(regexp_replace(regexp_replace(regexp_replace(substring(problem_statement, 1, 200), '(?s)```.*?(```|$)', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')), 1, 60))"
_TALK = ("issue_comment", "forum_post", "mail_thread")


@query(f"WITH i AS (SELECT DISTINCT instance_id, {_PHRASE} AS p FROM instances WHERE length(problem_statement) > 50) SELECT instance_id, doc_id FROM i JOIN documents ON contains(text, p) WHERE kind IN {_TALK} AND length(p) >= 30")
def issue_phrase_hits(spark, sf_dir):
    """Talk that quotes the beginning of a problem statement."""
    x = F.regexp_replace(F.regexp_replace(F.substring("problem_statement", 1, 200), r"(?s)```.*?(```|$)", " "), r"https?://\S+", " ")
    phrase = F.trim(F.substring(F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " ")), 1, 60))
    p = instances(spark, sf_dir, "problem_statement").where(F.length("problem_statement") > 50).select(F.col("instance_id").alias("id"), phrase.alias("pattern")).where(F.length("pattern") >= 30)
    return substring_join(p, docs(spark, sf_dir, *_TALK)).select(F.col("id").alias("instance_id"), F.col("text_id").alias("doc_id"))


@query("SELECT DISTINCT source AS name, CASE lower(source) WHEN 'forge_code' THEN '2024-03-15' WHEN 'web_captures' THEN '2024-06-01' END AS cutoff FROM documents WHERE source IS NOT NULL")
def model_cutoff_lookup(spark, sf_dir):
    """The cutoff of the corpus that each source of documents stands for."""
    names = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("name"))
    dates = dict(cutoffs.CORPORA)
    given = spark.createDataFrame([("Forge Code", dates["stack-v2"]), ("web-captures", dates["common-crawl"])], "name string, cutoff string")
    return cutoffs.lookup(names, given).select("name", F.col("cutoff").cast("string").alias("cutoff"))


@query(f"WITH {_IDS}, n AS (SELECT instance_id, unnest(list_distinct(ids)) AS w FROM q), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{text.WORD}'))) AS w FROM documents WHERE text IS NOT NULL AND kind IN ('mail_thread', 'release_notes')) SELECT instance_id, doc_id, count(*)::BIGINT AS terms FROM n JOIN d USING (w) GROUP BY ALL HAVING count(*) >= 2")
def message_hits(spark, sf_dir):
    """Messages that mention at least two of the identifiers a patch is searched by."""
    terms = search_identifiers(_searched(spark, sf_dir)).select("instance_id", F.explode(F.array_distinct("ids")).alias("w"))
    d = docs(spark, sf_dir, "mail_thread", "release_notes").where("text is not null")
    words = d.select(F.col("text_id").alias("doc_id"), F.explode(F.array_distinct(text.words("text"))).alias("w"))
    return terms.join(words, "w").groupBy("instance_id", "doc_id").agg(F.count("*").alias("terms")).where("terms >= 2")
