"""Queries of the consensus mode, of the audit's whole verdict, and of the evidence shown for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions import diff, hashes, links, risk, text
from leakscope.functions.repos import canonical_repo
from leakscope.operators.sampling import first_of_each, round_robin_sample, scan_sample
from leakscope.operators.search import line_anchor, search_identifiers, verified_files
from leakscope.plans.audit import circular
from leakscope.plans.consensus import UNVERIFIABLE, consensus, statement_files
from leakscope.queries import audit as A
from leakscope.queries.sqltext import REPO, lines_sql, strip_sql
from leakscope.queries.texts import _P, instances, snippets
from leakscope.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- the audit's verdict

_MISSING = "(not_evaluated OR (snippet = '(PR diff not available)' AND patch_exposure = 0))"


def _signals(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "instance_risk")
    e = table(spark, sf_dir, "patch_exposure").select("instance_id", "verbatim_match", "normalized_match")
    kinds = A.evidence(spark, sf_dir, "instance_id", "match_type").groupBy("instance_id").agg(
        F.bool_or(F.col("match_type") == "problem_statement_verbatim").alias("statement_verbatim"), F.bool_or(F.col("match_type") == "test_patch_verbatim").alias("test_verbatim")
    )
    missing = F.col("not_evaluated") | ((F.col("snippet") == "(PR diff not available)") & (F.col("patch_exposure") == 0))
    return r.join(e, "instance_id", "left").join(kinds, "instance_id", "left").withColumn("missing", F.coalesce(missing, F.lit(False)))


_LATE = "coalesce(day >= DATE '2024-03-15', false)"


@query(f"""WITH e AS (SELECT DISTINCT ON (evidence_id) * FROM evidence), k AS (SELECT instance_id, bool_or(match_type = 'problem_statement_verbatim') AS sv, bool_or(match_type = 'test_patch_verbatim') AS tv FROM e GROUP BY 1),
x AS (SELECT r.*, coalesce({_MISSING}, false) AS gone, coalesce(verbatim_match, false) AS vb, coalesce(normalized_match, false) AS nm, coalesce(sv, false) AS sv, coalesce(tv, false) AS tv, {A._DAY} AS day, repo_in_training_corpus AS c FROM instance_risk r LEFT JOIN (SELECT instance_id, verbatim_match, normalized_match FROM patch_exposure) USING (instance_id) LEFT JOIN k USING (instance_id)),
y AS (SELECT *, CASE WHEN gone THEN 0 ELSE {A._CLAMP('patch_exposure')} END AS p, CASE WHEN gone THEN 0 ELSE {A._CLAMP('problem_statement_exposure')} END AS s, CASE WHEN gone THEN 0 ELSE {A._CLAMP('test_patch_exposure')} END AS t, CASE WHEN gone THEN 0 ELSE embedding_similarity END AS emb FROM x),
r1 AS (SELECT *, CASE WHEN gone THEN 'clean' ELSE {A._BASE} END AS r1 FROM y),
r2 AS (SELECT *, CASE WHEN {_LATE} AND r1 = 'critical' THEN 'high' WHEN {_LATE} AND r1 = 'high' THEN 'medium' WHEN {_LATE} AND r1 = 'medium' THEN 'low' ELSE r1 END AS r2 FROM r1),
r3 AS (SELECT *, CASE WHEN codeseal_matches > 0 AND r2 = 'clean' THEN CASE WHEN codeseal_similarity >= 0.3 THEN 'medium' ELSE 'low' END WHEN codeseal_matches > 0 AND r2 = 'low' AND codeseal_similarity >= 0.3 THEN 'medium' ELSE r2 END AS r3 FROM r2),
r4 AS (SELECT *, CASE WHEN emb >= 0.85 AND ngram_overlap_8 < 0.5 AND r3 IN ('clean', 'low', 'medium') THEN 'high' ELSE r3 END AS r4 FROM r3),
r5 AS (SELECT *, CASE WHEN independent_hits > 0 AND non_vendor_hits >= 3 THEN 'critical' WHEN independent_hits > 0 AND r4 IN ('clean', 'low', 'medium') THEN 'high' ELSE r4 END AS r5 FROM r4)
SELECT instance_id, r1 AS before_cutoff, CASE WHEN NOT gone AND independent_hits > 0 AND {_LATE} AND r5 = 'critical' THEN 'high' ELSE r5 END AS verdict, gone::INT AS missing,
CASE WHEN NOT gone AND vb THEN 'patch_verbatim' WHEN NOT gone AND (nm OR p >= 0.95) THEN 'patch_normalized' WHEN NOT gone AND p >= 0.82 THEN 'patch_near_duplicate'
WHEN NOT gone AND sv THEN 'problem_statement_verbatim' WHEN NOT gone AND problem_statement_exposure >= 0.82 THEN 'problem_statement_near_duplicate' WHEN NOT gone AND tv THEN 'test_patch_verbatim' WHEN NOT gone AND test_patch_exposure >= 0.82 THEN 'test_patch_near_duplicate'
WHEN codeseal_matches > 0 THEN 'codeseal_content_hit' WHEN emb >= 0.85 AND ngram_overlap_8 < 0.5 THEN 'embedding_similarity_hit' WHEN independent_hits > 0 THEN 'independent_source_hit' END AS top_match FROM r5""")
def audit_verdicts(spark, sf_dir):
    """The whole order of verdict steps with the branch for missing sources, and which kind of evidence speaks first."""
    v = risk.verdicts(_signals(spark, sf_dir), A.CUTOFF)
    return v.select("instance_id", F.col("risk_1").alias("before_cutoff"), F.col("risk_6").alias("verdict"), F.col("missing").cast("int").alias("missing"), "top_match")


# ---- the consensus mode

_BARE = lambda x: f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^﻿', ''), '#.*$', ''), '//.*$', ''), '[{text.WS}]+', '', 'g'))"
_CREATED = A.day_sql("created_at")
_CHUNK = strip_sql("substring(problem_statement, 1, 200)")
_DENSE = "length(c) - length(translate(c, '(){}[];=<>+-*/|\\`', '')) <= 0.4 * length(c)"
_COL = lambda x: rf"regexp_replace(regexp_replace({x}, '[{text.WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"
_M4 = f"mc AS (SELECT instance_id, repo, {_CHUNK} AS c FROM i WHERE length(problem_statement) > 50), mp AS (SELECT instance_id, repo, c, {_COL('c')} AS cc FROM mc WHERE length(c) > 30 AND {_DENSE}), md AS (SELECT doc_id, {REPO} AS drepo, text, {_COL(chr(39).join(['translate(text, ', '#/', ', ', '  ', ')']))} AS bare FROM documents WHERE text IS NOT NULL), m4 AS (SELECT DISTINCT instance_id, doc_id, repo = drepo AS own FROM mp JOIN md ON contains(text, c) OR contains(bare, cc))"


@query(f"WITH i AS (SELECT DISTINCT instance_id, {REPO} AS repo, problem_statement FROM instances), {_M4} SELECT instance_id, count(*)::BIGINT AS files, count(*) FILTER (coalesce(own, false))::BIGINT AS own_files FROM m4 GROUP BY instance_id")
def statement_m4(spark, sf_dir):
    """Documents that hold the beginning of a statement, unless that is code, and those of the instance's repository among them."""
    i = instances(spark, sf_dir, canonical_repo("repo").alias("repo"), "problem_statement")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", canonical_repo("repo").alias("file_repo"))
    own = F.coalesce(F.col("repo") == F.col("file_repo"), F.lit(False))
    return statement_files(i, d).join(d.select("doc_id", "file_repo"), "doc_id").join(i.select("instance_id", "repo"), "instance_id").groupBy("instance_id").agg(F.count("*").alias("files"), F.count_if(own).alias("own_files"))


def _consensus_sql() -> str:
    added = A._CH
    lines = lambda m, f, field, norm: f"SELECT instance_id, repo, day, {m} AS method, '{f}' AS form, unnest(list_filter(list_transform({added(field)}, lambda x: {norm}), lambda x: x <> '')) AS line FROM i"
    return (
        f"i AS (SELECT DISTINCT instance_id, {REPO} AS repo, patch, test_patch, problem_statement, {_CREATED} AS day FROM instances), {_M4}, "
        f"a AS ({lines(1, 'x', 'patch', 'x')} UNION ALL {lines(2, 's', 'patch', _BARE('x'))} UNION ALL {lines(3, 'x', 'test_patch', 'x')}), "
        f"dl AS (SELECT {REPO} AS repo, crawled_at::DATE AS seen, unnest({lines_sql('text')}) AS l FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL), "
        f"h AS (SELECT repo, form, line, min(seen) AS seen, 1 AS hit FROM (SELECT repo, seen, 'x' AS form, {strip_sql('l')} AS line FROM dl UNION ALL SELECT repo, seen, 's', {_BARE('l')} FROM dl) WHERE line <> '' GROUP BY ALL), "
        "p AS (SELECT instance_id, method, count(*) AS lines, count(hit) AS in_head, count(hit) FILTER (NOT coalesce(seen < day, false)) AS head_only FROM a LEFT JOIN h USING (repo, form, line) GROUP BY ALL), "
        f"f AS (SELECT {REPO} AS repo, count(*) AS head_files, min(crawled_at)::DATE AS first_seen FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL GROUP BY 1), "
        "o4 AS (SELECT DISTINCT instance_id FROM m4 WHERE own), "
        "w AS (SELECT i.instance_id, i.repo, coalesce(p1.lines, 0) AS l1, coalesce(p3.lines, 0) AS l3, coalesce(p1.in_head, 0) AS i1, coalesce(p1.head_only, 0) AS h1, coalesce(p2.head_only, 0) AS h2, coalesce(p3.head_only, 0) AS h3, (o4.instance_id IS NOT NULL)::INT AS h4, coalesce(head_files, 0) AS hf, coalesce(first_seen < day, false) AS base, coalesce(length(problem_statement) > 50, false)::INT AS st FROM i LEFT JOIN p p1 ON p1.instance_id = i.instance_id AND p1.method = 1 LEFT JOIN p p2 ON p2.instance_id = i.instance_id AND p2.method = 2 LEFT JOIN p p3 ON p3.instance_id = i.instance_id AND p3.method = 3 LEFT JOIN f ON f.repo = i.repo LEFT JOIN o4 ON o4.instance_id = i.instance_id), "
        "s AS (SELECT *, CASE WHEN l1 = 0 THEN 'no_lines' WHEN hf = 0 THEN 'head_not_found' WHEN NOT base AND i1 > 0 THEN 'base_not_found_suspect' WHEN NOT base THEN 'base_not_found_clean' END AS state, (h1 > 0)::INT + (h2 > 0)::INT + (h3 > 0)::INT + h4 AS det, 2 + (l3 > 0)::INT + st AS rn FROM w), "
        "u AS (SELECT *, CASE WHEN state IS NULL THEN h1 WHEN starts_with(state, 'base') THEN i1 ELSE 0 END AS m1 FROM s), "
        "g AS (SELECT *, CASE WHEN l1 > 0 THEN m1 / l1 ELSE 0 END AS rate FROM u), "
        "c AS (SELECT instance_id, repo, m1::BIGINT AS m1, CASE WHEN state IS NULL THEN h2 ELSE 0 END::BIGINT AS m2, CASE WHEN state IS NULL THEN h3 ELSE 0 END::BIGINT AS m3, CASE WHEN state IS NULL THEN h4 ELSE 0 END AS m4, CASE WHEN state IS NULL THEN det ELSE 0 END AS detected, CASE WHEN state IS NULL THEN rn ELSE 0 END AS run, round(rate, 6) AS exposure, coalesce(state, CASE WHEN det >= 2 OR (det = 1 AND rate >= 0.5) THEN 'contaminated' WHEN det = 1 THEN 'suspect' ELSE 'clean' END) AS verdict FROM g), "
        "z AS (SELECT *, CASE WHEN verdict <> 'contaminated' THEN 'clean' WHEN detected / run >= 0.75 OR exposure >= 0.5 THEN 'critical' WHEN detected / run >= 0.5 OR exposure >= 0.2 THEN 'high' ELSE 'medium' END AS risk FROM c)"
    )


_C = _consensus_sql()


def _consensus(spark, sf_dir) -> DataFrame:
    i = instances(spark, sf_dir, canonical_repo("repo").alias("repo"), "patch", "test_patch", "problem_statement", risk.to_date(F.col("created_at")).alias("day"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", canonical_repo("repo").alias("repo"), F.col("crawled_at").cast("date").alias("seen"))
    return consensus(i, d)


@query(f"WITH {_C} SELECT instance_id, m1, m2, m3, m4, detected, run, exposure, verdict FROM z")
def consensus_verdict(spark, sf_dir):
    """What each of the four methods found, how many of them agree, and the verdict on it."""
    return _consensus(spark, sf_dir).select("instance_id", "m1", "m2", "m3", "m4", "detected", "run", "exposure", "verdict")


_S3 = "CASE WHEN n > 0 AND risk = 'clean' THEN CASE WHEN similarity >= 0.3 THEN 'medium' ELSE 'low' END WHEN n > 0 AND risk = 'low' AND similarity >= 0.3 THEN 'medium' ELSE risk END"
_PRO = f"{_C}, pr AS (SELECT z.* EXCLUDE (risk), {_S3} AS risk, n FROM z LEFT JOIN (SELECT instance_id, similarity, len(matched_files) AS n FROM codeseal_matches) USING (instance_id))"


def _pro_risks(spark, sf_dir) -> DataFrame:
    content = table(spark, sf_dir, "codeseal_matches").select("instance_id", "similarity", F.size("matched_files").alias("n"))
    j = _consensus(spark, sf_dir).join(content, "instance_id", "left")
    there = F.coalesce(F.col("n") > 0, F.lit(False))
    return j.withColumn("risk", F.when(there, F.when(F.col("risk") == "clean", F.when(F.col("similarity") >= 0.3, "medium").otherwise("low")).when((F.col("risk") == "low") & (F.col("similarity") >= 0.3), "medium").otherwise(F.col("risk"))).otherwise(F.col("risk")))


@query(f"WITH {_PRO} SELECT instance_id, verdict, risk FROM pr")
def risk_pro(spark, sf_dir):
    """Levels of the consensus mode, raised by content matches."""
    return _pro_risks(spark, sf_dir).select("instance_id", "verdict", "risk")


_UNV = ", ".join(f"'{u}'" for u in UNVERIFIABLE)


@query(f"WITH {_PRO} SELECT count(*)::BIGINT AS total, count(*) FILTER (risk <> 'clean')::BIGINT AS contaminated, count(*) FILTER (m3 > 0)::BIGINT AS tests, count(*) FILTER (m4 > 0)::BIGINT AS statements, count(*) FILTER (n > 0)::BIGINT AS content, " + ", ".join(f"count(*) FILTER (risk = '{x}')::BIGINT AS n_{x}" for x in ("critical", "high", "medium", "clean")) + f", 0::BIGINT AS n_low, count(*) FILTER (verdict NOT IN ({_UNV}))::BIGINT AS verifiable, round(count(*) FILTER (risk <> 'clean') / count(*), 6) AS rate, round(count(*) FILTER (risk <> 'clean') / nullif(count(*) FILTER (verdict NOT IN ({_UNV})), 0), 6) AS rate_among_verifiable FROM pr")
def pro_summary(spark, sf_dir):
    """Totals of the consensus mode, of all instances and of those that could be verified; it reports no low level."""
    p = _pro_risks(spark, sf_dir)
    bad, seen = F.count_if(F.col("risk") != "clean"), F.count_if(~F.col("verdict").isin(*UNVERIFIABLE))
    return p.agg(
        F.count("*").alias("total"), bad.alias("contaminated"), F.count_if(F.col("m3") > 0).alias("tests"), F.count_if(F.col("m4") > 0).alias("statements"), F.count_if(F.col("n") > 0).alias("content"),
        *[F.count_if(F.col("risk") == x).alias(f"n_{x}") for x in ("critical", "high", "medium", "clean")], F.lit(0).cast("long").alias("n_low"), seen.alias("verifiable"),
        F.round(bad / F.count("*"), 6).alias("rate"), F.round(bad / F.nullif(seen, F.lit(0)), 6).alias("rate_among_verifiable"),
    )


@query(f"WITH {_C} SELECT verdict, count(*)::BIGINT AS n, " + ", ".join(f"count(*) FILTER (m{m} > 0)::BIGINT AS m{m}_hits" for m in (1, 2, 3, 4)) + " FROM z GROUP BY verdict")
def method_hits(spark, sf_dir):
    """How many instances of each verdict each method detected."""
    return _consensus(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"m{m}") > 0).alias(f"m{m}_hits") for m in (1, 2, 3, 4)])


@query("WITH i AS (SELECT DISTINCT instance_id FROM instances), d AS (SELECT instance_id FROM i WHERE instance_id NOT IN (SELECT instance_id FROM codeseal_matches WHERE error IS NULL)) SELECT count(*)::BIGINT AS dropped, (SELECT string_agg(instance_id, ' ' ORDER BY instance_id) FROM (SELECT instance_id FROM d ORDER BY instance_id LIMIT 10)) AS first_ids FROM d")
def dropped_instances(spark, sf_dir):
    """How many instances went in but came out with an error or not at all, and the first ten of them."""
    done = table(spark, sf_dir, "codeseal_matches").where("error is null").select("instance_id")
    d = instances(spark, sf_dir).join(done, "instance_id", "left_anti")
    ten = d.orderBy("instance_id").limit(10).agg(F.array_join(F.sort_array(F.collect_list("instance_id")), " ").alias("ids"))
    n = d.agg(F.count("*").alias("dropped"))
    return n.withColumn("k", F.lit(1)).join(ten.withColumn("k", F.lit(1)), "k").select("dropped", F.nullif("ids", F.lit("")).alias("first_ids"))


# ---- evidence that can be shown

_GATED = A.SQL["evidence_link_gate"]


def _eligible(spark, sf_dir, *cols) -> DataFrame:
    e = A.evidence(spark, sf_dir, "source_url", "source_kind", "verification_status", "match_type", "instance_id", *cols)
    return e.where(links.gate(F.col("source_url"), F.col("source_kind"), F.col("verification_status"), "forge.example") == "eligible")


_EL = f"e AS (SELECT DISTINCT ON (evidence_id) * FROM evidence), el AS (SELECT e.* FROM e JOIN ({_GATED}) g USING (evidence_id) WHERE g.status = 'eligible')"


@query(f"WITH {_EL} SELECT DISTINCT instance_id FROM el WHERE contains(match_type, 'independent') OR contains(match_type, 'issue')")
def clickable_instances(spark, sf_dir):
    """Instances with a link to independent or issue evidence that may be shown."""
    return _eligible(spark, sf_dir).where("match_type like '%independent%' or match_type like '%issue%'").select("instance_id").distinct()


@query(f"WITH {_EL}, r AS (SELECT DISTINCT trim(unnest(string_split(source_repo, ','))) AS repo FROM el WHERE contains(match_type, 'independent')) SELECT repo FROM r WHERE contains(repo, '/') ORDER BY repo LIMIT 10")
def named_repos(spark, sf_dir):
    """The first ten repositories that a report may name as places of independent copies."""
    r = _eligible(spark, sf_dir, "source_repo").where("match_type like '%independent%'").select(F.explode(F.split("source_repo", ",")).alias("repo")).select(F.trim("repo").alias("repo"))
    return r.where(F.contains("repo", F.lit("/"))).distinct().orderBy("repo").limit(10)


@query(f"WITH {_EL} SELECT evidence_id, instance_id, independent_hits, source_url FROM el JOIN instance_risk USING (instance_id) WHERE contains(match_type, 'independent') AND independent_hits > 0")
def evidence_table(spark, sf_dir):
    """Independent evidence with the hits of its instance, most first."""
    r = table(spark, sf_dir, "instance_risk").select("instance_id", "independent_hits").where("independent_hits > 0")
    return _eligible(spark, sf_dir).where("match_type like '%independent%'").join(r, "instance_id").select("evidence_id", "instance_id", "independent_hits", "source_url").orderBy(F.desc("independent_hits"), "evidence_id")


@query(f"WITH {A._IDS}, {_EL}, v AS (SELECT instance_id, arg_min(source_url, evidence_id) AS url FROM el WHERE verification_status = 'exact_changed_lines' AND contains(match_type, 'independent') GROUP BY 1) SELECT instance_id, coalesce(v.url, 'https://forge.example/search?type=code&q=' || replace(array_to_string(ids, '%20'), '+', '%20'), '') AS url FROM (SELECT DISTINCT instance_id FROM instances) LEFT JOIN v USING (instance_id) LEFT JOIN (SELECT instance_id, ids FROM q) USING (instance_id)")
def preferred_url(spark, sf_dir):
    """The link shown for an instance: the first verified copy, else the search that can be repeated, else nothing."""
    v = _eligible(spark, sf_dir).where("verification_status = 'exact_changed_lines' and match_type like '%independent%'").groupBy("instance_id").agg(F.min_by("source_url", "evidence_id").alias("url"))
    s = search_identifiers(A._searched(spark, sf_dir)).select("instance_id", F.concat(F.lit("https://forge.example/search?type=code&q="), links.percent_encoded(F.array_join("ids", " "))).alias("replay"))
    return instances(spark, sf_dir).join(v, "instance_id", "left").join(s, "instance_id", "left").select("instance_id", F.coalesce("url", "replay", F.lit("")).alias("url"))


@query(f"WITH {_P} SELECT id, (q <> '' AND s <> '' AND contains(s, q) AND len(list_filter({lines_sql('s')}[1:20], lambda x: starts_with(x, 'diff --git') OR starts_with(x, '---') OR starts_with(x, '+++'))) > 0)::INT AS circular FROM p")
def circular_matches(spark, sf_dir):
    """Snippets whose match proves nothing, since they stand in the very diff they are said to come from."""
    return snippets(spark, sf_dir, "patch", "patch").select("id", circular(F.col("q"), F.col("s")).cast("int").alias("circular"))


# ---- verified replication

_COLL = rf"regexp_replace(regexp_replace(%s, '[{text.WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"
_REPL = (
    A.SQL["candidate_hits"].replace("SELECT instance_id, doc_id FROM n JOIN", ", cand AS (SELECT instance_id, doc_id FROM n JOIN", 1) + ")"
    + f", pl AS (SELECT instance_id, {lines_sql('patch')} AS l FROM i), pp AS (SELECT instance_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM pl), pg AS (SELECT instance_id, pos, line, sum(starts_with(line, 'diff --git ')::INT) OVER (PARTITION BY instance_id ORDER BY pos) AS grp FROM pp)"
    + f", gl AS (SELECT DISTINCT instance_id, grp, {_COLL % 'substring(line, 2)'} AS line FROM pg WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')), g AS (SELECT * FROM gl WHERE line <> '')"
    + ", sz AS (SELECT instance_id, grp, CASE WHEN count(*) = 1 THEN CASE WHEN max(length(line)) >= 40 THEN 1 END WHEN count(*) <= 3 THEN 2 ELSE greatest(3, (count(*) + 1) // 2) END AS required FROM g GROUP BY ALL)"
    + f", tl AS (SELECT doc_id, {lines_sql('text')} AS l FROM documents WHERE doc_id IN (SELECT doc_id FROM cand)), tp AS (SELECT doc_id, unnest(l) AS l, unnest(range(1, len(l) + 1)) AS ln FROM tl), t AS (SELECT doc_id, {_COLL % 'l'} AS line, min(ln) AS ln FROM tp GROUP BY ALL)"
    + ", per AS (SELECT instance_id, doc_id, grp, count(*) AS matched, min(ln) AS first_line, max(ln) AS last_line FROM cand JOIN g USING (instance_id) JOIN t USING (doc_id, line) GROUP BY ALL), ok AS (SELECT *, coalesce(matched >= required, false) AS verified FROM per JOIN sz USING (instance_id, grp))"
    + ", rk AS (SELECT *, row_number() OVER (PARTITION BY instance_id, doc_id ORDER BY verified DESC, CASE WHEN verified THEN 0 ELSE matched END DESC, grp) AS r FROM ok), best AS (SELECT * FROM rk WHERE r = 1)"
)
_ANCHOR = "'#L' || first_line || CASE WHEN last_line > first_line THEN '-L' || last_line ELSE '' END"


def _verified(spark, sf_dir) -> DataFrame:
    p, f = A._searched(spark, sf_dir), A._files(spark, sf_dir)
    return verified_files(p, f, A._candidates(spark, sf_dir))


@query(f"{_REPL} SELECT instance_id, doc_id, verified, grp::BIGINT AS grp, matched::BIGINT AS matched, required::BIGINT AS required, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, {_ANCHOR} AS anchor FROM best")
def verified_replication(spark, sf_dir):
    """Candidates that hold enough added lines of a group of the patch; the first such group, its lines and where they stand."""
    v = _verified(spark, sf_dir)
    long = [F.col(c).cast("long").alias(c) for c in ("grp", "matched", "required", "first_line", "last_line")]
    return v.select("instance_id", "doc_id", "verified", *long, line_anchor(F.col("first_line"), F.col("last_line")).alias("anchor"))


_MARK = A._MARK


@query(f"{_REPL}, dd AS (SELECT doc_id, {REPO} AS file_repo, (len(list_intersect(string_split(lower(replace(path, '\\', '/')), '/'), [{_MARK}])) > 0 OR list_contains(string_split(lower(replace(path, '\\', '/')), '/'), split_part({REPO}, '/', -1))) AS vendor FROM documents), gt AS (SELECT instance_id, grp, count(*) AS total FROM g GROUP BY ALL), cn AS (SELECT instance_id, count(*) AS n FROM cand GROUP BY 1) SELECT instance_id, count(DISTINCT file_repo)::BIGINT AS repos, any_value(cn.n)::BIGINT AS candidates, count(*) FILTER (vendor)::BIGINT AS vendor_files, sum(matched)::BIGINT AS matched_lines, sum(total)::BIGINT AS total_lines FROM best JOIN dd USING (doc_id) JOIN gt USING (instance_id, grp) JOIN cn USING (instance_id) WHERE verified GROUP BY instance_id")
def replication_rollup(spark, sf_dir):
    """Per instance: repositories with a verified copy, candidates, copied dependencies, and lines found of lines asked for."""
    p, f, c = A._searched(spark, sf_dir), A._files(spark, sf_dir), A._candidates(spark, sf_dir).persist()
    v = verified_files(p, f, c).where("verified")
    marked = f.select("doc_id", "file_repo", links.vendor_like(F.col("path"), F.col("file_repo")).alias("vendor"))
    totals = diff.file_groups(p, "instance_id", "patch", text.collapse).groupBy("instance_id", "grp").agg(F.count("*").alias("total"))
    counts = c.groupBy("instance_id").agg(F.count("*").alias("candidates"))
    return v.join(marked, "doc_id").join(totals, ["instance_id", "grp"]).join(counts, "instance_id").groupBy("instance_id").agg(
        F.count_distinct("file_repo").alias("repos"), F.max("candidates").alias("candidates"), F.count_if("vendor").alias("vendor_files"), F.sum("matched").alias("matched_lines"), F.sum("total").alias("total_lines")
    )


# ---- order, samples, budgets

@query(f"WITH s AS ({A.SQL['per_repo_signals']}), t AS (SELECT repo, total, signal FROM s ORDER BY signal / total DESC, source / total DESC, repo LIMIT 10), r AS (SELECT {REPO} AS repo, instance_id, row_number() OVER (PARTITION BY {REPO} ORDER BY independent_hits DESC, instance_id) AS k FROM instance_risk) SELECT repo, total, signal, string_agg(instance_id, ' ' ORDER BY k) AS leading FROM t JOIN r USING (repo) WHERE k <= 5 GROUP BY ALL")
def repo_narratives(spark, sf_dir):
    """The ten repositories with most signals, each with its five instances of most independent hits."""
    top = Q_per_repo(spark, sf_dir).limit(10).select("repo", "total", "signal")
    rows = table(spark, sf_dir, "instance_risk").select(canonical_repo("repo").alias("repo"), "instance_id", (-F.col("independent_hits")).alias("key")).join(top.select("repo"), "repo", "left_semi")
    five = first_of_each(rows, "repo", ["key", "instance_id"], 5).groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "instance_id"))), lambda x: x["instance_id"]), " ").alias("leading"))
    return top.join(five, "repo")


Q_per_repo = A.Q["per_repo_signals"]


@query(f"WITH d AS (SELECT {REPO} AS repo, min(instance_id) AS first_id, count(DISTINCT instance_id)::BIGINT AS n FROM instances GROUP BY 1) SELECT repo, first_id, n FROM d")
def first_seen_repos(spark, sf_dir):
    """Repositories in the order of their first instance."""
    return instances(spark, sf_dir, canonical_repo("repo").alias("repo")).groupBy("repo").agg(F.min("instance_id").alias("first_id"), F.count("*").alias("n")).orderBy("first_id")


@query(f"WITH d AS (SELECT doc_id, concat_ws('/', nullif(lower(trim(lang)), ''), nullif({REPO}, '')) AS grp FROM documents), r AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS round, min(doc_id) OVER (PARTITION BY grp) AS first FROM d) SELECT doc_id, grp, round::INT AS round FROM r ORDER BY round, first LIMIT 300")
def language_sample(spark, sf_dir):
    """A round-robin sample of documents over groups of language and repository."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.nullif(F.lower(F.trim("lang")), F.lit("")), F.nullif(canonical_repo("repo"), F.lit(""))).alias("grp"))
    return round_robin_sample(d, "grp", "doc_id", 300).select("doc_id", "grp", "round")


@query(f"WITH d AS (SELECT doc_id, concat_ws('/', nullif(lower(trim(lang)), ''), nullif({REPO}, '')) AS grp, row_number() OVER (ORDER BY doc_id) AS line FROM documents ORDER BY doc_id LIMIT 20000), g AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY line) AS gi FROM d), c AS (SELECT *, sum((gi <= 20)::INT) OVER (ORDER BY line) AS cand, sum((gi = 1)::INT) OVER (ORDER BY line) AS groups FROM g), s AS (SELECT min(line) AS stop FROM c WHERE cand >= 20 AND (line >= 4000 OR groups >= 20 OR line >= 20000)), k AS (SELECT doc_id, grp, line FROM c, s WHERE line <= coalesce(stop, 20000) AND gi <= 20), r AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY line) AS round, min(line) OVER (PARTITION BY grp) AS first FROM k) SELECT doc_id, grp, round::INT AS round FROM r ORDER BY round, first LIMIT 20")
def first_lines_sample(spark, sf_dir):
    """A sample of 20 documents over groups of language and repository that stops reading once it has seen enough."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.nullif(F.lower(F.trim("lang")), F.lit("")), F.nullif(canonical_repo("repo"), F.lit(""))).alias("grp"))
    return scan_sample(d, "grp", "doc_id", 20).select("doc_id", "grp", "round")


@query("SELECT instance_id, loaded_at FROM (SELECT DISTINCT ON (instance_id) * FROM instances ORDER BY instance_id, loaded_at) ORDER BY loaded_at, instance_id LIMIT 50")
def ordered_head(spark, sf_dir):
    """The first 50 instances in the order of their loading."""
    i = table(spark, sf_dir, "instances").where("instance_id is not null").groupBy("instance_id").agg(F.min("loaded_at").alias("loaded_at"))
    return i.orderBy("loaded_at", "instance_id").limit(50)


@query("SELECT count(DISTINCT instance_id)::BIGINT AS instances, (3 * count(DISTINCT instance_id))::BIGINT AS calls, (count(DISTINCT instance_id) // 28 + 1)::BIGINT AS minutes FROM instances")
def preflight_budget(spark, sf_dir):
    """Calls and minutes a search of all instances would take: three calls each, 28 searches a minute."""
    n = table(spark, sf_dir, "instances").agg(F.count_distinct("instance_id").alias("instances"))
    return n.select("instances", (F.col("instances") * 3).alias("calls"), (F.floor(F.col("instances") / 28) + 1).cast("long").alias("minutes"))


_OUT, _IN = hashes.hmac_pads("leakscope")


@query(f"SELECT DISTINCT {REPO} AS repo, substring(sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({REPO})))), 1, 16) AS tag FROM repos WHERE repo IS NOT NULL")
def hmac_tags(spark, sf_dir):
    """Keyed tags of repositories, by which records can be told apart without their names."""
    return table(spark, sf_dir, "repos").where("repo is not null").select(canonical_repo("repo").alias("repo")).distinct().withColumn("tag", hashes.hmac_tag("repo", "leakscope"))


@query(f"WITH m AS (SELECT instance_id, unnest(matched_files) AS f FROM codeseal_matches), d AS (SELECT file_id, min({REPO}) AS file_repo FROM documents GROUP BY 1), i AS (SELECT DISTINCT instance_id, {REPO} AS repo FROM instances) SELECT instance_id, count(*)::BIGINT AS matches, count(*) FILTER (coalesce(file_repo <> repo, true))::BIGINT AS elsewhere, max(f.similarity) FILTER (coalesce(file_repo <> repo, true)) AS best FROM m LEFT JOIN d ON d.file_id = f.file_id JOIN i USING (instance_id) GROUP BY instance_id")
def cached_refilter(spark, sf_dir):
    """Stored matches once more without those that stand in the instance's own repository."""
    m = table(spark, sf_dir, "codeseal_matches").select("instance_id", F.explode("matched_files").alias("f")).select("instance_id", "f.file_id", "f.similarity")
    d = table(spark, sf_dir, "documents").groupBy("file_id").agg(F.min(canonical_repo("repo")).alias("file_repo"))
    i = instances(spark, sf_dir, canonical_repo("repo").alias("repo"))
    other = F.coalesce(F.col("file_repo") != F.col("repo"), F.lit(True))
    return m.join(d, "file_id", "left").join(i, "instance_id").groupBy("instance_id").agg(F.count("*").alias("matches"), F.count_if(other).alias("elsewhere"), F.max(F.when(other, F.col("similarity"))).alias("best"))
