"""Tokens, lines, diffs, exposure of snippets, identifiers, MinHash and Bloom queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import diff, text
from leakscope.functions.repos import canonical_repo
from leakscope.operators import bloom, minhash
from leakscope.operators.exposure import char_cosine, char_gram_sizes, containment_join, exposures
from leakscope.queries.sqltext import REPO, SQL_HELPERS, lines_sql, strip_sql
from leakscope.session import spread, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = SQL_HELPERS + sql if not sql.lstrip().startswith("WITH") else sql
        return f

    return keep


def instances(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The given columns of the instances, without re-delivered rows."""
    return table(spark, sf_dir, "instances").select("instance_id", *cols).where("instance_id is not null").dropDuplicates(["instance_id"])


def docs(spark, sf_dir, *cols):
    return spread(table(spark, sf_dir, "documents").select("doc_id", *cols))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{text.TOKEN}') AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM t")
def tokenize_counts(spark, sf_dir):
    t = docs(spark, sf_dir, text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.TOKEN}') AS t FROM documents) SELECT doc_id, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) < 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')))) END::BIGINT AS n_shingles FROM t WHERE t IS NOT NULL")
def word_shingle_counts(spark, sf_dir):
    return docs(spark, sf_dir, "text").where("text is not null").select("doc_id", F.size(text.word_shingles("text")).cast("long").alias("n_shingles"))


_COLLAPSE = rf"regexp_replace(regexp_replace(lower(%s), '[{text.WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"


@query(f"WITH t AS (SELECT doc_id, {_COLLAPSE % 'text'} AS t FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM t) SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT substring(t, i::INT, 3))::BIGINT AS n_distinct FROM g GROUP BY doc_id")
def char3_counts(spark, sf_dir):
    return char_gram_sizes(docs(spark, sf_dir, "text"), "doc_id", "text").where("n > 0").withColumnRenamed("id", "doc_id")


@query(f"WITH t AS (SELECT doc_id, {lines_sql('text')} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda s: {strip_sql('s')} <> ''))::BIGINT AS n_filled, coalesce(list_max(list_transform(l, lambda s: length(s))), 0)::BIGINT AS longest FROM t")
def line_counts(spark, sf_dir):
    ls = docs(spark, sf_dir, "text").where("text is not null").select("doc_id", text.lines("text").alias("l"))
    return ls.select(
        "doc_id",
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("l", lambda s: text.strip(s) != "")).cast("long").alias("n_filled"),
        F.coalesce(F.array_max(F.transform("l", lambda s: F.length(s))), F.lit(0)).cast("long").alias("longest"),
    )


def snippets(spark, sf_dir, prefix: str, field: str) -> DataFrame:
    """(id, q, s): snippets of evidence of a kind, once each, beside the text of their instance they are said to come from."""
    e = table(spark, sf_dir, "evidence").where(F.col("match_type").startswith(prefix)).select("evidence_id", "instance_id", F.col("evidence_snippet").alias("q")).where("q != ''").distinct()
    return e.join(instances(spark, sf_dir, F.col(field).alias("s")), "instance_id").select(F.col("evidence_id").alias("id"), "q", F.coalesce("s", F.lit("")).alias("s"))


def _pairs_sql(prefix: str, field: str) -> str:
    return f"p AS (SELECT DISTINCT evidence_id AS id, evidence_snippet AS q, coalesce({field}, '') AS s FROM evidence JOIN (SELECT DISTINCT instance_id, {field} FROM instances) USING (instance_id) WHERE evidence_snippet <> '' AND match_type LIKE '{prefix}%')"


_P = _pairs_sql("patch", "patch")


@query(f"WITH {_P} SELECT id, contains(s, q)::INT AS verbatim FROM p")
def verbatim_pairs(spark, sf_dir):
    return snippets(spark, sf_dir, "patch", "patch").select("id", F.contains("s", "q").cast("int").alias("verbatim"))


_N = rf"regexp_replace(regexp_replace(%s, '[{text.WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"


@query(f"WITH {_P}, n AS (SELECT id, {_N % 'q'} AS q, {_N % 's'} AS s FROM p) SELECT id, (q <> '' AND contains(s, q))::INT AS normalized FROM n")
def normalized_pairs(spark, sf_dir):
    n = snippets(spark, sf_dir, "patch", "patch").select("id", text.collapse("q").alias("q"), text.collapse("s").alias("s"))
    return n.select("id", ((F.col("q") != "") & F.contains("s", "q")).cast("int").alias("normalized"))


_ST = lambda c: f"list_transform({lines_sql(c)}, lambda x: {strip_sql('x')})"
_LL = lambda c: f"list_filter({_ST(c)}, lambda x: length(x) >= 10)"


@query(f"WITH {_P}, f AS (SELECT id, {_LL('q')} AS a, list_filter({_ST('q')}, lambda x: x <> '') AS b, list_distinct({_ST('s')}) AS s FROM p), l AS (SELECT id, CASE WHEN len(a) > 0 THEN a ELSE b END AS q, s FROM f) SELECT id, len(q)::BIGINT AS total, len(list_filter(q, lambda x: list_contains(s, x)))::BIGINT AS matched FROM l")
def line_overlap(spark, sf_dir):
    """Lines of ten characters or more that the source has too; all filled lines where none is that long."""
    at = lambda c: F.transform(text.lines(c), text.strip)
    p = snippets(spark, sf_dir, "patch", "patch").select("id", text.long_lines(at("q")).alias("q"), F.array_distinct(at("s")).alias("s"))
    return p.select("id", F.size("q").cast("long").alias("total"), F.size(F.filter("q", lambda x: F.array_contains(F.col("s"), x))).cast("long").alias("matched"))


def _overlap_sql(left: str, right: str) -> str:
    """Counts of equal elements, each as often as both sides have it."""
    return f"a AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({left}) AS g FROM t) GROUP BY ALL), b AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({right}) AS g FROM t) GROUP BY ALL), o AS (SELECT t.id, coalesce(sum(a.n), 0)::BIGINT AS total, coalesce(sum(least(a.n, coalesce(b.n, 0))), 0)::BIGINT AS matched FROM t LEFT JOIN a USING (id) LEFT JOIN b ON b.id = a.id AND b.g = a.g GROUP BY t.id)"


_CH = lambda c: f"list_filter(list_transform(list_filter({lines_sql(c)}, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR (starts_with(x, '-') AND NOT starts_with(x, '---'))), lambda x: {strip_sql('substring(x, 2)')}), lambda x: length(x) >= 10 AND NOT regexp_matches(x, '{diff.BOILERPLATE}') AND NOT regexp_matches(x, '{diff.SIGNATURE}'))"


@query(f"WITH {_P}, t AS (SELECT id, {_CH('q')} AS q, {_CH('s')} AS s FROM p), {_overlap_sql('q', 's')} SELECT id, total, matched FROM o")
def changed_line_exposure(spark, sf_dir):
    p = snippets(spark, sf_dir, "patch", "patch")
    long = lambda c: F.filter(diff.changed_lines(c), lambda s: F.length(s) >= 10)
    return exposures(p.select("id", long("q").alias("q"), long("s").alias("s")))


_G8 = lambda c: f"CASE WHEN len({c}) >= 8 THEN list_transform(range(1, len({c}) - 6), lambda i: array_to_string({c}[i:i+7], ' ')) ELSE [] END"


@query(f"WITH {_P}, k AS (SELECT id, regexp_extract_all(q, '{text.TOKEN}') AS q, regexp_extract_all(s, '{text.TOKEN}') AS s FROM p), t AS (SELECT id, {_G8('q')} AS q, {_G8('s')} AS s FROM k), {_overlap_sql('q', 's')} SELECT id, total, matched, round(CASE WHEN total > 0 THEN matched / total ELSE 0 END, 6) AS ngram_overlap_8 FROM o")
def exposure_ngram8(spark, sf_dir):
    p = snippets(spark, sf_dir, "patch", "patch").select("id", text.tokens("q").alias("q"), text.tokens("s").alias("s"))
    return exposures(p, 8).withColumn("ngram_overlap_8", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 6)).otherwise(0.0))


@query(f"WITH i AS (SELECT DISTINCT instance_id, patch FROM instances WHERE patch IS NOT NULL), p AS (SELECT instance_id, regexp_extract_all(patch, '{text.TOKEN}') AS t FROM i), d AS (SELECT doc_id, regexp_extract_all(text, '{text.TOKEN}') AS t FROM documents WHERE text IS NOT NULL), a AS (SELECT instance_id, g, count(*) AS n FROM (SELECT instance_id, unnest({_G8('t')}) AS g FROM p) GROUP BY ALL), b AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest({_G8('t')}) AS g FROM d) GROUP BY ALL), n AS (SELECT instance_id, sum(n) AS total FROM a GROUP BY 1), m AS (SELECT instance_id, doc_id, sum(least(a.n, b.n)) AS matched FROM a JOIN b USING (g) GROUP BY ALL) SELECT instance_id, doc_id, total::BIGINT AS total, matched::BIGINT AS matched FROM m JOIN n USING (instance_id) WHERE 2 * matched >= total")
def ngram8_hits(spark, sf_dir):
    """Documents that hold at least half of the eight-token runs of a patch, of all patches and all documents."""
    items = instances(spark, sf_dir, F.col("patch").alias("text")).withColumnRenamed("instance_id", "item_id")
    return containment_join(items, docs(spark, sf_dir, "text")).withColumnRenamed("item_id", "instance_id")


_SH = lambda c: f"CASE WHEN len({c}) = 0 THEN [] WHEN len({c}) < 4 THEN [array_to_string({c}, ' ')] ELSE list_distinct(list_transform(range(1, len({c}) - 2), lambda i: array_to_string({c}[i:i+3], ' '))) END"
_JAC = f"k AS (SELECT id, regexp_extract_all(lower(q), '{text.TOKEN}') AS q, regexp_extract_all(lower(s), '{text.TOKEN}') AS s, contains(s, q) AS v FROM p), t AS (SELECT id, v, {_SH('q')} AS q, {_SH('s')} AS s FROM k), j AS (SELECT id, v, len(list_intersect(q, s)) AS i, len(q) + len(s) AS n FROM t)"


@query(f"WITH {_P}, {_JAC} SELECT id, round(CASE WHEN n = 0 THEN 0 ELSE i / (n - i) END, 6) AS jaccard FROM j")
def shingle_jaccard(spark, sf_dir):
    p = snippets(spark, sf_dir, "patch", "patch")
    return p.select("id", F.round(text.jaccard(text.word_shingles("q"), text.word_shingles("s")), 6).alias("jaccard"))


@query(f"WITH {_P}, c AS (SELECT id, {_COLLAPSE % 'q'} AS q, {_COLLAPSE % 's'} AS s FROM p), t AS (SELECT id, list_transform(range(1, length(q) - 1), lambda i: substring(q, i::INT, 3)) AS q, list_transform(range(1, length(s) - 1), lambda i: substring(s, i::INT, 3)) AS s FROM c), a AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(q) AS g FROM t) GROUP BY ALL), b AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(s) AS g FROM t) GROUP BY ALL), x AS (SELECT id, sum(n * n) AS nn FROM a GROUP BY id), y AS (SELECT id, sum(n * n) AS nn FROM b GROUP BY id), d AS (SELECT id, sum(a.n * b.n) AS dot FROM a JOIN b USING (id, g) GROUP BY id) SELECT id, round(coalesce(dot, 0) / (sqrt(x.nn) * sqrt(y.nn)), 6) AS cosine FROM x JOIN y USING (id) LEFT JOIN d USING (id)")
def char3_cosine(spark, sf_dir):
    p = snippets(spark, sf_dir, "patch", "patch")
    return char_cosine(p).where("cosine is not null").select("id", F.round("cosine", 6).alias("cosine"))


for _name, _prefix, _field in (("text_exposure_statement", "problem_statement", "problem_statement"), ("text_exposure_tests", "test_patch", "test_patch")):

    def _exposure(spark, sf_dir, prefix=_prefix, field=_field):
        p = snippets(spark, sf_dir, prefix, field)
        return p.select("id", F.contains("s", "q").cast("int").alias("verbatim"), F.round(text.jaccard(text.word_shingles("q"), text.word_shingles("s")), 6).alias("jaccard"))

    Q[_name] = _exposure
    SQL[_name] = f"WITH {_pairs_sql(_prefix, _field)}, {_JAC} SELECT id, v::INT AS verbatim, round(CASE WHEN n = 0 THEN 0 ELSE i / (n - i) END, 6) AS jaccard FROM j"

_I = "i AS (SELECT DISTINCT instance_id, patch, test_patch, problem_statement FROM instances)"


@query(rf"WITH {_I} SELECT instance_id, unnest(list_distinct(list_transform(regexp_extract_all(patch, '(?m)^\+\+\+ b/(.+)$', 1), lambda s: {strip_sql('s')}))) AS path FROM i")
def diff_files(spark, sf_dir):
    return instances(spark, sf_dir, "patch").select("instance_id", F.explode(F.array_distinct(diff.files("patch"))).alias("path"))


@query(f"WITH {_I}, l AS (SELECT instance_id, unnest({_CH('patch')}) AS line FROM i) SELECT instance_id, count(*)::BIGINT AS n_changed, count(DISTINCT line)::BIGINT AS n_distinct FROM l GROUP BY instance_id")
def changed_line_counts(spark, sf_dir):
    c = text.once(instances(spark, sf_dir, "patch"), "l", F.filter(diff.changed_lines("patch"), lambda s: F.length(s) >= 10)).where(F.size("l") > 0)
    return c.select("instance_id", F.size("l").cast("long").alias("n_changed"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"))


@query()
def boilerplate_lines(spark, sf_dir):
    """Distinct added lines the patterns leave over that parse as content-free Python; the parser sees each line once."""
    left = instances(spark, sf_dir, "patch").select(F.explode(diff.added_lines("patch")).alias("line")).groupBy("line").agg(F.count("*").alias("uses"))
    return left.where(diff.parsed_boilerplate("line"))


@query(f"WITH {_I}, l AS (SELECT instance_id, {lines_sql('patch')} AS l FROM i WHERE patch IS NOT NULL), p AS (SELECT instance_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM l), g AS (SELECT instance_id, pos, line, sum(starts_with(line, 'diff --git ')::INT) OVER (PARTITION BY instance_id ORDER BY pos) AS grp FROM p), a AS (SELECT DISTINCT instance_id, grp, {strip_sql('substring(line, 2)')} AS t FROM g WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')), s AS (SELECT instance_id, grp, count(*) AS n, max(length(t)) AS longest FROM a WHERE t <> '' GROUP BY ALL) SELECT instance_id, grp::BIGINT AS grp, n::BIGINT AS n_lines, coalesce(CASE WHEN n = 1 THEN CASE WHEN longest >= 40 THEN 1 END WHEN n <= 3 THEN 2 ELSE greatest(3, (n + 1) // 2) END, 0)::BIGINT AS required FROM s")
def line_groups(spark, sf_dir):
    """Added lines by file of the diff, and how many of them a copy must hold; the group number runs within one patch."""
    rows = diff.file_groups(instances(spark, sf_dir, "patch"), "instance_id", "patch", text.strip)
    g = rows.groupBy("instance_id", F.col("grp").cast("long").alias("grp")).agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))
    return g.select("instance_id", "grp", "n_lines", F.coalesce(diff.required_matches(F.col("n_lines"), F.col("longest")), F.lit(0)).cast("long").alias("required"))


_GEN = ", ".join(f"'{w}'" for w in dict.fromkeys(diff.GENERIC))
_PT = f"l AS (SELECT instance_id, {lines_sql('patch')} AS l FROM i WHERE patch IS NOT NULL), ad AS (SELECT instance_id, l, list_transform(list_filter(l, lambda s: starts_with(s, '+') AND NOT starts_with(s, '+++')), lambda s: substring(s, 2)) AS a, len(list_filter(l, lambda s: starts_with(s, 'diff --git ') OR starts_with(s, '+++') OR starts_with(s, '---') OR starts_with(s, '@@'))) > 0 AS isd FROM l), ch AS (SELECT instance_id, CASE WHEN len(a) > 0 THEN a WHEN NOT isd THEN l ELSE [] END AS c FROM ad), tk AS (SELECT instance_id, list_filter(list_distinct(regexp_extract_all(lower(array_to_string(list_filter(list_transform(c, lambda s: {strip_sql('s')}), lambda s: NOT starts_with(s, '#') AND NOT starts_with(s, '//')), ' ')), '[a-z_][\\p{{L}}\\p{{N}}_]{{3,}}')), lambda w: w NOT IN ({_GEN})) AS t FROM ch)"


@query(f"WITH {_I}, {_PT} SELECT instance_id, len(t)::BIGINT AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM tk WHERE len(t) > 0")
def distinctive_tokens(spark, sf_dir):
    t = text.once(instances(spark, sf_dir, "patch").where("patch is not null"), "t", F.array_sort(diff.patch_tokens("patch"))).where(F.size("t") > 0)
    return t.select("instance_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


_FORM = rf"regexp_replace(regexp_replace({_N % 'lower(array_to_string(list_filter(list_transform(LINES, lambda s: STRIP), lambda s: NOT starts_with(s, $$#$$) AND NOT starts_with(s, $$//$$)), $$ $$))'}, '[{text.WS}]*([=+\-*/<>!&|^%,:;()\{{\}}\[\]])[{text.WS}]*', '\1', 'g'), '_{{2,}}', '_', 'g')".replace("$$", "'").replace("LINES", lines_sql("patch")).replace("STRIP", strip_sql("s"))


@query(f"WITH {_I} SELECT instance_id, substring(sha256({_FORM}), 1, 16) AS content_hash FROM i WHERE patch IS NOT NULL")
def patch_content_hash(spark, sf_dir):
    return instances(spark, sf_dir, "patch").where("patch is not null").select("instance_id", F.substring(F.sha2(text.search_form("patch"), 256), 1, 16).alias("content_hash"))


def _patch_sets(spark, sf_dir):
    return text.once(instances(spark, sf_dir, "patch").where("patch is not null"), "tokens", diff.patch_tokens("patch")).select(F.col("instance_id").alias("id"), "tokens")


def _code_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("kind = 'source_file' and text is not null").select("doc_id", "text")
    return text.once(spread(d), "tokens", diff.distinctive_tokens(text.lines("text"))).select(F.col("doc_id").alias("id"), "tokens")


_SALTS = "s AS (SELECT i, unhex(x) AS salt FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(minhash.salts())) + ") v(i, x))"
_HASH = "array_to_string(list_reverse(list_transform(range(0, 8), lambda b: h[b*2+1:b*2+2])), '')"
_SIG = f"WITH {_I}, {_PT}, {_SALTS}, d AS (SELECT DISTINCT unnest(t) AS t FROM tk), h AS (SELECT t, i, sha256(salt || encode(t)) AS h FROM d, s), r AS (SELECT t, i, {_HASH} AS h FROM h), u AS (SELECT instance_id, unnest(t) AS t FROM tk), m AS (SELECT instance_id, i, min(h) AS h FROM u JOIN r USING (t) GROUP BY ALL)"


@query(f"{_SIG} SELECT instance_id, string_agg(h, ' ' ORDER BY i) AS sig FROM m GROUP BY instance_id")
def minhash_signature(spark, sf_dir):
    """The signatures of the patches' distinctive tokens, all slots."""
    sig = minhash.signatures(_patch_sets(spark, sf_dir), "id", "tokens")
    return sig.select(F.col("id").alias("instance_id"), F.array_join(minhash.hex_hashes(F.col("sig")), " ").alias("sig"))


@query(f"{_SIG}, b AS (SELECT instance_id, i // {minhash.ROWS} AS band, '(' || string_agg(('0x' || h)::UBIGINT::VARCHAR, ', ' ORDER BY i) || ')' AS t FROM m GROUP BY ALL) SELECT instance_id, band::INT AS band, substring(sha256(t), 1, 16) AS band_hash FROM b")
def minhash_bands(spark, sf_dir):
    """The band hashes of each signature."""
    sig = minhash.signatures(_patch_sets(spark, sf_dir), "id", "tokens")
    return sig.select(F.col("id").alias("instance_id"), F.posexplode(minhash.band_hashes(F.col("sig"))).alias("band", "band_hash"))


_CODE = f"cd AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(array_to_string(list_filter(list_transform({lines_sql('text')}, lambda s: {strip_sql('s')}), lambda s: NOT starts_with(s, '#') AND NOT starts_with(s, '//')), ' ')), '[a-z_][\\p{{L}}\\p{{N}}_]{{3,}}')), lambda w: w NOT IN ({_GEN})) AS t FROM documents WHERE kind = 'source_file' AND text IS NOT NULL)"


@query(f"WITH {_I}, {_PT}, {_CODE}, a AS (SELECT instance_id, len(t) AS n, unnest(t) AS w FROM tk WHERE len(t) >= 3), b AS (SELECT doc_id, len(t) AS m, unnest(t) AS w FROM cd WHERE len(t) >= 3), c AS (SELECT instance_id, doc_id, n, m, count(*) AS k FROM a JOIN b USING (w) GROUP BY ALL), j AS (SELECT instance_id, doc_id, k / (n + m - k) AS s FROM c WHERE k / (n + m - k) >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY s DESC, doc_id) AS rank FROM j) SELECT instance_id, doc_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def lsh_content_match(spark, sf_dir):
    """Source files whose distinctive tokens resemble those of a patch, the ten most alike of each."""
    m = minhash.content_matches(_patch_sets(spark, sf_dir), _code_sets(spark, sf_dir))
    return m.select(F.col("left_id").alias("instance_id"), F.col("right_id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), "rank")


BLOOM_N, BLOOM_P = 7_000_000, 0.001
_M, _K = bloom.sizing(BLOOM_N, BLOOM_P)
_WORD = lambda at: f"('0x' || array_to_string(list_reverse(list_transform(range(0, 8), lambda b: h[{at} + b*2:{at} + b*2 + 1])), ''))::UBIGINT::HUGEINT"
_POS = lambda src: f"(SELECT repo, ((h1 + i * h2) % {_M})::BIGINT AS pos FROM (SELECT repo, {_WORD(1)} AS h1, {_WORD(17)} AS h2 FROM (SELECT repo, sha256(repo) AS h FROM (SELECT DISTINCT {REPO} AS repo FROM {src} WHERE repo IS NOT NULL))), range(0, {_K}) r(i))"


@query(f"SELECT repo, count(DISTINCT pos)::BIGINT AS n_positions, min(pos) AS low, max(pos) AS high FROM {_POS('repos')} GROUP BY repo")
def bloom_positions(spark, sf_dir):
    keys = table(spark, sf_dir, "repos").select(canonical_repo("repo").alias("repo")).distinct().withColumn("p", bloom.positions(F.col("repo"), _M, _K))
    return keys.select("repo", F.size(F.array_distinct("p")).cast("long").alias("n_positions"), F.array_min("p").alias("low"), F.array_max("p").alias("high"))


@query(f"WITH b AS (SELECT DISTINCT pos FROM {_POS('repos')}) SELECT repo, bool_and(pos IN (SELECT pos FROM b))::INT AS member FROM {_POS('documents')} GROUP BY repo")
def bloom_membership(spark, sf_dir):
    bits = bloom.build(table(spark, sf_dir, "repos").select(canonical_repo("repo").alias("repo")), "repo", _M, _K)
    found = bloom.probe(table(spark, sf_dir, "documents").select(canonical_repo("repo").alias("repo")), "repo", bits, _M, _K)
    return found.select(F.col("key").alias("repo"), F.col("member").cast("int").alias("member"))


@query(f"SELECT DISTINCT {REPO} AS repo FROM documents WHERE {REPO} IN (SELECT {REPO} FROM repos)")
def repo_semi_join(spark, sf_dir):
    known = table(spark, sf_dir, "repos").select(canonical_repo("repo").alias("repo")).distinct()
    return table(spark, sf_dir, "documents").select(canonical_repo("repo").alias("repo")).distinct().join(known, "repo", "left_semi")


@query(f"WITH b AS (SELECT count(DISTINCT pos)::BIGINT AS bits_set FROM {_POS('repos')}) SELECT m, k, bits_set, round(power(bits_set / m, k), 12) AS fill_rate, round(power(1 - exp(-k * {BLOOM_N} / m), k), 12) AS expected_rate FROM b, (SELECT m, greatest(1, trunc(m / {BLOOM_N} * ln(2)))::BIGINT AS k FROM (SELECT greatest(64, trunc(-{BLOOM_N} * ln({BLOOM_P}) / power(ln(2), 2)))::BIGINT AS m))")
def bloom_stats(spark, sf_dir):
    bits = bloom.build(table(spark, sf_dir, "repos").select(canonical_repo("repo").alias("repo")), "repo", _M, _K)
    return bits.agg(F.count("*").alias("bits_set")).select(F.lit(_M).cast("long").alias("m"), F.lit(_K).cast("long").alias("k"), "bits_set", F.round(F.pow(F.col("bits_set") / F.lit(_M), F.lit(_K)), 12).alias("fill_rate"), F.round(F.lit(bloom.false_positive_rate(BLOOM_N, _M, _K)), 12).alias("expected_rate"))


_KEYED = r"""(?i)\b(token|password|passwd|secret|api_key|apikey)(\s*[=:]\s*["'']?)([^\s"'',;)]{6,})"""


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '{text.SECRET}', '[SECRET]', 'g'), '{_KEYED}', '\1\2[SECRET]', 'g') AS text FROM documents WHERE text IS NOT NULL")
def secret_redaction(spark, sf_dir):
    return docs(spark, sf_dir, "text").where("text is not null").select("doc_id", text.redact_secrets("text").alias("text"))
