"""Queries of the training-data operators and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.leaks import leaks, reparameterised
from leakscope.llm.mixing import mix, mixture_report
from leakscope.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from leakscope.llm.packing import exchange_report, pack, packing_report
from leakscope.llm.personal_data import personal_data, redacted
from leakscope.llm.sentences import sentences
from leakscope.llm.shared_spans import shared_share, shared_span_pairs
from leakscope.llm.tokens import token_counts
from leakscope.session import table

FIELDS = ("patch", "test_patch", "problem_statement")
#: The name list is a fixed table; a longer one than this is refused.
MAX_NAMES = 10_000


def name_list(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    rows = table(spark, sf_dir, "known_names").where("name is not null").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"known_names has more than {MAX_NAMES} rows")
    return [(r.name, r.name_part) for r in rows]


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = table(spark, sf_dir, "instances")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    return inst.select(F.col("instance_id").alias("item_id"), F.explode(fields).alias("x")).select("item_id", "x.field", "x.text")


def p1_found(spark, sf_dir):
    pairs = near_duplicate_pairs(table(spark, sf_dir, "instances"), "instance_id", "patch", words=3, threshold=0.6)
    return pairs.select(F.col("id_a").alias("instance_id_a"), F.col("id_b").alias("instance_id_b"))


def p1_groups(spark, sf_dir):
    return near_duplicate_groups(table(spark, sf_dir, "instances"), "instance_id", "patch", words=3, threshold=0.6).withColumnRenamed("id", "instance_id")


def p3_found(spark, sf_dir):
    found = leaks(eval_items(spark, sf_dir), table(spark, sf_dir, "documents"), [n for n, _ in name_list(spark, sf_dir)])
    return found.select("doc_id", F.col("item_id").alias("instance_id"), "field")


def p3_reparameterised(spark, sf_dir):
    found = reparameterised(eval_items(spark, sf_dir), table(spark, sf_dir, "documents"), [n for n, _ in name_list(spark, sf_dir)])
    return found.withColumnRenamed("item_id", "instance_id")


def personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "instances").select(F.lit("instances").alias("src"), F.col("instance_id").alias("key"), F.col("problem_statement").alias("text"))
    two = table(spark, sf_dir, "evidence").select(F.lit("evidence").alias("src"), F.col("evidence_id").cast("string").alias("key"), F.col("evidence_snippet").alias("text"))
    return one.union(two)


def p4_found(spark, sf_dir):
    found = personal_data(personal_texts(spark, sf_dir), name_list(spark, sf_dir))
    return found.select(F.col("src").alias("src_table"), F.col("key").alias("rec_key"), F.col("kind").alias("pii_kind"), F.col("s").alias("start_pos"))


def p4_redacted(spark, sf_dir):
    return redacted(personal_texts(spark, sf_dir), name_list(spark, sf_dir)).withColumnsRenamed({"src": "src_table", "key": "rec_key"})


def p5_found(spark, sf_dir):
    pairs = shared_span_pairs(table(spark, sf_dir, "instances"), "instance_id", "patch", 200)
    return pairs.select(F.col("id_a").alias("instance_id_a"), F.col("id_b").alias("instance_id_b"))


def p5_shared(spark, sf_dir):
    return shared_share(table(spark, sf_dir, "instances"), "instance_id", "patch", 200).withColumnRenamed("id", "instance_id")


def _bins(spark, sf_dir):
    return table(spark, sf_dir, "bins").withColumnRenamed("capacity_tokens", "capacity")


def _packed(spark, sf_dir):
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), _bins(spark, sf_dir))


def p6_packed(spark, sf_dir):
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_report(spark, sf_dir):
    return packing_report(_packed(spark, sf_dir).persist(), _bins(spark, sf_dir))


def p6_exchange(spark, sf_dir):
    """The rounds of the exchange where groups are small: about 200 items each, so that many stay above their bound."""
    return exchange_report(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), _bins(spark, sf_dir), 200)


def p7_mixture(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


def p7_shares(spark, sf_dir):
    return mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


PROSE = ("guide", "release_notes", "forum_post", "issue_comment")


def p8_found(spark, sf_dir):
    found = sentences(table(spark, sf_dir, "documents").where(F.col("kind").isin(*PROSE)), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "end_pos")


def p8_sentences(spark, sf_dir):
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_reparameterised, p4_found, p4_redacted, p5_found, p5_shared, p6_packed, p6_report, p6_exchange, p7_mixture, p7_shares, p8_found, p8_sentences)}
_W = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+')"


def _grams(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))) ELSE [] END"


SQL: dict[str, str] = {
    "p1_found": f"WITH i AS (SELECT DISTINCT instance_id, {_W % 'patch'} AS w FROM instances), s AS (SELECT instance_id, {_grams('w', 3)} AS g FROM i), n AS (SELECT instance_id, len(g) AS n FROM s), u AS (SELECT instance_id, unnest(g) AS g FROM s), c AS (SELECT a.instance_id AS x, b.instance_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.instance_id < b.instance_id GROUP BY ALL) SELECT x AS instance_id_a, y AS instance_id_b FROM c JOIN n a ON a.instance_id = x JOIN n b ON b.instance_id = y WHERE k >= 0.6 * (a.n + b.n - k)",
    "p1_groups": f"WITH RECURSIVE i AS (SELECT DISTINCT instance_id, {_W % 'patch'} AS w FROM instances), s AS (SELECT instance_id, list_sort({_grams('w', 3)}) AS g FROM i WHERE len(w) >= 3), k AS (SELECT min(instance_id) AS class_id, count(*) AS class_size, g FROM s GROUP BY g), u AS (SELECT class_id, len(g) AS n, unnest(g) AS g FROM k), c AS (SELECT a.class_id AS x, b.class_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL), e AS (SELECT x, y FROM c WHERE k >= 0.6 * (n + m - k)), r AS (SELECT class_id AS x, class_id AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), t AS (SELECT x, min(y) AS group_id FROM r GROUP BY x), d AS (SELECT x, count(*) AS links FROM e GROUP BY x) SELECT instance_id, class_id, class_size::BIGINT AS class_size, coalesce(links, 0)::BIGINT AS links, group_id FROM s JOIN k USING (g) JOIN t ON t.x = class_id LEFT JOIN d ON d.x = class_id",
    "p5_shared": "WITH i AS (SELECT DISTINCT instance_id, patch, md5(patch) AS p FROM instances WHERE length(patch) >= 200), t AS (SELECT p, any_value(patch) AS patch, count(*) AS copies FROM i GROUP BY p), u AS (SELECT p, k, md5(substring(patch, k::INT, 200)) AS h FROM (SELECT p, patch, unnest(range(1, length(patch) - 198)) AS k FROM t)), s AS (SELECT h FROM u GROUP BY h HAVING count(DISTINCT p) > 1), v AS (SELECT p, k, lead(k) OVER w AS after, lag(k) OVER w AS before FROM u JOIN s USING (h) WINDOW w AS (PARTITION BY p ORDER BY k)), c AS (SELECT p, sum(least(200, coalesce(after - k, 200))) AS shared, count(*) FILTER (before IS NULL OR k - before > 200) AS stretches FROM v GROUP BY p) SELECT instance_id, length(i.patch)::INT AS n_chars, CASE WHEN copies > 1 THEN length(i.patch) ELSE shared END::BIGINT AS shared_chars, round(CASE WHEN copies > 1 THEN length(i.patch) ELSE shared END / length(i.patch), 6) AS shared_share, CASE WHEN copies > 1 THEN 1 ELSE stretches END::BIGINT AS stretches FROM i JOIN t USING (p) LEFT JOIN c USING (p) WHERE copies > 1 OR shared IS NOT NULL",
    "p3_found": "WITH i AS (" + " UNION ".join(f"SELECT DISTINCT instance_id, '{f}' AS field, {_W % f} AS w FROM instances" for f in FIELDS) + f"), d AS (SELECT doc_id, {_W % 'text'} AS w FROM documents), fi AS (SELECT instance_id, field, len(w) AS nw, {_grams('w', 5)} AS g, {_grams('w', 20)} AS h FROM i), fd AS (SELECT doc_id, {_grams('w', 5)} AS g, {_grams('w', 20)} AS h FROM d), a AS (SELECT instance_id, field, len(g) AS n, unnest(g) AS g FROM fi WHERE nw >= 40), b AS (SELECT doc_id, unnest(g) AS g FROM fd), x AS (SELECT doc_id, instance_id, field FROM a JOIN b USING (g) GROUP BY doc_id, instance_id, field, n HAVING 2 * count(*) >= n), y AS (SELECT DISTINCT doc_id, instance_id, field FROM (SELECT instance_id, field, unnest(h) AS h FROM fi) JOIN (SELECT doc_id, unnest(h) AS h FROM fd) USING (h)) SELECT * FROM x UNION SELECT * FROM y",
    "p5_found": "WITH i AS (SELECT DISTINCT instance_id, patch FROM instances WHERE length(patch) >= 200), u AS (SELECT DISTINCT instance_id, md5(substring(patch, k::INT, 200)) AS h FROM (SELECT instance_id, patch, unnest(range(1, length(patch) - 198)) AS k FROM i)) SELECT DISTINCT a.instance_id AS instance_id_a, b.instance_id AS instance_id_b FROM u a JOIN u b ON a.h = b.h AND a.instance_id < b.instance_id",
}
