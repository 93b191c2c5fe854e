import json

import pytest
from pyspark.sql import functions as F

from leakscope.plans import report as R
from leakscope.plans.audit import AuditConfig, audit, evidence_rows
from leakscope.sources.instances import check_required, column_names, find_dataset, group_key, head, largest_file, normalise, read_rows, read_shards, resolve, sample_size, whole_number
from leakscope.streaming.replication import watch_files

I = "instance_id string, repo string, patch string, test_patch string, problem_statement string, pr_number int"
BODY = "diff --git a/m.py b/m.py\n+++ b/m.py\n+    total = compute_total(values, weights)\n+    return normalise_result(total)\n"


def frames(spark, rows, diffs):
    i = spark.createDataFrame(rows, I)
    d = spark.createDataFrame(diffs, "repo string, pr_number int, diff_text string")
    return i, d, spark.createDataFrame([("o/r",)], "repo string")


def test_missing_diffs_are_rows(spark):
    i, d, m = frames(spark, [(f"x-{k}", "o/r", BODY, "", "", k) for k in range(5)], [])
    got = audit(i, d, m).collect()
    assert len(got) == 5 and all(r.not_evaluated and r.risk == "clean" for r in got)


def test_solution_mode_counts_as_evaluated(spark):
    i, d, m = frames(spark, [("Func/0", "unknown/repo", "def f(x):\n    return x + 1\n", "", "Add one.", None)], [])
    assert [r.not_evaluated for r in audit(i, d, m, AuditConfig(mode="solution")).collect()] == [False]


def test_signals(spark):
    spaced = BODY.replace("    ", "  \t ")
    other = "diff --git a/q.py b/q.py\n+++ b/q.py\n+unrelated = 17\n"
    rows = [("a", "o/r", BODY, "", "", 1), ("b", "o/r", BODY, "", "", 2), ("c", "p/q", BODY, "", "", 3), ("d", "p/q", "", "", "", 4), ("a", "o/r", BODY, "", "", 1)]
    i, d, m = frames(spark, rows, [("o/r", 1, "head\n" + BODY), ("o/r", 2, spaced), ("p/q", 3, other), ("p/q", 4, other)])
    risks = audit(i, d, m).persist()
    got = {r.instance_id: r for r in risks.collect()}
    assert len(got) == risks.count() == 4
    assert got["a"].verbatim_match and got["a"].patch_exposure == 1 and got["a"].risk == "critical" and got["a"].ngram_overlap_8 == 1
    assert not got["b"].verbatim_match and got["b"].normalized_match
    assert got["c"].risk in ("clean", "low") and not got["c"].normalized_match and got["d"].risk == "clean"
    for r in got.values():
        assert all(0 <= r[c] <= 1.0000001 for c in ("patch_exposure", "jaccard_similarity", "ngram_overlap_8", "embedding_similarity"))
    kinds = {(r.instance_id, r.match_type) for r in evidence_rows(risks).collect()}
    assert ("a", "patch_verbatim") in kinds and ("a", "repo_in_training_corpus") in kinds and not {k for k in kinds if k[0] == "d"}


def test_copies_behind_the_first_megabyte(spark):
    spaced = BODY.replace("    ", "  \t ")
    i, d, m = frames(spark, [("a", "o/r", BODY, "", "", 1)], [("o/r", 1, "+ab\n" * 260_000 + spaced)])
    r = audit(i, d, m).first()
    assert not r.verbatim_match and r.ngram_overlap_8 == 1 and r.jaccard_similarity > 0.5


def test_all_signals_reach_the_verdict(spark):
    """Content, copies elsewhere, the cutoff before and after them, and an instance whose diff is missing."""
    other = "diff --git a/q.py b/q.py\n+++ b/q.py\n+unrelated = 17\n"
    ids = ["content", "copies", "late", "gone", "gone_many", "plain"]
    i, d, m = frames(spark, [(k, "p/q", BODY, "", "", n) for n, k in enumerate(ids)], [("p/q", n, other) for n in (0, 1, 2, 5)])
    content = spark.createDataFrame([("content", 0.4, 2), ("gone", 0.9, 1)], "instance_id string, similarity double, matches int")
    copies = spark.createDataFrame([("copies", 1, 1, 0), ("late", 4, 4, 0), ("gone_many", 3, 3, 0)], "instance_id string, independent_hits int, non_vendor_hits int, vendor_like_hits int")
    dates = spark.createDataFrame([("p/q", 2, "2024-03-14T23:00:00-05:00"), ("p/q", 2, None)], "repo string, pr_number int, merged_at string")
    risks = audit(i, d, m, merge_dates=dates, content=content, replication=copies).persist()
    got = {r.instance_id: r for r in risks.collect()}
    assert {k: r.risk for k, r in got.items()} == {"content": "medium", "copies": "high", "late": "high", "gone": "medium", "gone_many": "critical", "plain": got["plain"].risk}
    assert {k for k, r in got.items() if r.not_evaluated} == {"gone", "gone_many"} and got["late"].risk_5 == "critical"
    assert {k: r.top_match for k, r in got.items() if k != "plain"} == {"content": "codeseal_content_hit", "copies": "independent_source_hit", "late": "independent_source_hit", "gone": "codeseal_content_hit", "gone_many": "independent_source_hit"}
    kinds = {(r.instance_id, r.match_type) for r in evidence_rows(risks).collect()}
    assert {("content", "codeseal_content_hit"), ("copies", "independent_source_hit"), ("gone_many", "independent_source_hit")} <= kinds


def test_circular_match(spark):
    from leakscope.plans.audit import circular

    rows = [(BODY, BODY), (BODY, "x\n" * 25 + BODY), ("total", "total\nno diff"), ("", BODY), (None, BODY), (BODY, None)]
    df = spark.createDataFrame(rows, "p string, s string")
    assert [r[0] for r in df.select(circular(F.col("p"), F.col("s"))).collect()] == [True, False, False, False, False, False]


def test_consensus(spark):
    from leakscope.plans.consensus import consensus

    line = "    total = compute_total(values, weights)"
    patch = f"diff --git a/m.py b/m.py\n+++ b/m.py\n+{line}\n+    checked = verify_total(total, limit)\n"
    words = "The total is wrong whenever the weights are given in another order than the values are."
    rows = [("new", "a/a", patch, "+++ b/t\n+assert compute_total(one, two) == 3\n", words), ("old", "b/b", patch, "", ""), ("nobase", "c/c", patch, "", ""), ("nohead", "d/d", patch, "", ""), ("empty", "a/a", "", "", words), ("half", "e/e", patch, None, None)]
    i = spark.createDataFrame(rows, "instance_id string, repo string, patch string, test_patch string, problem_statement string").withColumn("day", F.lit("2024-01-10").cast("date"))
    body = f"def f():\n{line}\n    checked   = verify_total(total, limit)\nassert compute_total(one, two) == 3\n# {words}\n"
    files = [(1, "a/a", "nothing", "2023-01-01"), (2, "a/a", body, "2024-05-01"), (3, "b/b", body, "2023-01-01"), (4, "c/c", body, "2024-05-01"), (5, "e/e", "x", "2023-01-01"), (6, "e/e", line, "2024-02-01"), (7, None, body, None)]
    d = spark.createDataFrame(files, "doc_id long, repo string, text string, seen string").withColumn("seen", F.col("seen").cast("date"))
    got = {r.instance_id: r for r in consensus(i, d).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"new": "contaminated", "old": "clean", "nobase": "base_not_found_suspect", "nohead": "head_not_found", "empty": "no_lines", "half": "contaminated"}
    assert (got["new"].m1, got["new"].m2, got["new"].m3, got["new"].m4, got["new"].detected, got["new"].run, got["new"].risk) == (1, 2, 1, 1, 4, 4, "critical")
    assert got["half"].exposure == 0.5 and got["half"].detected == 2 and got["nobase"].risk == "clean" and consensus(i.limit(0), d).count() == 0


def test_threshold_is_checked():
    for bad in (0.05, 1.5):
        with pytest.raises(ValueError):
            AuditConfig(threshold=bad)


def test_reports(spark, tmp_path):
    i, d, m = frames(spark, [("a|b", "o/r", BODY, "", "", 1)], [("o/r", 1, BODY)])
    risks = audit(i, d, m)
    made = R.build_report(risks, evidence_rows(risks), "t <1>")
    path = R.write_json(made, tmp_path / "r.json")
    assert R.read_json(path) == json.loads(path.read_text()) == made
    assert "a\\|b" in R.markdown(made) and "t &lt;1&gt;" in R.page(made)
    assert R.read_facts(spark, str(path)).select("instance_id").first()[0] == "a|b"
    assert [f["section"] for f in R.findings(made)][:2] == ["risk", "source"] and R.findings(made | {"total": 0}) == []
    assert "Nothing was audited" in R.markdown(made | {"total": 0}) and "Nothing was audited" in R.page(made | {"total": 0})
    assert made["times"] == {"before": 0, "after": 0, "unknown": 1, "cutoff": "2024-03-15"} and len(made["histogram"]) == 7
    full = made | {"deep": [{"instance_id": "<i>", "repo": "o/r", "risk": "high", "hits": 9}], "histogram": {"1-5": 2}, "not_evaluated": 1, "dropped": 3}
    assert "&lt;i&gt;" in R.page(full) and "## Most copied" in R.markdown(full) and len(R.limitations(full)) == 4 and len(R.recommendations(full)) == 2
    assert [R.safe_url(u) for u in ("https://a.example/b?c", "javascript:x", "http://a b", None, " HTTPS://A.B/c ")] == ["https://a.example/b?c", "", "", "", "HTTPS://A.B/c"]
    assert R.summary_lines(made)[0].startswith("t <1>: 1 instances") and R.summary_lines(made | {"total": 0}) == ["t <1>: nothing was audited"]
    assert [(r.name, r.total) for r in R.read_history(spark, str(tmp_path)).collect()] == [("t <1>", 1)]
    with pytest.raises(ValueError):
        path.write_text("{}") and R.read_json(path)


def test_layouts(spark, tmp_path):
    assert resolve(["Task_ID", "Prompt", "canonical_solution", "test"]) == {"instance_id": "Task_ID", "patch": "canonical_solution", "test_patch": "test", "problem_statement": "Prompt"}
    assert resolve(["id", "instance_id"], {"instance_id": "id"})["instance_id"] == "id"
    known = {"swe": "a", "swe-pro": "b"}
    assert [find_dataset(x, known) for x in ("SWE", "org/swe-pro-v2", "x/swe", "none")] == ["swe", "swe-pro", "swe", None]
    rows = tmp_path / "a.jsonl"
    rows.write_text('{"task_id": 7, "text": "T", "code": "c", "test_list": ["a", "b"]}\n{"task_id": null}\n')
    got = normalise(read_rows(spark, str(rows))).collect()
    assert [(r.instance_id, r.repo, r.patch, r.test_patch, r.problem_statement, r.pr_number) for r in got] == [("7", "unknown/repo", "c", "a\nb", "T", None)]
    nested = tmp_path / "b.jsonl"
    nested.write_text('{"instance_id": "x", "org": "Own", "repo": "Name", "base": {"sha": "s1"}, "fix_patch": "p", "number": "12.0", "extra": 1}\n')
    r = normalise(read_rows(spark, str(nested))).first()
    assert (r.repo, r.base_commit, r.patch, r.pr_number) == ("own/name", "s1", "p", 12)
    both = read_shards(spark, [str(rows), str(nested)])
    assert both.count() == 3
    bad = tmp_path / "c.jsonl"
    bad.write_text('{"id": "1"}\nnot json\n')
    assert read_rows(spark, str(bad), lenient=True).count() == 1
    with pytest.raises(Exception):
        read_rows(spark, str(bad)).collect()
    (tmp_path / "d.json").write_text('\n [{"id": "1"},\n {"id": "2"}]')
    (tmp_path / "e.json").write_text('{"id": "1"}\n{"id": "2"}\n{"id": "3"}\n')
    assert read_rows(spark, str(tmp_path / "d.json")).count() == 2 and read_rows(spark, str(tmp_path / "e.json")).count() == 3
    assert largest_file(spark, str(tmp_path)).endswith("b.jsonl") and column_names(spark, str(tmp_path / "d.json")) == ["id"]
    assert [sample_size(x) for x in ("5", " ", None, 7)] == [5, None, None, 7]
    for wrong in ("0", "-3", "x", 0):
        with pytest.raises(ValueError):
            sample_size(wrong)
    with pytest.raises(ValueError, match="base_commit"):
        check_required(["id", "project", "answer"], "consensus")
    check_required(["id", "project", "answer"], "pr_diff")
    assert resolve(["task_id", "id", "prompt", "description", "test", "tests"]) == {"instance_id": "id", "problem_statement": "description", "test_patch": "tests"}
    keys = spark.createDataFrame([("py", "o", "r"), ("", "", "p/q"), (None, None, None)], "lang string, org string, repo string")
    assert [r[0] for r in keys.select(group_key(keys)).collect()] == ["py/o/r", "p/q", "__all__"]
    assert [r.x for r in head(spark.range(20).withColumnRenamed("id", "x"), ["x"], 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        read_rows(spark, "x.csv")
    with pytest.raises(ValueError):
        normalise(spark.createDataFrame([("a",)], "zzz string"))
    assert [x[0] for x in spark.createDataFrame([("12.0",), ("x",), (" 3 ",), (None,)], "t string").select(whole_number(F.col("t"))).collect()] == [12, None, 3, None]


def test_stream_of_files(spark, tmp_path):
    code = ["    total_exposure = compute_total(weighted_values, instance_weights)", "    return normalise_result(total_exposure, weighted_values)"]
    patches = spark.createDataFrame([("i1", "o/r", "diff --git a/m.py b/m.py\n+++ b/m.py\n" + "".join(f"+{c}\n" for c in code))], "instance_id string, repo string, patch string")
    text = "import x\n" + "\n".join(code) + "\n"
    rows = spark.createDataFrame([(1, "p/q", text), (2, "o/r", text), (3, "p/q", "nothing")], "doc_id long, file_repo string, text string").withColumn("crawled_at", F.lit("2024-01-01").cast("timestamp"))
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = watch_files(spark, str(tmp_path / "in"), rows.schema, patches, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [(r.instance_id, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("i1", 1)]


def test_older_files_of_later_batches_are_searched(spark, tmp_path):
    code = ["    total_exposure = compute_total(weighted_values, instance_weights)", "    return normalise_result(total_exposure, weighted_values)"]
    patches = spark.createDataFrame([("i1", "o/r", "diff --git a/m.py b/m.py\n+++ b/m.py\n" + "".join(f"+{c}\n" for c in code))], "instance_id string, repo string, patch string")
    text = "import x\n" + "\n".join(code) + "\n"
    where = [str(tmp_path / x) for x in ("in", "out", "ck")]
    for day, new in (("2024-06-01", [1, 2]), ("2023-01-01", [2, 3, 4]), ("2025-01-01", [1, 4, 5]), (None, [6])):
        rows = spark.createDataFrame([(k, "p/q", text) for k in new], "doc_id long, file_repo string, text string").withColumn("crawled_at", F.lit(day).cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(where[0])
        watch_files(spark, where[0], rows.schema, patches, *where[1:]).awaitTermination(120)
    assert sorted((r.doc_id, r.batch) for r in spark.read.parquet(where[1]).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 3)]
