"""The consensus of four methods on whether a fix stands in a repository now and did not before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import diff, risk, text
from leakscope.operators.substring import substring_join

UNVERIFIABLE = ("head_not_found", "base_not_found_suspect", "base_not_found_clean")


def squeezed(x: Column) -> Column:
    """A byte-order mark, comments to the end of the line and all white space taken out, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^﻿", ""), "#.*$", ""), "//.*$", "")
    return F.lower(F.regexp_replace(bare, rf"[{text.WS}]+", ""))


def statement_chunk(statement: Column) -> Column:
    """The first 200 characters, stripped; null if the statement or the chunk is short or the chunk is mostly code."""
    def of(c):
        code = F.length(c) - F.length(F.translate(c, "(){}[];=<>+-*/|\\`", ""))
        return F.when((F.length(statement) > 50) & (F.length(c) > 30) & (code <= 0.4 * F.length(c)), c)

    return text.let(text.strip(F.substring(statement, 1, 200)), of)


def statement_files(instances: DataFrame, files: DataFrame) -> DataFrame:
    """(instance_id, doc_id) of files that hold the beginning of a statement, as it is or with white space collapsed.

    ``instances`` has (instance_id, problem_statement), ``files`` (doc_id, text).
    """
    c = instances.select(F.col("instance_id").alias("id"), statement_chunk(F.col("problem_statement")).alias("pattern")).where("pattern is not null")
    bare = lambda x: text.collapse(F.translate(x, "#/", "  "))
    match = lambda t, p: F.contains(t, p) | F.contains(bare(t), text.collapse(p))
    hits = substring_join(c, files.select(F.col("doc_id").alias("text_id"), "text"), match=match, form=bare)
    return hits.select(F.col("id").alias("instance_id"), F.col("text_id").alias("doc_id"))


def line_methods(instances: DataFrame, files: DataFrame) -> DataFrame:
    """Per instance and method 1 to 3: added lines, those the repository holds now, and those none of its files held before.

    Methods: lines of the patch, the same squeezed, lines of the test patch. The files' lines are cut once, reduced to the
    first day of each (repository, form, line) with partial aggregation, and meet all methods in one equi-join whose key
    holds the line, so that no repository is hot. ``instances`` has (instance_id, repo, patch, test_patch, day), ``files`` (repo, text, seen).
    """
    form = lambda f, x: F.struct(F.lit(f).alias("form"), x.alias("line"))
    cut = files.where("text is not null and repo is not null").select("repo", "seen", F.explode(text.lines("text")).alias("l")).select("repo", "seen", F.explode(F.array(form("x", text.strip("l")), form("s", squeezed(F.col("l"))))).alias("f"))
    held = cut.select("repo", "f.*", "seen").where("line != ''").groupBy("repo", "form", "line").agg(F.min("seen").alias("seen"), F.lit(1).alias("hit"))
    item = lambda m, f, ls, norm: F.transform(ls, lambda x: F.struct(F.lit(m).alias("method"), F.lit(f).alias("form"), norm(x).alias("line")))
    same = lambda x: x
    added = F.concat(*[F.coalesce(a, F.array()) for a in (item(1, "x", diff.added_lines("patch"), same), item(2, "s", diff.added_lines("patch"), squeezed), item(3, "x", diff.added_lines("test_patch"), same))])
    a = instances.select("instance_id", "repo", "day", F.explode(added).alias("a")).select("instance_id", "repo", "day", "a.*").where("line != ''")
    old = F.coalesce(F.col("seen") < F.col("day"), F.lit(False))
    return a.join(held, ["repo", "form", "line"], "left").groupBy("instance_id", "method").agg(
        F.count("*").alias("lines"), F.count("hit").alias("in_head"), F.count_if(F.col("hit").isNotNull() & ~old).alias("head_only")
    )


def consensus(instances: DataFrame, files: DataFrame) -> DataFrame:
    """One row per instance: what the methods found, how many ran and agree, the verdict and its level.

    Verdicts: no_lines (nothing added), head_not_found (no file of the repository), base_not_found_suspect or _clean (none
    from before the instance's day; nothing is claimed), else contaminated, suspect or clean. Two methods that
    agree, or one with half of the lines found, make it contaminated. ``instances`` as for line_methods with
    problem_statement, ``files`` with doc_id. An instance of any repository comes out exactly once.
    """
    per = line_methods(instances, files)
    pick = lambda m, c: F.coalesce(F.max(F.when(F.col("method") == m, F.col(c))), F.lit(0))
    wide = per.groupBy("instance_id").agg(*[pick(m, c).alias(f"{c}_{m}") for m in (1, 2, 3) for c in ("lines", "in_head", "head_only")])
    first = files.where("repo is not null and text is not null").groupBy("repo").agg(F.count("*").alias("head_files"), F.min("seen").alias("first_seen"))
    own = files.where("repo is not null").select("doc_id", F.col("repo").alias("file_repo"))
    m4 = statement_files(instances, files).join(own, "doc_id").join(instances.select("instance_id", "repo"), "instance_id").where("repo = file_repo").select("instance_id", F.lit(True).alias("m4")).distinct()
    j = instances.select("instance_id", "repo", "day", F.length("problem_statement").alias("chars")).join(wide, "instance_id", "left").join(first, "repo", "left").join(m4, "instance_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    statement, found4 = F.coalesce(F.col("chars") > 50, F.lit(False)), F.coalesce("m4", F.lit(False))
    hits = [n(f"head_only_{m}") > 0 for m in (1, 2, 3)] + [found4]
    j = j.withColumn("detected", sum((h.cast("int") for h in hits), F.lit(0))).withColumn("run", F.lit(2) + (n("lines_3") > 0).cast("int") + statement.cast("int"))
    base = F.coalesce(F.col("first_seen") < F.col("day"), F.lit(False))
    state = F.when(n("lines_1") == 0, "no_lines").when(n("head_files") == 0, "head_not_found").when(~base & (n("in_head_1") > 0), "base_not_found_suspect").when(~base, "base_not_found_clean")
    counted = state.isNull()
    found = F.when(counted, n("head_only_1")).when(state.startswith("base"), n("in_head_1")).otherwise(0)
    rate = F.when(n("lines_1") > 0, found / F.col("lines_1")).otherwise(0.0)
    guilty = (F.col("detected") >= 2) | ((F.col("detected") == 1) & (rate >= 0.5))
    verdict = F.coalesce(state, F.when(guilty, "contaminated").when(F.col("detected") == 1, "suspect").otherwise("clean"))
    when = lambda c: F.when(counted, c).otherwise(0)
    out = j.select(
        "instance_id", "repo", found.alias("m1"), when(n("head_only_2")).alias("m2"), when(n("head_only_3")).alias("m3"), when(found4.cast("int")).alias("m4"),
        when(F.col("detected")).alias("detected"), when(F.col("run")).alias("run"), F.round(rate, 6).alias("exposure"), verdict.alias("verdict"),
    )
    confidence = F.when(F.col("run") > 0, F.col("detected") / F.col("run")).otherwise(0.0)
    return out.withColumn("risk", risk.pro_risk(F.col("verdict") == "contaminated", confidence, F.col("exposure")))
