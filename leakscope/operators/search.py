"""Replication search: distinctive identifiers, files that hold all of them, lines that prove a copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import diff, text
from leakscope.functions.text import let, once

#: Fixed value: identifiers too common to search by.
BLOCKED = (
    "data self value none true false null void config model result default settings state status error message return import class def "
    "init test main type name path file code base list dict item key args kwargs obj var func call get set put run new old empty blank "
    "index count size len max min sum avg start end begin stop next prev first last input output src dst tmp buf ptr ref response "
    "request header body url method assert raise except finally with async await print log warn info debug trace"
).split()


def distinctive(token: Column) -> Column:
    """Whether an identifier has an underscore, a digit or twelve letters, and isn't blocked."""
    return ~token.isin(BLOCKED) & (token.contains("_") | token.rlike(r"[0-9]") | (F.length(token) >= 12))


def search_identifiers(patches: DataFrame, n: int = 8, most: int = 5) -> DataFrame:
    """Adds ``ids``: up to five identifiers of the n consecutive tokens of the patch that say most.

    A token counts its length if it is an identifier of five letters or more, 2 if it is a shorter one; the first best
    window wins. If that has under two identifiers of four letters, the first window with most of them is taken.
    Rows with under two distinctive identifiers are left out.
    """
    score = lambda w: F.when(w.rlike(r"^[a-z_][\p{L}\p{N}_]{4,}$"), F.length(w)).when(w.rlike(r"^[a-z_][\p{L}\p{N}_]+$"), F.lit(2)).otherwise(F.lit(0))
    plain = lambda w: w.rlike(r"^[a-z_][\p{L}\p{N}_]{3,}$")

    def sums(values: Column) -> Column:
        """Sums of n consecutive values."""
        return let(values, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.aggregate(F.slice(v, i, n), F.lit(0), lambda x, y: x + y)))

    def best(t: Column, f) -> Column:
        found = let(sums(F.transform(t, f)), lambda s: F.slice(t, F.array_position(s, F.array_max(s)).cast("int"), n))
        return F.when(F.size(t) >= n, found).otherwise(F.array().cast("array<string>"))

    tokens = once(patches, "_t", text.tokens(text.search_form("patch")))
    first = F.filter(best(F.col("_t"), score), plain)
    second = F.filter(best(F.col("_t"), lambda w: plain(w).cast("int")), plain)
    chosen = let(first, lambda a: F.when(F.size(a) >= 2, a).otherwise(second))
    out = once(tokens, "_ids", F.filter(chosen, distinctive)).where(F.size("_ids") >= 2)
    return out.withColumn("ids", F.slice("_ids", 1, most)).drop("_t", "_ids")


def candidate_files(patches: DataFrame, files: DataFrame) -> DataFrame:
    """(instance_id, doc_id) of files of another repository that hold all searched identifiers of a patch.

    The files' words are cut down to identifiers that are searched at all. A patch meets only the files that hold its rarest
    identifier, counted over all files; whether they hold the others is looked up in the file's own set. So a frequent
    identifier never multiplies, and an identifier that no file has ends the search of its patch. Null ids, patches and texts give nothing.
    """
    queries = search_identifiers(patches).select("instance_id", "repo", F.array_distinct("ids").alias("ids")).persist()
    terms = queries.select("instance_id", "repo", "ids", F.explode("ids").alias("w"))
    words = files.select("doc_id", "file_repo", F.explode(F.array_distinct(F.filter(text.words("text"), distinctive))).alias("w"))
    words = words.join(terms.select("w").distinct(), "w", "left_semi").persist()
    known = terms.join(words.groupBy("w").agg(F.count("*").alias("df")), "w")
    rarest = known.groupBy("instance_id", "repo", "ids").agg(F.min_by("w", F.struct("df", "w")).alias("w"), F.count("*").alias("n")).where(F.col("n") == F.size("ids"))
    sets = words.groupBy("doc_id").agg(F.collect_set("w").alias("ws"))
    pairs = rarest.join(words, "w").where(F.coalesce(F.col("file_repo") != F.col("repo"), F.lit(True))).select("instance_id", "ids", "doc_id")
    return pairs.join(sets, "doc_id").where(F.size(F.array_intersect("ids", "ws")) == F.size("ids")).select("instance_id", "doc_id").distinct()


def verified_files(patches: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(instance_id, doc_id, verified, grp, matched, required, first_line, last_line) of each candidate with a common line.

    Lines are compared with white space collapsed. A group of added lines is proved by the number of its distinct lines
    that ``required_matches`` asks for; of the proved groups the first is reported, else the one with most lines found.
    """
    groups = diff.file_groups(patches, "instance_id", "patch", text.collapse)
    sizes = groups.groupBy("instance_id", "grp").agg(diff.required_matches(F.count("*"), F.max(F.length("line"))).alias("required"))
    own = files.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(text.lines("text")).alias("at", "l"))
    lines = own.groupBy("doc_id", text.collapse("l").alias("line")).agg((F.min("at") + 1).alias("at")).where("line != ''")
    found = candidates.join(groups, "instance_id").join(lines, ["doc_id", "line"])
    per = found.groupBy("instance_id", "doc_id", "grp").agg(F.count("*").alias("matched"), F.min("at").alias("first_line"), F.max("at").alias("last_line")).join(sizes, ["instance_id", "grp"])
    ok = F.coalesce(F.col("matched") >= F.col("required"), F.lit(False))
    rank = F.struct(ok.cast("int"), F.when(ok, F.lit(0)).otherwise(F.col("matched")), -F.col("grp"))
    best = per.groupBy("instance_id", "doc_id").agg(F.max_by(F.struct(ok.alias("verified"), "grp", "matched", "required", "first_line", "last_line"), rank).alias("b"))
    return best.select("instance_id", "doc_id", "b.*")


def line_anchor(first: Column, last: Column) -> Column:
    """#L3 or #L3-L9, as forges mark lines in a link; empty without lines."""
    end = F.when(last > first, F.concat(F.lit("-L"), last.cast("string"))).otherwise("")
    return F.coalesce(F.concat(F.lit("#L"), first.cast("string"), end), F.lit(""))
