"""Text functions as Column expressions: lines, words, grams, normal forms. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
WORD = r"[\p{L}\p{N}_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once per row, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def once(df: DataFrame, name: str, x: Column) -> DataFrame:
    """Adds a column that later filters use as it is: the optimizer can't move them below and compute it again."""
    return df.select("*", F.explode(F.array(x)).alias(name))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), rf"^[{WS}]+|[{WS}]+$", "")


def collapse(x: Column | str) -> Column:
    """White space runs become one blank; none at either end."""
    return strip(F.regexp_replace(_c(x), rf"[{WS}]+", " "))


def lines(x: Column | str) -> Column:
    """The lines of a text without their ends; an end at the very end starts no further line, and '' has none."""
    return let(F.split(_c(x), LINE_END, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def long_lines(ls: Column, least: int = 10) -> Column:
    """The lines of at least so many characters; all filled ones if there is none."""
    def of(v):
        return let(F.filter(v, lambda s: F.length(s) >= least), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.filter(v, lambda s: s != "")))

    return let(ls, of)


def tokens(x: Column | str) -> Column:
    """Words and single other signs."""
    return F.regexp_extract_all(_c(x), F.lit(TOKEN), F.lit(0))


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(WORD), F.lit(0))


def grams(arr: Column, n: int) -> Column:
    """All n consecutive elements joined by a blank; none if there are fewer."""
    def of(t):
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(arr, of)


def word_shingles(x: Column | str, n: int = 4) -> Column:
    """Distinct n-word runs of the lower-cased tokens; a shorter text is one shingle, an empty one none."""
    def of(t):
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(grams(t, n)))

    return let(tokens(F.lower(_c(x))), of)


def char_grams(x: Column | str, n: int = 3) -> Column:
    """Runs of n characters of the lower-cased text with white space collapsed, of the whole text."""
    def of(c):  # an array of characters, since a substring of a long text counts characters from its start each time
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(collapse(F.lower(_c(x))), F.lit("(?s)."), F.lit(0)), of)


def search_form(x: Column | str) -> Column:
    """Comment lines dropped, lower case, blanks collapsed and taken away around signs, underscores single."""
    kept = F.filter(F.transform(lines(x), strip), lambda s: ~s.startswith("#") & ~s.startswith("//"))
    t = collapse(F.lower(F.array_join(kept, " ")))
    return F.regexp_replace(F.regexp_replace(t, rf"[{WS}]*([=+\-*/<>!&|^%,:;(){{}}\[\]])[{WS}]*", "$1"), r"_{2,}", "_")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    counts = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("both"), (F.size(s["a"]) + F.size(s["b"])).alias("sum")))
    return let(counts, lambda s: F.when(s["sum"] == 0, F.lit(0.0)).otherwise(s["both"] / (s["sum"] - s["both"])))


SECRET = r"(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})"


def redact_secrets(x: Column | str) -> Column:
    """Access tokens of well-known forms and values after token=, password= and the like become [SECRET]."""
    t = F.regexp_replace(_c(x), SECRET, "[SECRET]")
    return F.regexp_replace(t, r"(?i)\b(token|password|passwd|secret|api_key|apikey)(\s*[=:]\s*[\"']?)([^\s\"',;)]{6,})", "$1$2[SECRET]")
