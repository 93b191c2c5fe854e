import re

import pytest
from pyspark.sql import functions as F

from leakscope.functions import diff, links, risk, text
from leakscope.functions.repos import canonical_repo

TRICKY = ["", " ", "a", "a\n", "a\r\nb\rc", "x\x85y z ", "\n\n", "été  naïve_1 汉字, İ!", "a\tb \x1c c", "tail 　", "return x  # y"]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_lines_and_strip_agree_with_python(spark):
    assert column(spark, TRICKY, text.lines) == [t.splitlines() for t in TRICKY]
    assert column(spark, TRICKY, text.strip) == [t.strip() for t in TRICKY]
    assert column(spark, TRICKY, text.collapse) == [" ".join(t.split()) for t in TRICKY]


def test_tokens_and_grams(spark):
    assert column(spark, TRICKY, text.tokens) == [re.findall(r"\w+|[^\w\s]", t) for t in TRICKY]
    arr = [" ".join(map(str, range(n))) for n in (7, 8, 9)]
    assert [len(g) for g in column(spark, arr, lambda c: text.grams(text.tokens(c), 8))] == [0, 1, 2]
    assert column(spark, ["", "A b", "a b c d e"], text.word_shingles) == [[], ["a b"], ["a b c d", "b c d e"]]
    assert column(spark, ["ab", "ABcd", "a  b"], text.char_grams) == [[], ["abc", "bcd"], ["a b"]]


def test_null_text_stays_null_or_empty(spark):
    assert column(spark, [None], text.lines) == [None]
    assert column(spark, [None], canonical_repo) == [None]


PATCH = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+def f(a):\n+    return compute_total(a)\n-    return None\n+pass\n+# note\n old\ndiff --git a/y.go b/y.go\n+++ b/y.go\n+alpha_beta := gammaDelta(3)\n"


def test_diff_parts(spark):
    one = lambda f: column(spark, [PATCH], f)[0]
    assert one(diff.files) == ["x.py", "y.go"]
    assert one(diff.added_lines) == ["return compute_total(a)", "alpha_beta := gammaDelta(3)"]
    assert one(diff.changed_lines) == ["return compute_total(a)", "alpha_beta := gammaDelta(3)"]
    assert sorted(one(diff.patch_tokens)) == ["alpha_beta", "compute_total", "gammadelta"]
    assert column(spark, ["plain_name here", "--- a\n-gone_name"], diff.patch_tokens) == [["plain_name", "here"], []]


def test_file_groups(spark):
    df = spark.createDataFrame([("i", PATCH), ("n", None), ("p", "+a\n+a\n+b")], "id string, patch string")
    got = sorted(tuple(r) for r in diff.file_groups(df, "id", "patch", text.strip).where("length(line) < 12").collect())
    assert got == [("i", 1, "# note"), ("i", 1, "def f(a):"), ("i", 1, "pass"), ("p", 0, "a"), ("p", 0, "b")]


@pytest.mark.parametrize("line,want", [("pass", True), ("return None", True), ("return -1", False), ("return x", False), ("raise pkg.FooError()", False), ("raise ValueError('a')", True), ("async def f():", False), ("async def f(): pass", False), ("x = 0", False), ("", False), ("import os", False)])
def test_parsed_boilerplate(line, want):
    assert diff._parsed_as_boilerplate(line) is want if line else not diff._parsed_as_boilerplate(line)


def test_required_matches(spark):
    df = spark.createDataFrame([(1, 39, None), (1, 40, 1), (2, 5, 2), (3, 5, 2), (4, 5, 3), (7, 5, 4)], "n int, l int, want int")
    assert all(r[0] == r[1] for r in df.select(diff.required_matches(F.col("n"), F.col("l")), "want").collect())


def rule(p, s, t, c):
    top = max(p, s, t)
    return "critical" if p >= 0.95 and c else "high" if p >= 0.95 else "high" if p >= 0.8 and c else "medium" if p >= 0.8 or top >= 0.5 else "low" if top > 0 else "clean"


def test_risk_grid(spark):
    grid = [(p, s, t, c) for p in (0, 0.01, 0.49, 0.5, 0.79, 0.8, 0.94, 0.95, 1) for s in (0.0, 0.5) for t in (0.0, 0.3) for c in (True, False)]
    df = spark.createDataFrame([(float(p), s, t, c) for p, s, t, c in grid], "p double, s double, t double, c boolean")
    base = risk.base_risk(F.col("p"), F.col("s"), F.col("t"), F.col("c"))
    rows = df.select("*", base.alias("r"), risk.after_cutoff(base, F.lit("2024-05-01").cast("date"), F.lit("2024-03-15").cast("date")).alias("late")).collect()
    for r in rows:
        assert r.r == rule(r.p, r.s, r.t, r.c)
        assert risk.LEVELS.index(r.late) <= risk.LEVELS.index(r.r)
    nan = spark.range(1).select(risk.clamp(F.lit(float("nan"))), risk.clamp(F.lit(float("-inf"))), risk.clamp(F.lit(None))).first()
    assert list(nan) == [1.0, 0.0, 0.0]


def test_dates(spark):
    assert [str(x) for x in column(spark, ["2024-03-15T01:02:03Z", "2024-04-01", "07/12/2025", "2024-13-45", None, "2024-4-1"], risk.to_date)] == ["2024-03-15", "2024-04-01", "None", "None", "None", "None"]


def test_char_grams_of_long_texts(spark):
    long = "ab " * 70_000 + "xyz"
    assert column(spark, [long], lambda c: F.array(F.size(text.char_grams(c)), F.array_contains(text.char_grams(c), "xyz").cast("int"))) == [[len(long) - 2, 1]]


def test_link_gate(spark):
    rows = [("", "", "", "missing_url"), ("http://h.example/a/b", "", "", "foreign_host"), ("https://h.example/dummy/b", "", "", "placeholder"), ("https://h.example/a/test-b", "", "", "placeholder"), ("https://h.example/a/b#x", "code_search_x", "", "eligible"), ("https://h.example/a/b", None, None, "not_evidence")]
    df = spark.createDataFrame(rows, "u string, k string, v string, want string")
    assert all(r[0] == r[1] for r in df.select(links.gate(F.col("u"), F.col("k"), F.col("v"), "h.example"), "want").collect())


def test_repo_spellings(spark):
    names = ["Own/Name", " own/name\t", "https://h.example/Own/Name.git", "own/name.git", "own/name/", ""]
    assert column(spark, names, canonical_repo) == ["own/name"] * 5 + [""]


def test_redaction(spark):
    got = column(spark, ["x ghp_" + "a" * 20, 'password = "hunter22"', "passport no"], text.redact_secrets)
    assert got == ["x [SECRET]", 'password = "[SECRET]"', "passport no"]


def test_days_in_utc(spark):
    from leakscope.functions.risk import to_date

    given = {"2024-03-14T23:30:00-05:00": "2024-03-15", "2024-03-15T01:00:00+02:00": "2024-03-14", "2024-03-15T00:00:00Z": "2024-03-15", "2024-03-15": "2024-03-15", "2024-03-15 23:59:59": "2024-03-15",
             "2024-03-15T23:30:00.123+0000": "2024-03-15", "15/03/2024": None, "2024-13-45": None, "": None, None: None, "2024-03-15 later": "2024-03-15"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r.t: r.d for r in df.select("t", to_date(F.col("t")).cast("string").alias("d")).collect()} == given


def test_keyed_hashes_and_decoding(spark):
    import base64
    import hashlib
    import hmac

    from leakscope.functions.hashes import decoded, hmac_tag

    texts = ["", "a/b", "é汉😀" * 30]
    df = spark.createDataFrame([(t, base64.encodebytes(t.encode()).decode()) for t in texts], "t string, b string")
    for key in ("k", "x" * 100):
        for r in df.select("t", hmac_tag("t", key).alias("h"), decoded("b").alias("d")).collect():
            assert r.h == hmac.new(key.encode(), r.t.encode(), hashlib.sha256).hexdigest()[:16] and r.d == r.t
    assert spark.createDataFrame([("%%%",), (None,)], "b string").select(decoded("b").alias("d")).distinct().collect() == [(None,)]
