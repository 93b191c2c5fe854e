import hashlib
import random
import subprocess
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leakscope.operators import bloom, minhash
from leakscope.operators.components import connected_components
from leakscope.operators.exposure import char_cosine, exposures
from leakscope.operators.pairs import key_pairs
from leakscope.operators.sampling import round_robin_sample
from leakscope.operators.skew import balanced_aggregate, fragment_replicate_join, plan_shards, route_values, spread_by_load


def test_nothing_outside_imports_llm():
    root = Path(__file__).parents[1] / "leakscope"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "leakscope.llm" in p.read_text()]


@pytest.mark.parametrize("block", [1, 2, 512])
def test_key_pairs(spark, block):
    rows = [("k", i) for i in range(7)] + [("s", 1), ("t", 2), ("t", 3), (None, 4), ("t", None)]
    got = Counter((r.a, r.b) for r in key_pairs(spark.createDataFrame(rows, "key string, n int"), "key", "n", block).collect())
    want = Counter((i, j) for i in range(7) for j in range(i + 1, 7))
    want[2, 3] += 1
    assert got == want


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_routes_are_where_spark_puts_them(spark):
    for n in (1, 7, 12):
        df = spark.createDataFrame([(p, v) for p, v in enumerate(route_values(n))], "p int, v int").repartition(n, "v")
        assert all(r[0] == r[1] for r in df.select("p", F.spark_partition_id()).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("hot", i) for i in range(3000)] + [("warm", i) for i in range(900)] + [(f"k{i % 400}", i) for i in range(2000)] + [(None, i) for i in range(5)]
    return spark.createDataFrame(rows, "key string, n int").persist()


def test_load_is_balanced(spark, skewed):
    plan = plan_shards(skewed, "key", 6)
    assert len(plan.heavy) <= 24 and len(plan.heavy["hot"]) > 1
    loads = [r[1] for r in spread_by_load(skewed, "key", plan).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(loads) == 5900 and max(loads) < 1.35 * 5900 / 6


def test_balanced_aggregate(spark, skewed):
    got = {r.key: (r.c, r.s) for r in balanced_aggregate(skewed, "key", {"c": F.count("*"), "s": F.sum("n")}, {"c": F.sum("c"), "s": F.sum("s")}).collect()}
    want = defaultdict(lambda: [0, 0])
    for r in skewed.where("key is not null").collect():
        want[r.key][0] += 1
        want[r.key][1] += r.n
    assert got == {k: tuple(v) for k, v in want.items()}
    assert balanced_aggregate(skewed.limit(0), "key", {"c": F.count("*")}, {"c": F.sum("c")}).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_fragment_replicate(spark, skewed, how):
    other = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), ("none", "d"), (None, "e")], "key string, tag string")
    got = Counter(map(tuple, fragment_replicate_join(skewed, other, "key", how).collect()))
    assert got == Counter(map(tuple, skewed.join(other, "key", how).collect()))
    joined = fragment_replicate_join(skewed, other, "key", how)._jdf.queryExecution().executedPlan().toString()
    assert joined.count("Exchange hashpartitioning(_route") <= 2
    assert how == "left_semi" or "ENSURE_REQUIREMENTS" not in joined.split("Union")[0]
    with pytest.raises(ValueError):
        fragment_replicate_join(skewed, other.withColumn("n", F.lit(1)), "key")
    assert fragment_replicate_join(skewed, other.limit(0), "key").count() == 0


def test_sample(spark):
    rows = [("a", i) for i in range(10)] + [("b", 20), ("c", 5), (None, 1)]
    got = [(r.g, r.i) for r in round_robin_sample(spark.createDataFrame(rows, "g string, i int"), "g", "i", 6).collect()]
    assert got == [("a", 0), (None, 1), ("c", 5), ("b", 20), ("a", 1), ("a", 2)]


def test_exposure_counts(spark):
    df = spark.createDataFrame([(1, ["x", "x", "x", "y"], ["x", "x", "z"]), (2, [], ["a"]), (3, ["a"], [])], "id int, q array<string>, s array<string>")
    assert sorted(map(tuple, exposures(df).collect())) == [(1, 4, 2), (2, 0, 0), (3, 1, 0)]
    two = spark.createDataFrame([(1, ["a", "b", "a", "b", "c"], ["b", "a", "b", "c"]), (2, ["a"], ["a"]), (3, None, ["a", "b"])], "id int, q array<string>, s array<string>")
    assert sorted(map(tuple, exposures(two, 2).collect())) == [(1, 4, 3), (2, 0, 0), (3, 0, 0)]
    t = spark.createDataFrame([(1, "abcd", "ABCD"), (2, "ab", "abc"), (3, None, "abc"), (4, "aaab", "xyz"), (5, "汉字汉字", "汉字汉")], "id int, q string, s string")
    got = dict(map(tuple, char_cosine(t).collect()))
    assert got[1] == pytest.approx(1) and got[2] is None and got[3] is None and got[4] == 0 and got[5] == pytest.approx(0.5**0.5)


def test_cosine_of_long_texts(spark):
    t = spark.createDataFrame([(1, "pqrs", "ab " * 70_000 + "pqrs")], "id int, q string, s string")
    assert char_cosine(t).first().cosine > 0


def test_minhash_definition(spark):
    sets = {"a": ["x", "yy", "zzz"], "b": ["x", "yy"], "c": ["é汉"]}
    df = spark.createDataFrame(list(sets.items()), "id string, tokens array<string>")
    salt = [hashlib.sha256(f"leakscope-42-{i}".encode()).digest() for i in range(128)]
    want = {k: [format(min(int.from_bytes(hashlib.sha256(s + t.encode()).digest()[:8], "little") for t in v), "016x") for s in salt] for k, v in sets.items()}
    made = minhash.signatures(df, "id", "tokens")
    assert {r.id: r.h for r in made.select("id", minhash.hex_hashes(F.col("sig")).alias("h")).collect()} == want
    nothing = spark.createDataFrame([("d", []), ("e", None), ("f", [None])], "id string, tokens array<string>")
    assert minhash.signatures(nothing, "id", "tokens").count() == 0
    rows = df.join(made.select("id", minhash.band_hashes(F.col("sig")).alias("b")), "id").select("id", minhash.signature(F.col("tokens")).alias("sig"), "b").collect()
    assert len(rows) == 3
    for r in rows:
        assert r.sig == want[r.id]
        n = [int(x, 16) for x in r.sig]
        assert r.b == [hashlib.sha256(str(tuple(n[i : i + 4])).encode()).hexdigest()[:16] for i in range(0, 128, 4)]
    assert spark.createDataFrame([([],)], "t array<string>").select(minhash.signature(F.col("t"))).first()[0] == ["0" * 16] * 128


@pytest.mark.parametrize("sha", [False, True])
def test_content_matches(spark, sha):
    words = [f"tok{i}" for i in range(40)]
    left = spark.createDataFrame([("p", words[:20]), ("few", words[:2])], "id string, tokens array<string>")
    right = spark.createDataFrame([(1, words[:20]), (2, words[2:22]), (3, words[30:40])], "id int, tokens array<string>")
    got = [(r.left_id, r.right_id, round(r.similarity, 4), r["rank"]) for r in minhash.content_matches(left, right, sha=sha).orderBy("rank").collect()]
    assert got == [("p", 1, 1.0, 1), ("p", 2, round(18 / 22, 4), 2)]


@pytest.mark.parametrize("block", [4_000_000, 50])
def test_content_matches_are_those_of_brute_force(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(minhash, "BLOCK_TOKENS", block)
    random.seed(5)
    sets = lambda n, mark: {f"{mark}{i}": random.sample([f"tok{k}" for k in range(90)], random.randint(2, 25)) for i in range(n)}
    left, right = sets(25, "p"), sets(40, "d")
    want = {}
    for i, x in left.items():
        alike = {j: len({*x} & {*y}) / len({*x} | {*y}) for j, y in right.items() if min(len(x), len(y)) >= 3}
        best = sorted((-s, j) for j, s in alike.items() if s >= 0.1)[:10]
        want |= {(i, j): (-s, r) for r, (s, j) in enumerate(best, 1)}
    a, b = (spark.createDataFrame(list(x.items()), "id string, tokens array<string>") for x in (left, right))
    got = {(r.left_id, r.right_id): (r.similarity, r["rank"]) for r in minhash.content_matches(a, b).collect()}
    assert got == want and sum(s < 0.2 for s, _ in want.values()) > 50
    if block == 50:
        minhash.write_index(b, str(tmp_path / "lsh"), parts=2)
        assert {(r.left_id, r.right_id): (r.similarity, r["rank"]) for r in minhash.match_index(a, str(tmp_path / "lsh")).collect()} == want
    assert minhash.content_matches(a.limit(0), b).count() == minhash.content_matches(a, b.limit(0)).count() == 0


def test_stored_index_and_filter(spark, tmp_path):
    words = [f"tok{i}" for i in range(40)]
    left = spark.createDataFrame([("p", words[:20])], "id string, tokens array<string>")
    right = spark.createDataFrame([(1, words[:20]), (2, words[2:22]), (3, words[30:40]), (4, words[:2])], "id int, tokens array<string>")
    minhash.write_index(right, str(tmp_path / "lsh"), parts=4)
    got = minhash.match_index(left, str(tmp_path / "lsh")).orderBy("rank").collect()
    assert got == minhash.content_matches(left, right).orderBy("rank").collect() and [r.right_id for r in got] == [1, 2]
    (tmp_path / "repos.txt").write_text("A/b \nnothing\n c/D\n")
    keys = bloom.from_lines(spark, str(tmp_path / "repos.txt"))
    assert sorted(r.repo for r in keys.collect()) == ["a/b", "c/d"]
    m, k = bloom.sizing(100, 0.01)
    bloom.save(bloom.build(keys, "repo", m, k), str(tmp_path / "bloom"), 100, m, k)
    bits, m2, k2 = bloom.load(spark, str(tmp_path / "bloom"))
    assert (m2, k2) == (m, k) and all(r.member for r in bloom.probe(keys, "repo", bits, m, k).collect())
    bloom.save(bits, str(tmp_path / "bad"), 5, 2, 1)
    with pytest.raises(ValueError):
        bloom.load(spark, str(tmp_path / "bad"))


def test_substrings(spark):
    from leakscope.operators.substring import substring_join

    patterns = {1: "e quick brown fox ju", 2: "brown", 3: "the lazy dog", 4: "", 5: None, 6: "Quick Brown Fox!", 7: "lazy, dog sleeps", 8: "e quick brown fox ju", 9: "敏捷的棕色狐狸", 10: "狐狸", 11: "ไปกัน", 12: "x", 13: "😀é"}
    texts = {6: "看，敏捷的棕色狐狸跳了", 7: "เราไปกันเถอะ", 8: "a 😀é b", 9: "x", 10: "狐" + "é" * 30_000 + "狐狸", 1: "The quick brown fox jumps", 2: "the lazy dog sleeps", 3: None, 4: "", 5: "Quick Brown Fox! The quick brown fox jumps, so the lazy dog barks"}
    p = spark.createDataFrame(list(patterns.items()), "id int, pattern string")
    t = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "text_id int, text string")
    want = {(i, j) for i, a in patterns.items() for j, b in texts.items() if a and b and a in b}
    assert {tuple(r) for r in substring_join(p, t).collect()} == want and (1, 1) in want
    assert substring_join(p, t.limit(0)).count() == substring_join(p.limit(0), t).count() == 0


def test_bloom(spark):
    keys = [f"o/r{i}" for i in range(300)]
    m, k = bloom.sizing(300, 0.01)
    df = spark.createDataFrame([(x,) for x in keys] + [(None,)], "repo string")
    bits = bloom.build(df, "repo", m, k)
    d = hashlib.sha256(b"o/r7").digest()
    h1, h2 = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:16], "little")
    assert df.where("repo = 'o/r7'").select(bloom.positions(F.col("repo"), m, k)).first()[0] == [(h1 + i * h2) % m for i in range(k)]
    found = {r.key: r.member for r in bloom.probe(df.union(spark.createDataFrame([(f"n/{i}",) for i in range(500)], "repo string")), "repo", bits, m, k).collect()}
    assert all(found[x] for x in keys) and sum(v for x, v in found.items() if x[0] == "n") < 25
    assert bloom.sizing(1, 0.9)[0] == 64


def test_repository_is_small():
    out = subprocess.run(["git", "-C", str(Path(__file__).parents[1]), "count-objects", "-v"], capture_output=True, text=True).stdout
    sizes = {k: int(v) for k, v in (x.split(": ") for x in out.splitlines() if "size" in x and "garbage" not in x)}
    assert sum(sizes.values()) < 30_000


def test_hot_keys_of_any_number(spark):
    """Half of all rows in one key, many further heavy keys: the plan finds each of them, and no task holds the hot one."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 11).cast("string"))).alias("key"), "id")
    plan = plan_shards(rows, "key", 6)
    assert len(plan.heavy) > 10
    keys = rows.select("key").distinct().select("key", plan.routes(F.col("key")).alias("r")).collect()
    for k in keys:
        assert sorted(k.r) == sorted(plan.heavy.get(k.key, k.r)) and (k.key in plan.heavy or len(k.r) == 1)
    sizes = [r.n for r in spread_by_load(rows, "key", plan).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 40_000 / 6
    ints = rows.select((F.length("key") - F.length("key") + F.when(F.col("key") == "hot", 70).otherwise(F.col("id") % 11)).alias("key"), "id")
    got = {r.key: r.n for r in balanced_aggregate(ints, "key", {"p": F.count("*")}, {"n": F.sum("p")}).collect()}
    assert sum(got.values()) == 40_000 and got[70] == 20_000


def test_first_of_each(spark):
    from leakscope.operators.sampling import first_of_each

    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 3), (None, 9), (None, 1)], "g string, x int")
    got = sorted(((r.g or "", r.x) for r in first_of_each(rows, "g", ["x"], 3).collect()))
    assert got == [("", 1), ("", 9), ("a", 0), ("a", 1), ("a", 2), ("b", 3)]


def test_containment_of_runs(spark):
    import random
    from collections import Counter

    from leakscope.operators.exposure import containment_join

    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = {f"i{k}": " ".join(r.choices(words, k=r.randrange(0, 60))) for k in range(25)} | {"rep": "a b " * 30, "none": None, "short": "a b c"}
    docs = {k: " ".join(r.choices(words, k=40)) for k in range(20)}
    for k, t in enumerate(list(items.values())[:20]):
        w = t.split()
        docs[100 + k] = " ".join(docs[k].split()[:20] + w[r.randrange(0, 5) : len(w) - r.randrange(0, 25)] + docs[k].split()[20:])
    docs |= {200: "a b " * 9, 201: "a b " * 40, 202: None, 203: ""}
    def grams(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    want = {(i, d, sum(grams(t).values()), sum((grams(t) & grams(u)).values())) for i, t in items.items() for d, u in docs.items() if grams(t) and 2 * sum((grams(t) & grams(u)).values()) >= sum(grams(t).values())}
    i = spark.createDataFrame([*items.items(), ("rep", items["rep"])], "item_id string, text string")
    d = spark.createDataFrame([*docs.items(), (None, "x")], "doc_id long, text string")
    assert {tuple(x) for x in containment_join(i, d).collect()} == want and ("rep", 201) in {x[:2] for x in want} and len(want) > 5
    assert containment_join(i.limit(0), d).count() == 0
