import os
import random
import re
from itertools import combinations, product

import numpy as np
import pytest

from leakscope.llm.leaks import Prepared, _word_codes, canonical, filled_slots, leak_candidates, leaks, reparameterised, template_anchors
from leakscope.llm.near_duplicates import REGISTERS, bands, estimate, near_duplicate_groups, near_duplicate_pairs, sketch
from leakscope.llm.shared_spans import anchors, char_hashes, code_points, relative_spans, shared_share, shared_span_pairs
from leakscope.llm.words import U, gram_hashes, mix, sliding_min

W = re.compile(r"\w+")


def grams(t, n):
    w = W.findall(t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def texts(seed, count=60, size=80, pool=400):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"Word_{i}" for i in range(pool)]
    out = [" ".join(r.choices(words, k=r.randrange(0, size))) for _ in range(count)]
    for i in range(count // 2):
        w = r.choice(out).split()
        for _ in range(r.randrange(0, 1 + len(w) // 6)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(r.choice([" ", "\n", ", "]).join(w))
    return out + out[:4] + ["", " ", None, "one two", "Same three words!", "same THREE, words"]


def frame(spark, values, cols="id string, t string, fp int, a string, w string"):
    """With repeated rows, null ids and columns whose names the operators use themselves."""
    rows = [(f"d{i:03}", v, 1, "x", "y") for i, v in enumerate(values)]
    return spark.createDataFrame(rows + rows[:5] + [(None, "no id here at all", 1, "x", "y")], cols)


@pytest.mark.parametrize("words,threshold", [(3, 0.6), (5, 0.8)])
def test_near_duplicates_as_by_brute_force(spark, words, threshold):
    values = texts(words)
    sets = {f"d{i:03}": grams(v or "", words) for i, v in enumerate(values)}
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in combinations(sorted(sets.items()), 2) if x and y and len(x & y) / len(x | y) >= threshold}
    got = {(r.id_a, r.id_b): r.similarity for r in near_duplicate_pairs(frame(spark, values), "id", "t", words, threshold).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    groups = {r.id: r for r in near_duplicate_groups(frame(spark, values), "id", "t", words, threshold).collect()}
    assert groups.keys() == {k for k, v in sets.items() if v}
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id
        assert (groups[a].class_id == groups[b].class_id) == (sets[a] == sets[b])


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], "id string, t string")
    assert near_duplicate_pairs(empty, "id", "t").count() == 0
    assert near_duplicate_groups(empty, "id", "t").count() == 0
    assert shared_span_pairs(empty, "id", "t").count() == 0
    assert shared_share(empty, "id", "t").count() == 0


def test_long_text_is_read_whole(spark):
    tail = " ".join(f"t{i}" for i in range(300))
    head = " ".join(str(i) for i in range(60_000))
    values = [head + " " + tail, "other " + head[::-1] + " " + tail]
    assert shared_span_pairs(frame(spark, values), "id", "t", 200).count() == 1


def test_sketch_estimates():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 4000).astype(U)
    errors = []
    for share in (0.2, 0.5, 0.8, 1.0):
        n = int(1000 * 2 * share / (1 + share))
        x, y = base[:1000], np.concatenate([base[:n], base[2000 : 3000 - n]])
        s = sketch(np.concatenate([x, y]), np.repeat([0, 1], 1000), 2)
        e, rests = estimate(s[:1], s[1:], np.array([1000]), np.array([1000]))
        assert rests[0] == REGISTERS
        errors.append(abs(e[0] - len(np.intersect1d(x, y)) / len(np.union1d(x, y))))
    assert max(errors) < 0.17 and errors[-1] < 1e-3
    keys, used = bands(sketch(base[:1], np.zeros(1, np.int64), 1))
    assert 0 < used.sum() < keys.size


def test_sliding_min_and_grams():
    r = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 37):
        x = r.integers(0, 50, n).astype(U)
        for w in (1, 4):
            assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]
    x = r.integers(0, 2**60, 30).astype(U)
    assert len(gram_hashes(x, 31)) == 0 and gram_hashes(x[3:9], 4)[1] == gram_hashes(x, 4)[4]
    assert gram_hashes(x[[0, 1]], 2)[0] != gram_hashes(x[[1, 0]], 2)[0]


def brute_spans(x, y, n):
    there = {y[i : i + n] for i in range(len(y) - n + 1)}
    cover = [False] * len(x)
    for i in range(len(x) - n + 1):
        if x[i : i + n] in there:
            cover[i : i + n] = [True] * n
    return cover


def test_relative_parse_as_by_brute_force():
    r = random.Random(4)
    for _ in range(150):
        alphabet = r.choice(["ab", "abcdefgh", "aé汉😀"])
        ref = "".join(r.choices(alphabet, k=r.randrange(0, 200)))
        doc = "".join(ref[s : s + r.randrange(1, 60)] if ref and r.random() < 0.7 else r.choice(alphabet) for s in (r.randrange(0, max(1, len(ref))) for _ in range(8)))
        cover = [False] * len(doc)
        for s, e in relative_spans(code_points(doc), code_points(ref), 8, 20):
            assert e - s >= 20
            cover[s:e] = [True] * (e - s)
        assert cover == brute_spans(doc, ref, 20)


def test_anchors_of_common_stretches_agree():
    r = random.Random(5)
    common = "".join(r.choices("abcdefgh ", k=200))
    for _ in range(20):
        x, y = ("".join(r.choices("abcdefgh ", k=r.randrange(0, 300))) + common + "".join(r.choices("abc", k=r.randrange(0, 300))) for _ in range(2))
        a, b = (set(anchors(code_points(t), 128, 200)[0].tolist()) for t in (x, y))
        assert a & b
    assert len(char_hashes(code_points("abc"), 4)) == 0


def test_shared_spans_as_by_brute_force(spark):
    r = random.Random(6)
    blocks = ["".join(r.choices("abc déf\n", k=r.randrange(30, 80))) for _ in range(12)]
    values = ["".join(r.choices(blocks, k=r.randrange(0, 6))) + "".join(r.choices("xyz", k=20)) for _ in range(40)]
    values += [values[0], "", None, "q" * 39, "q" * 41, "q" * 500]
    ids = {f"d{i:03}": v for i, v in enumerate(values) if v}
    sets = {k: {v[i : i + 200] for i in range(len(v) - 199)} for k, v in ids.items()}
    want = {(a, b) for a, b in combinations(sorted(ids), 2) if sets[a] & sets[b]}
    assert {(x.id_a, x.id_b) for x in shared_span_pairs(frame(spark, values), "id", "t", 200).collect()} == want
    shares = {x.id: x.shared_chars for x in shared_share(frame(spark, values), "id", "t", 200).collect()}
    for k, v in ids.items():
        others = set().union(*(s for j, s in sets.items() if j != k))
        cover = [False] * len(v)
        for i in range(len(v) - 199):
            if v[i : i + 200] in others:
                cover[i : i + 200] = [True] * 200
        assert shares.get(k, 0) == sum(cover)


@pytest.mark.parametrize("variants", [4096, 3])
def test_common_block_of_many_texts(spark, monkeypatch, variants):
    """A header in each text, parts of it in some, a block twice in one text only: no pair is made, coverage is exact."""
    monkeypatch.setattr("leakscope.llm.shared_spans.VARIANTS", variants)
    r = random.Random(11)
    noise = lambda n: "".join(r.choices("abcdefgh é汉😀", k=n))
    head, own = noise(420), noise(300)
    values = [noise(r.randrange(0, 150)) + head[r.randrange(0, 60) : r.randrange(300, 421)] + noise(r.randrange(0, 150)) for _ in range(40)]
    values += [own + noise(40) + own, head[:199] + noise(300), noise(250) + head[150:], values[0]]
    ids = {f"d{i:03}": v for i, v in enumerate(values)}
    sets = {k: {v[i : i + 200] for i in range(len(v) - 199)} for k, v in ids.items()}
    got = {x.id: x for x in shared_share(frame(spark, values), "id", "t", 200).collect()}
    for k, v in ids.items():
        others = set().union(*(s for j, s in sets.items() if j != k))
        cover = [False] * len(v)
        for i in range(len(v) - 199):
            if v[i : i + 200] in others:
                cover[i : i + 200] = [True] * 200
        assert (got[k].shared_chars if k in got else 0) == sum(cover)
        assert (got[k].stretches if k in got else 0) == sum(b and not a for a, b in zip([False, *cover], cover))


def leak_brute(items, docs):
    out = set()
    for (i, f), t in items.items():
        w, five = W.findall((t or "").lower()), grams(t or "", 5)
        for d, u in docs.items():
            part = len(five & grams(u or "", 5))
            if (len(w) >= 40 and five and part >= 0.5 * len(five)) or grams(t or "", 20) & grams(u or "", 20):
                out.add((d, i, f))
    return out


def test_leaks_as_by_brute_force(spark):
    r = random.Random(7)
    words = [f"term{i}" for i in range(500)] + ["the", "of", "in", "7", "12", "ms"]
    items = {(f"i{k}", "patch"): " ".join(r.choices(words, k=r.randrange(0, 120))) for k in range(40)}
    items |= {("n", "patch"): None, ("e", "patch"): "", ("same", "test_patch"): items["i0", "patch"], ("i0", "test_patch"): items["i0", "patch"]}
    docs = {}
    for d in range(80):
        w = (items[f"i{r.randrange(40)}", "patch"]).split()
        a = r.randrange(0, max(1, len(w)))
        part = w[a : a + r.choice([19, 20, 25, 60, 200])]
        for _ in range(r.choice([0, 0, 2, 5])):
            if part:
                part[r.randrange(len(part))] = r.choice(words)
        docs[d] = " ".join(r.choices(words, k=20)) + r.choice([" ", "\n> "]) + r.choice([", ", "\n"]).join(part).upper() + " end"
    docs |= {900: None, 901: "", 902: docs[0]}
    i = spark.createDataFrame([(a, b, t, "x") for (a, b), t in items.items()] * 2 + [(None, "patch", "a b", "x")], "item_id string, field string, text string, doc_id string")
    d = spark.createDataFrame([(a, t, "x") for a, t in docs.items()], "doc_id long, text string, field string")
    got = {(x.doc_id, x.item_id, x.field) for x in leaks(i, d).collect()}
    assert got == leak_brute(items, docs) and len(got) > 20
    assert leaks(i.limit(0), d).count() == leaks(i, d.limit(0)).count() == 0


def test_reparameterised_questions(spark):
    base = "Perrun has 12 apples and gives 5 of the 12 apples to a friend every 3 days until after 9 weeks none of the green apples are left over in the basket so how many friends got one and what does the seller say"
    other = base.replace("12", "40").replace("5", "8").replace("Perrun", "Ysterby")
    mixed = base.replace("12", "40", 1)
    i = spark.createDataFrame([("q", "problem_statement", base)], "item_id string, field string, text string")
    d = spark.createDataFrame([(1, other), (2, mixed), (3, base), (4, "nothing of that kind")], "doc_id long, text string")
    links = {x.d: x for x in leak_candidates(i, d, ["Perrun", "Ysterby"])[2].collect()}
    assert len(links) == 3
    found = {x.doc_id: x for x in reparameterised(i, d, ["Perrun", "Ysterby"], share=0.5).collect()}
    assert 3 not in found and 2 not in found
    assert {x.doc_id for x in leaks(i, d).collect()} >= {3}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_refilled_fields(spark):
    """Every field of 40 or more words with all its numbers replaced, each always alike, put into a document of its own."""
    import pyarrow.parquet as pq

    names = pq.read_table(f"{SF}/known_names.parquet").column("name").to_pylist()
    r, items, docs = random.Random(5), [], []
    number = re.compile(r"(?<![^\W_])\d\w*")
    for row in pq.read_table(f"{SF}/instances.parquet").to_pylist():
        for f in ("patch", "test_patch", "problem_statement"):
            t = row[f] or ""
            if len(W.findall(t)) >= 40 and len(number.findall(t)) >= 3:
                to = {}
                other = number.sub(lambda m: to.setdefault(m.group().lower(), str(r.randrange(10**6, 10**7))), t)
                items.append((row["instance_id"], f, t))
                docs.append((len(docs), "see below\n" + other + "\nthe end", f"{row['instance_id']} {f}"))
    # the densest kind: short words, units and numbers only
    for k in range(30):
        t = " ".join(f"{r.choice(['at', 'in', 'a', 'of'])} {r.randrange(99)} {r.choice(['ms', 'kb', 'x', 'to'])}" for _ in range(30))
        to = {}
        items.append((f"dense{k}", "patch", t))
        docs.append((len(docs), number.sub(lambda m: to.setdefault(m.group(), str(r.randrange(10**6, 10**7))), t), f"dense{k} patch"))
    i = spark.createDataFrame(items, "item_id string, field string, text string").distinct()
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    got = {(x.doc_id, f"{x.item_id} {x.field}") for x in reparameterised(i, d, names).collect()} | {(x.doc_id, f"{x.item_id} {x.field}") for x in leaks(i, d, names).collect()}
    want = {(n, key) for n, _, key in docs}
    print(len(got & want), len(want))
    assert len(got & want) >= 0.98 * len(want)


def prepared(text):
    return Prepared(_word_codes(W.findall(text.lower())), np.empty(0, np.uint32))


def test_slots_of_repeated_templates(spark):
    rows = [(3, 14), (14, 25), (25, 8), (8, 77), (77, 4), (4, 3)]
    line = lambda x, y: f"assertion requires parameter {x} returning measurement {y} afterwards"
    field = "\n".join(line(*x) for x in rows)
    new = {v: v * 3 + 500 for x in rows for v in x}
    copy = [line(new[x], new[y]) for x, y in rows]
    twisted = [*copy[:5], line(new[4], 999)]
    i = spark.createDataFrame([("q", "patch", field)], "item_id string, field string, text string")
    d = spark.createDataFrame([(1, "\n".join(copy)), (2, "\n".join(["before 1 2 3", *copy[:3], "an added line", *copy[3:], "after"])), (3, "\n".join(twisted))], "doc_id long, text string")
    assert {(x.doc_id, x.changed) for x in reparameterised(i, d).collect()} == {(1, len(new)), (2, len(new))}


def test_no_consistent_slots_are_lost():
    r = random.Random(8)
    lines = ["set {} to {} now please", "then add {} there again", "row {} {} end of it"]
    seen = set()
    for _ in range(300):
        make = lambda n: " ".join(r.choice(lines).format(r.randrange(3), r.randrange(3)) for _ in range(n))
        f, d = prepared(make(r.randrange(2, 5))), prepared(make(r.randrange(2, 9)))
        found = np.flatnonzero(np.isin(f.windows, d.windows))
        values = np.unique(f.words[f.code < 8]).tolist()
        there = {(int(d.windows[j]), *d.words[j : j + 5].tolist()) for j in range(len(d.windows))}
        want = False
        for ys in product(np.unique(d.words[d.code < 8]).tolist(), repeat=len(values)):
            to = dict(zip(values, ys))
            want |= all((int(f.windows[i]), *(to[int(w)] if c < 8 else int(w) for w, c in zip(f.words[i : i + 5], f.code[i : i + 5]))) in there for i in found)
        assert filled_slots(f, d, found)[1] or not want
        seen.add(want)
    assert seen == {True, False}


def test_templates_depend_on_words_alone():
    r = np.random.default_rng(3)
    words = r.integers(0, 2**32, 200).astype(np.uint32) | np.uint32(2)
    code, size = canonical(words, np.empty(0, np.uint32))
    assert (code[50:90] == canonical(words[50:90], np.empty(0, np.uint32))[0]).all() and (size >= 0).all()
    key, owner = template_anchors(np.concatenate([words, words[20:60]]), np.array([0, 200, 240]), np.empty(0, np.uint32), 4)
    assert set(key[owner == 1].tolist()) <= set(key[owner == 0].tolist())
    assert len(template_anchors(words[:5], np.array([0, 5]), np.empty(0, np.uint32), 4)[0]) == 0
    assert mix(np.array([1], U))[0] != mix(np.array([2], U))[0]
