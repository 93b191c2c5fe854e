import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.llm.mixing import BUCKETS, fit_classifier, mix, mixture_report
from leakscope.llm.packing import best_fit_decreasing, exchange_report, lower_bound, pack, packing_report
from leakscope.llm.personal_data import LIKELY, candidates, learn, personal_candidates, personal_data, redacted
from leakscope.llm.sentences import ABBREVIATIONS, languages, sentence_ends, sentences
from leakscope.llm.tokens import default_tokenizer, encoding, token_counts


def cut(text):
    out, p = [], 0
    for e in sentence_ends(text):
        out.append(text[p:e].strip())
        p = e
    return out


@pytest.mark.parametrize("text,want", [
    ("", []),
    (" \n\t\n", []),
    ("One. Two", ["One.", "Two"]),
    ("He said “Stop. Now!” and left. Then?", ["He said “Stop. Now!” and left.", "Then?"]),
    ('"Go on." Then he left.', ['"Go on."', "Then he left."]),
    ("It (is it bad? yes) broke. (See a.b, sec. 2, for c.) Next.", ["It (is it bad? yes) broke.", "(See a.b, sec. 2, for c.)", "Next."]),
    ("Dr. No met Mr. K. Jones, e.g. at 3.5 km. Fine.", ["Dr. No met Mr. K. Jones, e.g. at 3.5 km.", "Fine."]),
    ("We ran it until 5 p.m. Then we slept.", ["We ran it until 5 p.m.", "Then we slept."]),
    ("Around 7 a.m. PackWidget restarts.", ["Around 7 a.m. PackWidget restarts."]),
    ("We tried a, b, etc. load_x then ran.", ["We tried a, b, etc.", "load_x then ran."]),
    ("Am 11. Mai kam z. B. er. Nr. 3 fehlt.", ["Am 11. Mai kam z. B. er.", "Nr. 3 fehlt."]),
    ("L’art. 6 dit non ! « Où est x ? » demande-t-il.", ["L’art. 6 dit non !", "« Où est x ? » demande-t-il."]),
    ("En EE. UU. vemos p. ej. eso. ¿Por qué?", ["En EE. UU. vemos p. ej. eso.", "¿Por qué?"]),
    ("См. рис. 10, т. е. это. В 2024 г. модуль пал.", ["См. рис. 10, т. е. это.", "В 2024 г. модуль пал."]),
    ("他说“走吧。”然后走了。为什么？", ["他说“走吧。”然后走了。", "为什么？"]),
    ("「はい。」と言った。次。", ["「はい。」と言った。", "次。"]),
    ("क्या है? हाँ। ठीक", ["क्या है?", "हाँ।", "ठीक"]),
    ("كيف؟ نعم.", ["كيف؟", "نعم."]),
    ("ไปกัน กินข้าว v2 แล้ว", ["ไปกัน", "กินข้าว v2 แล้ว"]),
    ("It waits ... and left … load_x exits. Done…  Then", ["It waits ... and left … load_x exits.", "Done…", "Then"]),
    ("## Head\ntext goes\non. More\n\n1. a. b\n2. c\n* d", ["## Head", "text goes\non.", "More", "1. a. b", "2. c", "* d"]),
    ("Title\r\n\r\nBody one.Body two is here.", ["Title", "Body one.", "Body two is here."]),
    ("It is foo.Bar() x.y.", ["It is foo.Bar() x.y."]),
    ('"Unclosed. Next', ['"Unclosed.', "Next"]),
])
def test_sentences(text, want):
    assert cut(text) == want


@pytest.mark.parametrize("text,want", [
    ("He gave it to Me. Then the man left with it.", ["He gave it to Me.", "Then the man left with it."]),
    ("Le dossier de Me. Durand est dans la salle. Fin.", ["Le dossier de Me. Durand est dans la salle.", "Fin."]),
    ("Das ist die Datei z. B. für den Test. Gut.", ["Das ist die Datei z. B. für den Test.", "Gut."]),
    ("The end of z. But not that.", ["The end of z.", "But not that."]),
    ("ดร. สมชาย", ["ดร. สมชาย"]),
])
def test_abbreviations_by_language(text, want):
    assert cut(text) == want


def test_languages():
    assert languages("the cat is on the mat") == {"en"} and languages("der Hund und die Katze") == {"de"} and "ru" in languages("это он") and languages("x = 1") == frozenset(ABBREVIATIONS)
    assert languages("the end of this and that. Das ist nicht die Datei, auch nicht der Ordner.") == {"en", "de"}


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 5), (1, "A b. C d.", 5), (2, None, 5), (None, "x.", 5), (3, " ", 5), (4, "x " * 50_000 + ". Y.", 5)], "doc_id long, body string, number int")
    got = defaultdict(list)
    for r in sentences(df, "doc_id", "body").collect():
        got[r.id].append((r.number, r.end_pos))
    assert sorted(got[1]) == [(1, 4), (1, 4), (2, 9), (2, 9)] and got[4] == [(1, 100_001), (2, 100_004)] and set(got) == {1, 4}


NAMES = [(n, "given") for n in "Ada Berta Carlo Dina".split()] + [(n, "family") for n in "Stone Rivers Marsh Holt".split()] + [("山田花子", "full")]


def corpus():
    r = random.Random(8)
    given, family = [n for n, p in NAMES if p == "given"] + ["Zelma", "Quirin"], [n for n, p in NAMES if p == "family"] + ["Vantor", "Uxbridge-Pell"]
    frames = ["Reported by {}.", "Please ask {} about it.", "Signed-off-by: {} <x.y@mail.example>", "Thanks to {} for the trace.", "Gemeldet von Frau {} am Dienstag."]
    rows, want = [], set()
    for i in range(200):
        name = f"{r.choice(given)} {r.choice(['', 'K. '])}{r.choice(family)}"
        f = r.choice(frames)
        text = "Build Server and Quill Router both call it. " + f.format(name)
        rows.append(("t", str(i), text))
        want.add((str(i), "person", text.index(name)))
        if "@" in text:
            want.add((str(i), "email", text.index("x.y@")))
    return rows, want


def test_unlisted_names_are_learned(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows + rows[:3] + [("t", "n", None), ("t", "e", ""), (None, "x", "Reported by Ada Stone.")], "src string, key string, text string").withColumn("kind", F.lit(1))
    got = {(r.key, r.kind, r.s) for r in personal_data(df, NAMES).collect()}
    assert got == want


def found_in(spark, rows, names=NAMES):
    df = spark.createDataFrame(rows, "src string, key string, text string")
    return {(r.key, r.kind, r.s) for r in personal_data(df, names).collect()}


def test_same_text_at_any_size(spark):
    rows, want = corpus()
    rows += [("t", f"d{i}", f"{x} has failed in row {i % 7}.") for i in range(90) for x in ["Quarrix Inc" if i % 3 else "Die Anfrage"]]
    # names of things now and then stand where names of persons do
    rows += [("t", f"m{i}", x) for i, x in enumerate(["Reported by Build Server.", "Please ask Quarrix Inc about it.", "Thanks to Die Anfrage for the trace."])]
    for times in (1, 10, 100):
        got = found_in(spark, [(s, f"{k}/{j}", t) for j in range(times) for s, k, t in rows])
        assert got == {(f"{k}/{j}", kind, at) for j in range(times) for k, kind, at in want}


def test_contexts_find_what_no_sure_shape_does(spark):
    r = random.Random(3)
    rows = [("t", f"a{i}", f"Address on file: {r.randrange(1, 99)} Larch Road, Quarrow {r.randrange(10000, 99999)} (old)") for i in range(20)]
    rows += [("t", f"p{i}", f"Call me on +49 30 {r.randrange(100000, 999999)} if it breaks.") for i in range(20)]
    rows += [("t", f"e{i}", f"Replies go to jo{i}@mail.example please.") for i in range(20)]
    rows += [("t", f"n{i}", f"still has the SSN {r.randrange(10**7, 10**8)}K in it.") for i in range(20)]
    rows += [("t", f"r{i}", f"Reported by {r.choice(['Ada', 'Berta', 'Carlo', 'Dina'])} {r.choice(['Stone', 'Rivers', 'Marsh', 'Holt'])}.") for i in range(30)]
    new = [("x1", "Address on file: 7 Upper Meadow, Quarrow (old)", "address", 17), ("x2", "Call me on 555 12-34 77 if it breaks.", "phone", 11), ("x3", "Replies go to jo_at_mail(dot)example please.", "email", 14), ("x4", "still has the SSN AB1234567 in it.", "id_number", 18),
           ("x5", "Reported by Иван Петров.", "person", 12), ("x6", "Reported by محمد علي.", "person", 12), ("x7", "Reported by Łucja Šimková.", "person", 12)]
    decoys = [("y1", "Row 8 Lower Meadow, Quarrow is full"), ("y2", "Build 555 98-76 54 took long"), ("y3", "Order AB7654321 is late"), ("y4", "Город Старый Оскол красив")]
    got = found_in(spark, rows + [("t", k, t) for k, t, *_ in new] + [("t", k, t) for k, t in decoys])
    assert {x for x in got if x[0][0] in "xy"} == {(k, kind, at) for k, _, kind, at in new}
    assert len(got) == len(rows) + len(new)


def test_most_persons_and_numbers_stand_in_good_patterns(spark):
    rows, _ = corpus()
    rows += [("t", f"i{i}", f"still has the SSN {100 + i}-22-{3000 + i} in it." if i % 2 else f"still has the SSN {10**7 + i}K in it.") for i in range(60)]
    found, contexts = personal_candidates(spark.createDataFrame(rows, "src string, key string, text string"), NAMES)
    good, values = learn(contexts)
    beside = found.select("kind", "value", "s", "key", F.explode("patterns").alias("pattern")).where("pattern not like 'S %'").join(good, ["kind", "pattern"]).select("kind", "key", "s").distinct()
    got, all_of = ({r[0]: r[1] for r in x.groupBy("kind").count().collect()} for x in (beside, found))
    assert got["person"] == 200 and got["id_number"] == 60 == all_of["id_number"]


SHAPES = [
    ("mail bob.x+y@a-b.example now", "email", "bob.x+y@a-b.example"), ("to JO@MAIL.EXAMPLE.", "email", "JO@MAIL.EXAMPLE"), ("at jo [at] mail [dot] example ok", "email", "jo [at] mail [dot] example"),
    ("x jo_k AT uni-lab DOT test", "email", "jo_k AT uni-lab DOT test"), ("jo＠mail.example", "email", "jo＠mail.example"), ("call (627) 555-0168 now", "phone", "(627) 555-0168"),
    ("+49 (0)30 23125 654.", "phone", "+49 (0)30 23125 654"), ("01 99 00 41 57 ok", "phone", "01 99 00 41 57"), ("735.555.0161 ext. 84", "phone", "735.555.0161 ext. 84"), ("001-791-555-0163", "phone", "001-791-555-0163"),
    ("the QQ 50 19 49 C in", "id_number", "QQ 50 19 49 C"), ("no X0817105Z.", "id_number", "X0817105Z"), ("00004019901019899X", "id_number", "00004019901019899X"),
    ("to PO Box 144, Quarrow.", "address", "PO Box 144, Quarrow"), ("(84 rue des Loutres, 00370 Fennwick)", "address", "84 rue des Loutres, 00370 Fennwick"), ("165 bis rue du Cuivre, 00855 Sandleigh", "address", "165 bis rue du Cuivre, 00855 Sandleigh"),
    ("Am Otterbach 77a, 09788 Ostermoor", "address", "Am Otterbach 77a, 09788 Ostermoor"), ("Kupferstraße 12, 05335 Valbourg", "address", "Kupferstraße 12, 05335 Valbourg"), ("Calle del Farol 84, 5.º C, 00742 Lindhaven", "address", "Calle del Farol 84, 5.º C, 00742 Lindhaven"),
    ("in 92A Willow Close, Flat 7, Ostermoor ZZ1 1QX ok", "address", "92A Willow Close, Flat 7, Ostermoor ZZ1 1QX"), ("950 Saddler Copper Blvd., Quarrow 44584", "address", "950 Saddler Copper Blvd., Quarrow 44584"),
]


@pytest.mark.parametrize("text,kind,item", SHAPES)
def test_sure_shapes(text, kind, item):
    sure = [(k, text[s:e]) for k, s, e, _, trust, *_ in candidates(text, frozenset(), frozenset(), frozenset()) if trust >= LIKELY]
    assert sure == [(kind, item)]


@pytest.mark.parametrize("text", ["git@forge.example:a/b.git", "Use @decorator on it", "user@${9} here", "ISSN-like tag 0000-0012", "Range 10-20-6", "Build 2024-3266-3", "Ticket +155 moved", "Job 2024.13.05 took", "Lot 8 Queue Drive, the loose disk", "v1.2.3 and 3.10"])
def test_decoys(text):
    assert not [c for c in candidates(text, frozenset(), frozenset(), frozenset()) if c[4] >= LIKELY]


def test_redaction_changes_nothing_else(spark):
    rows, _ = corpus()
    rows = [*rows, ("t", "a", "担当者は山田花子さんです。 mail é😀 a@b.example, ok"), ("t", "b", ""), ("t", "c", "nothing\r\n here")]
    got = {r.key: r.text for r in redacted(spark.createDataFrame(rows, "src string, key string, text string"), NAMES).collect()}
    assert got["a"] == "担当者は[PERSON]さんです。 mail é😀 [EMAIL], ok" and got["b"] == "" and got["c"] == "nothing\r\n here" and len(got) == len(rows)


def test_bounds_and_packing_alone():
    r = np.random.default_rng(4)
    for cap in (10, 64, 1000):
        for _ in range(25):
            sizes = r.integers(0, cap + 1, r.integers(0, 120))
            place, fills = best_fit_decreasing(sizes, cap)
            assert (np.bincount(place, sizes, len(fills)) == fills).all() and (fills <= cap).all()
            assert -(-int(sizes.sum()) // cap) <= lower_bound(sizes, cap) <= len(fills) or not len(sizes)
            values, counts = np.unique(sizes, return_counts=True)
            assert lower_bound(values, cap, counts) == lower_bound(sizes, cap)
    assert lower_bound(np.array([6, 6, 6]), 10) == 3 and lower_bound(np.array([4, 4, 4, 4]), 10) == 2


def test_pack(spark):
    r = random.Random(9)
    sizes = {f"i{k}": r.choice([0, 1, 5, 33, 64, 65, 130, 500, r.randrange(1, 90)]) for k in range(900)}
    items = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()] + [("i0", sizes["i0"], 1), (None, 5, 1), ("null", None, 1)], "id string, tokens long, k int")
    bins = spark.createDataFrame([("s", 64), ("l", 300), ("bad", 0), ("none", None)], "bin_name string, capacity int")
    packed = pack(items, bins, group=200).persist()
    fill, got, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
    for x in packed.collect():
        fill[x.bin_name, x.container] += x["size"]
        got[x.bin_name, x.id] += x["size"]
        pieces[x.bin_name, x.id].append((x.first_token, x["size"]))
    for name, cap in (("s", 64), ("l", 300)):
        assert all(v <= cap for (b, _), v in fill.items() if b == name)
        assert {k: v for (b, k), v in got.items() if b == name} == sizes
        for k, v in sizes.items():
            at = sorted(pieces[name, k])
            assert len(at) == (1 if v <= cap else -(-v // cap)) and all(s == i * cap for i, (s, _) in enumerate(at))
    for x in packing_report(packed, bins).collect():
        assert x.lower_bound <= x.containers <= x.lower_bound + 3
    assert pack(items.limit(0), bins).count() == pack(items, bins.limit(0)).count() == 0


def test_exchange(spark):
    r = random.Random(2)
    items = spark.createDataFrame([(k, r.randrange(1, 100)) for k in range(1500)], "id long, tokens long")
    bins = spark.createDataFrame([("b", 100)], "bin_name string, capacity int")
    rounds = sorted(exchange_report(items, bins, 50).collect(), key=lambda x: x.round)
    assert rounds[0]["items"] == 1500 and rounds[0].groups == 30 and all(x.gap >= 0 and x.certified <= x.groups for x in rounds)
    assert len(rounds) > 1 and all(y["items"] < x["items"] for x, y in zip(rounds, rounds[1:]))
    used = {n: pack(items, bins, rounds=n, group=50).select("container").distinct().count() for n in (1, 3)}
    assert used[3] <= used[1] == rounds[0].containers
    assert exchange_report(items.limit(0), bins, 50).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, naïve 汉字 <|endoftext|>"), (2, ""), (3, None), (None, "x")], "id long, text string")
    got = {r.id: r.tokens for r in token_counts(df, "id", "text").collect()}
    enc = encoding(default_tokenizer())
    text = "Hello world, naïve 汉字 <|endoftext|>"
    assert got == {1: len(enc.encode_ordinary(text)), 2: 0} and enc.decode(enc.encode_ordinary(text)) == text


def mixture_input(spark):
    r = random.Random(10)
    topics = {"code": "def return import class self value", "mail": "regards dear hello thanks reply wrote", "docs": "install guide section option command usage"}
    rows, i = [], 0
    for source, count in (("code", 600), ("mail", 80), ("docs", 250)):
        for _ in range(count):
            rows.append((i, source if i % 25 else None, " ".join(r.choices(topics[source].split() + ["the", "of", "and"], k=r.randrange(5, 60))), 0))
            i += 1
    return spark.createDataFrame(rows + [(None, "code", "x", 0), (i, "mail", None, 0), (i + 1, "mail", "", 0)] + rows[:2], "doc_id long, source string, text string, label int")


def test_mixture(spark):
    docs = mixture_input(spark)
    targets = spark.createDataFrame([("code", 0.5, 1), ("mail", 0.2, 3), ("docs", 0.3, 2)], "source string, target_share double, max_repeats int")
    m = mix(docs, targets).persist()
    caps = {"code": 1, "mail": 3, "docs": 2}
    rows = m.collect()
    assert len({r.id for r in rows}) == len(rows) and all(1 <= r.repeats <= caps[r.source] for r in rows)
    report = mixture_report(docs, targets).collect()
    sizes = {r.source: r.tokens for r in m.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens")).collect()}
    for r in report:
        assert abs(r.actual_share - r.target_share) < 0.01 and r.tokens == sizes[r.source]
        assert abs(r.fitted_share - r.target_share) < 0.02 and abs(r.expected_share - r.target_share) < 0.05
    assert {(x.source, x.actual_share) for x in mixture_report(docs.limit(0), targets).collect()} == {(k, 0.0) for k in caps}
    assert mix(docs.limit(0), targets).count() == mix(docs, targets.limit(0)).count() == 0


def test_classifier_on_held_out_rows(spark):
    docs = mixture_input(spark).where("text != '' and doc_id is not null").dropDuplicates(["doc_id"])
    rows = token_counts(docs, "doc_id", "text", None, ("source",), BUCKETS).persist()
    model = fit_classifier(rows.where("id % 2 = 0"), ["code", "docs", "mail"])
    held = rows.where("id % 2 = 1 and source is not null").collect()
    right = sum(model.labels[int(model.posterior(r.feats).argmax())] == r.source for r in held)
    assert right > 0.95 * len(held)
