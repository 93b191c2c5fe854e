"""Personal data in free text, by bootstrapped contextual extraction.

Candidates are cut out of the texts by loose shapes. Seeds are the few whose shape leaves no doubt (a plain mailbox, an
international telephone number, a number with its own check letters, an address with its town, a listed name). The words
beside a candidate are its outer patterns; its digit mask or its name parts are its inner ones. Rounds over the graph of
patterns and values score each pattern by how surely trusted values make up what it stands beside, and trust each value by
the share of its occurrences that stand beside good patterns. All evidence is a share, never a count, so that more text
makes it surer and not looser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import spread, use_shared_dir

ROUNDS = 4
#: Least lower confidence bound of a good pattern beside a value, and of a digit mask, which must be surer to stand alone.
CERTAIN, MASK = 0.5, 0.8
#: Standard deviations of the bound (Wilson's, one-sided, 90 %).
Z = 1.28
#: Trust in shapes of national telephone numbers, of mailboxes with other signs, of boxes without a town and of names with
#: one listed part. It lets their contexts be learned but doesn't do by itself. Numbers cut like a social security number
#: get half.
LIKELY = 0.75
#: Least share of a value's occurrences beside good patterns.
SHARE = 0.5
KINDS = ("email", "address", "id_number", "phone", "person")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![\w.+@-])[A-Za-z0-9_](?:[\w.+-]*[\w])?"
_DOTS = r"\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?"
_EMAIL = re.compile(
    rf"{_LOCAL}(?:\s?[@＠]\s?{_LABEL}(?:[.．]{_LABEL})*[.．][A-Za-z]{{2,}}|\s?[\[({{]\s?(?:at|AT|At|@)\s?[\])}}]\s?{_LABEL}(?:(?:{_DOTS}|\.){_LABEL})*(?:{_DOTS}|\.)[A-Za-z]{{2,}}"
    rf"|\s(?:at|AT)\s{_LABEL}(?:\s(?:dot|DOT)\s{_LABEL})*\s(?:dot|DOT)\s[A-Za-z]{{2,}})(?![\w-])"
)
_PLAIN = re.compile(r"[\w.+-]+@[\w.-]+")
_AT = r"(?:\s?[\[({<]\s?(?i:at|ät|arroba|@)\s?[\])}>]\s?|_(?i:at)_)"
_DOT = r"(?:\s?[\[({<]\s?(?i:dot|punkt|punto|point|\.)\s?[\])}>]\s?|_(?i:dot)_|\s(?i:dot|punkt|punto|point)\s|[.．。])"
_EMAIL_LOOSE = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])")
_TOWN = r"[A-ZÄÖÜÉ][\w’'-]+(?:-[A-Z]\w+)*"
_W = r"[A-ZÄÖÜÉ][\w’'-]*"
_WAYS = r"(?:Street|St|Avenue|Ave|Court|Ct|Lane|Ln|Road|Rd|Boulevard|Blvd|Drive|Dr|Way|Place|Pl|Close|Terrace|Square|Crescent|Row|Walk|Gardens|Mews|Hill|Park)\b\.?"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:"
    rf"(?:P\.?\s?O\.?\sBox|Post Office Box|Postfach|Apartado(?: de correos)?|Casilla|BP|B\.P\.|Bo[iî]te postale|Casella postale)\s(?:n\.?º\s)?\d+(?:,\s(?:\d{{4,5}}\s)?{_TOWN}(?:\s\d{{4,5}})?)?"
    rf"|\d+\s?[A-Za-z]?\s(?:{_W}\s){{1,3}}{_WAYS},\s(?:(?:Flat|Apt\.?|Unit|Suite|Room)\s\w+,\s)?{_TOWN}(?:,?\s[A-Z]{{2}})?,?\s(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}})"
    rf"|\d+(?:\s?[A-Za-z]|\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours|route|square)\s(?:(?:de\sla|de\sl[’']|du|des|de|d[’'])\s?)?(?:{_W}\s?){{1,3}},\s\d{{5}}\s{_TOWN}"
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda|Via|Viale|Piazza|Rua)\s(?:(?:de\slas?|de\slos|del|de|della|dei|da|do)\s)?(?:{_W}\s){{0,2}}{_W},?\s\d+\w?(?:,\s\d+\.?[ºª]?\s?[A-Za-z]?)?,\s\d{{5}}\s{_TOWN}"
    rf"|(?:(?:Am|An der|An dem|Im|In der|Zum|Zur|Auf der|Unter den)\s{_W}|(?:{_W}\s)?{_W}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad))\s\d+\s?[a-z]?,\s\d{{5}}\s{_TOWN}"
    rf")"
)
_BOX_ONLY = re.compile(r"\D+\d+\Z")
_PLACE = r"(?:\d{4,6}\s)?[^\W\d_a-z][\w’'-]+(?:\s[^\W\d_a-z][\w’'-]+){0,2}(?:\s\d{4,6})?"
_CAPS = r"[^\W\d_a-z][\w’'-]*(?:\s[^\W\d_a-z][\w’'-]*){0,3}"
_ADDRESS_LOOSE = re.compile(rf"(?<![\w.,-])(?:\d{{1,5}}\s?[A-Za-z]?,?\s{_CAPS}|{_CAPS},?\s\d{{1,5}}[A-Za-z]?)(?:,\s{_PLACE}){{1,2}}(?![\w-])")
_ID_STRONG = re.compile(r"(?<![\w-])(?:[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]|\d{17}[\dX]|[XYZ]\d{7}[A-Z]|\d{8}[A-Z])(?![\w-])")
_ID_WEAK = re.compile(r"(?<![\w.,+-])(?:\d{3}([- ])\d\d\1\d{4}|[A-Z]{0,2}\d{7,14}[A-Z]?)(?![\w-]|[.,]\d)")
_PHONE_STRONG = re.compile(
    r"(?<![\w+(.-])(?:\+\d{1,3}[\s.-]?(?:\(0\)\s?)?(?:\(\d{1,4}\)\s?)?\d{1,5}(?:[\s.-]\d{2,6}){1,5}|\(\d{3}\)\s?\d{3}[-.\s]\d{4}|00\d{1,2}[-.\s]\d{2,4}(?:[-.\s]\d{3,4}){1,3}|\d{3}[.-]\d{3}[.-]\d{4}|0\d(?:[\s.]\d\d){4})(?:\s?(?:ext\.?|x)\s?\d+)?(?![\w-])"
)
_PHONE_WEAK = re.compile(r"(?<![\w+(.,-])[+(]?\d[\d ()./-]{5,18}\d(?![\w-])")
_NAME = r"[\p{Lu}\p{Lt}][\p{Ll}\p{M}]+(?:[’'-]\p{Lu}[\p{Ll}\p{M}]+)*"
_RUN = regex.compile(rf"(?<![\w.@`/-])(?:\p{{Lu}}\.(?: |\r?\n))?{_NAME}(?:(?: |\r?\n)(?:\p{{Lu}}\.(?: |\r?\n))?{_NAME})+(?![\w@`(]|\.\w|-\w)")
_PART = regex.compile(rf"({_NAME})(?:(?: |\r?\n)(\p{{Lu}}\.))?")
#: Scripts without letter case that part words by blanks. Two to four words between other signs may be a name.
_CASELESS = regex.compile("|".join(rf"(?<!\p{{{s}}}\s?)\p{{{s}}}[\p{{{s}}}\p{{M}}]*(?: \p{{{s}}}[\p{{{s}}}\p{{M}}]*){{1,3}}(?![\p{{{s}}}\p{{M}}]|\s\p{{{s}}})" for s in "Arabic Hebrew Devanagari Bengali Tamil Hangul Georgian".split()))
_CJK = r"[㐀-鿿぀-ヿ々]"
_CJK_ALONE = re.compile(rf"(?<!{_CJK})(?<![：:])({_CJK}{{2,5}})(?!{_CJK})")
_CJK_NAME = re.compile(rf"(?<=[：:は為])({_CJK}{{2,8}}?)(?=さん|様|氏|先生|女士|[\s。、，,.)）]|$)")
#: Fixed list of titles and forms of address, which are not part of a name.
TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Sir Madam Frau Herr Fräulein Mme Mlle Monsieur Madame Sr Sra Srta Señor Señora Don Doña Dott Signor Signora".split())
_TOKEN = re.compile(r"`[^`\n]*`|[A-Za-z_][\w-]*(?:[._][\w-]+)+(?:\(\))?|[^\W\d_]+(?=さん)|\w+|[^\w\s]")
_IDENT = re.compile(r"[`_.]|[a-z][A-Z]|\d[A-Za-z]|[A-Za-z]\d")


def _mask(token: str) -> str:
    if "@" in token or "＠" in token:
        return "<mail>"
    if token.isdigit():
        return "0"
    return "<code>" if _IDENT.search(token) else token.lower()


def _patterns(text: str, start: int, end: int, person: bool, mails: list[tuple[int, int]]) -> list[str]:
    """The two tokens before a candidate and the two after it; up to five where no word is among them."""
    word = lambda t: t == "<mail>" or (t.isalpha() and len(t) > 1)
    left: list[str] = []
    for t in reversed(_TOKEN.findall(text[max(0, start - 80) : start])):
        left.insert(0, _mask(t))
        if len(left) == 5 or (len(left) > 1 and any(map(word, left))):
            break
    right: list[str] = []
    pos = end
    while len(right) < 2 or (len(right) < 5 and not any(map(word, right))):
        m = _TOKEN.search(text, pos, pos + 80)
        if not m:
            break
        mail = next((e for s, e in mails if s <= m.start() < e), None)
        right.append("<mail>" if mail else _mask(m.group()))
        pos = mail or m.end()
    out = []
    if any(map(word, left)) and not (person and left[-1] in ".!?。"):
        out.append("L " + " ".join(left))
    if any(map(word, right)):
        out.append("R " + " ".join(right))
    return out


def _cjk_patterns(text: str, start: int, end: int) -> list[str]:
    after = text[end : end + 2] if not text[end : end + 1].isspace() else ""
    return ["L " + text[max(0, start - 3) : start]] + (["R " + after] if len(after) == 2 and after.isalpha() else [])


def _mask_of(kind: str, value: str) -> str:
    """Inner pattern: the value with its digits alike or, of a mailbox, with its words alike."""
    if kind == "email":
        words = re.sub(r"[a-z0-9]+", lambda m: m.group() if m.group() in ("at", "dot") else "w", value)
        return "S " + re.sub(r"(\W*dot\W*w)+", r"\1", re.sub(r"w(?:[.+_-]*w)+", "w", words))
    return "S " + re.sub(r"[a-z]", "a", re.sub(r"\d", "0", value))


def candidates(text: str, given: frozenset, family: frozenset, full: frozenset) -> list[tuple]:
    """(kind, start, end, value, trust, first part, last part, patterns) of everything in the text that may be personal."""
    found, mails = [], []
    taken = bytearray(len(text))

    def add(kind, start, end, trust, value=None, first=None, last=None):
        patterns = _patterns(text, start, end, kind == "person", mails)
        value = value or re.sub(r"\s+", " ", text[start:end]).lower()
        if kind in ("email", "id_number", "phone"):
            patterns.append(_mask_of(kind, value))
        found.append((kind, start, end, value, trust, first, last, patterns))

    if "@" in text or "＠" in text or "at" in text or "AT" in text:
        for m in _EMAIL.finditer(text):
            rest = text[m.end() : m.end() + 2]
            if not (rest[:1] == ":" and rest[1:].strip()) and text[max(0, m.start() - 3) : m.start()] != "://":
                mails.append(m.span())
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        for s, e in mails:
            add("email", s, e, 1.0 if _PLAIN.fullmatch(text, s, e) else 0.0 if "@" in text[s:e] and "[" not in text[s:e] else LIKELY)
        for m in _EMAIL_LOOSE.finditer(text):
            if not any(taken[m.start() : m.end()]):
                add("email", *m.span(), 0.0)
    shapes = ((_ADDRESS, "address", 1.0), (_ID_STRONG, "id_number", 1.0), (_PHONE_STRONG, "phone", 1.0), (_ID_WEAK, "id_number", 0.0), (_PHONE_WEAK, "phone", 0.0), (_ADDRESS_LOOSE, "address", 0.0))
    for shape, kind, known in shapes:
        for m in shape.finditer(text):
            trust, (s, e) = known, m.span()
            item = m.group()
            digits = sum(c.isdigit() for c in item)
            if any(taken[s:e]) or (kind == "phone" and not (9 if trust else 7) <= digits <= (25 if trust else 15)):
                continue
            if trust or kind == "id_number":
                taken[s:e] = b"\1" * (e - s)
            if trust and ((kind == "phone" and item[0] != "+") or (kind == "address" and _BOX_ONLY.match(item))):
                trust = LIKELY
            add(kind, s, e, 0.5 if kind == "id_number" and m.groups() and m.group(1) else trust)
    for m in _RUN.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for x, y in zip(parts, parts[1:]):
            one, two = x.group(1), y.group(1)
            if one in TITLES or two in TITLES or y.start() - x.end() > 2:
                continue
            trust = (0.0, LIKELY, 1.0)[(one in given) + (two in family)]
            add("person", x.start(), y.end(1), trust, f"{one} {two}", one, two)
    if not text.isascii():
        for name in full:
            at = text.find(name)
            while at >= 0:
                found.append(("person", at, at + len(name), name, 1.0, None, None, _cjk_patterns(text, at, at + len(name))))
                at = text.find(name, at + 1)
        for m in _CJK_NAME.finditer(text):
            if m.group(1) not in full:
                found.append(("person", *m.span(1), m.group(1), 0.0, None, None, _cjk_patterns(text, *m.span(1))))
        for m in _CJK_ALONE.finditer(text):
            if m.group(1) not in full:
                add("person", *m.span(1), 0.0, m.group(1))
        for m in _CASELESS.finditer(text):
            add("person", *m.span(), 0.0, m.group())
    return found


def _scan(names: list[tuple[str, str]]):
    given, family, full = (frozenset(n for n, p in names if p == part) for part in ("given", "family", "full"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, k, *c) for s, k, t in zip(*(b.column(i).to_pylist() for i in range(3))) for c in candidates(t, given, family, full)]
            cols = list(zip(*rows)) or [[]] * 10
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["src", "key", "kind", "s", "e", "value", "trust", "first", "last", "patterns"])

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping accepted candidates of a text the surest stays: by kind, by evidence, the longest, the first."""
    for b in batches:
        out = []
        for src, key, items in zip(*(b.column(i).to_pylist() for i in range(3))):
            spans: list[tuple[int, int]] = []
            for x in sorted(items, key=lambda x: (KINDS.index(x["kind"]), -x["score"], x["s"] - x["e"], x["s"])):
                if all(x["e"] <= s or e <= x["s"] for s, e in spans):
                    spans.append((x["s"], x["e"]))
                    out.append((src, key, x["kind"], x["s"], x["e"]))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["src", "key", "kind", "s", "e"])


def _bound(trusted, values, weighted, rows):
    """Column: Wilson's lower bound of the trusted share, of values or of occurrences, whichever is less."""
    p, n = F.least(trusted / values, weighted / rows, F.lit(1.0)), values.cast("double")
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _scored(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, precision) of each pattern of (keys, value, n, trust) rows: one aggregate with partial sums."""
    sums = edges.groupBy(*keys).agg(F.sum("trust").alias("t"), F.count("*").alias("v"), F.sum(F.col("n") * F.col("trust")).alias("tn"), F.sum("n").alias("r"))
    return sums.select(*keys, _bound(*(F.col(c) for c in ("t", "v", "tn", "r"))).alias("precision"))


def learn(contexts: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, values) of a graph of distinct (kind, value, first, last, patterns, trust, n) rows.

    ``patterns``: (kind, pattern, precision) of the good ones. A pattern is good if the lower bound of the trusted share of
    the values beside it, and of their occurrences, reaches CERTAIN (MASK for a digit mask). ``values``: (kind, value,
    first, last, seed, n, share, trust); a value is trusted by its seed or by the share of its occurrences beside good patterns.
    A pattern or value of any number of rows is an aggregate with partial sums; nothing is collected. Each round's trust
    is written to the checkpoint folder, which cuts the lineage.
    """
    rows = contexts.withColumn("c", F.xxhash64("patterns")).persist()
    values = rows.groupBy("kind", "value").agg(F.max("trust").alias("seed"), F.sum("n").alias("n"), F.max("first").alias("first"), F.max("last").alias("last")).persist()
    exploded = rows.select("kind", "value", "c", "n", F.explode("patterns").alias("pattern")).persist()
    edges = exploded.groupBy("kind", "pattern", "value").agg(F.sum("n").alias("n")).persist()
    trust, good = values.withColumn("trust", F.col("seed")), None
    for _ in range(rounds):
        good = _scored(edges.join(trust.select("kind", "value", "trust"), ["kind", "value"]), "kind", "pattern")
        good = good.where(F.col("precision") >= F.when(F.col("pattern").startswith("S "), MASK).otherwise(CERTAIN)).checkpoint()
        hits = exploded.join(good, ["kind", "pattern"]).select("kind", "value", "c", "n").distinct().groupBy("kind", "value").agg(F.sum("n").alias("hit"))
        share = F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0))
        trust = values.join(hits, ["kind", "value"], "left").select(*values.columns, share.alias("share"), F.greatest("seed", share).alias("trust")).checkpoint()
    for x in (rows, values, exploded, edges):
        x.unpersist()
    return good, trust


def accepted_values(values: DataFrame) -> DataFrame:
    """(kind, value, score) of the values that count: trusted ones, and names both of whose parts belong to trusted names.

    A part counts in its place if the lower bound of the trusted share of all candidates that hold it reaches CERTAIN, so a
    part of mixed use never does, however often it stands in a good place.
    """
    names = values.where("kind = 'person' and first is not null")
    firsts, lasts = (_scored(names.select(p, "value", "n", "trust"), p).where(F.col("precision") >= CERTAIN).select(p) for p in ("first", "last"))
    learned = names.where(F.col("trust") < 1).join(firsts, "first", "left_semi").join(lasts, "last", "left_semi").select("kind", "value", F.lit(1.5).alias("score"))
    sure = values.where((F.col("seed") >= 1) | (F.col("share") >= SHARE)).select("kind", "value", (F.floor("seed") * 2 + F.col("share")).alias("score"))
    return sure.union(learned).groupBy("kind", "value").agg(F.sum("score").alias("score"))


def personal_candidates(texts: DataFrame, names: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(candidates, contexts): everything in the texts that may be personal, and the distinct (value, patterns) with counts."""
    use_shared_dir(texts.sparkSession)
    src = spread(texts.select("src", "key", "text").where("src is not null and key is not null and text != ''").distinct())
    found = src.mapInArrow(_scan(names), "src string, key string, kind string, s int, e int, value string, trust double, first string, last string, patterns array<string>").persist()
    contexts = found.groupBy("kind", "value", "patterns").agg(F.max("trust").alias("trust"), F.count("*").alias("n"), F.max("first").alias("first"), F.max("last").alias("last"))
    return found, contexts


def personal_data(texts: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(src, key, kind, s, e): each item of personal data, from character ``s`` up to ``e`` of its text.

    ``texts`` has (src, key, text); rows with a null among them are ignored, repeated rows count once, empty texts hold
    nothing, texts are read whole. ``names`` is a bounded list of (name, part), part being given, family or full. Kinds:
    email, phone, id_number, address, person. Items don't overlap. Other columns are ignored.
    """
    found, contexts = personal_candidates(texts, names)
    _, values = learn(contexts)
    rows = found.select("src", "key", "kind", "value", "s", "e").join(accepted_values(values), ["kind", "value"])
    return rows.groupBy("src", "key").agg(F.collect_list(F.struct("kind", "s", "e", "score")).alias("items")).mapInArrow(_resolve, "src string, key string, kind string, s int, e int")


def redacted(texts: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(src, key, text): each text with a placeholder such as [EMAIL] in place of each item and nothing else changed.

    Rows with a null src, key or text are left out; repeated rows come once; a key with several texts is refused by no
    one but gets the items of all of them, so keys should be unique.
    """
    base = texts.select("src", "key", "text").where("src is not null and key is not null and text is not null").distinct()
    items = personal_data(base, names).groupBy("src", "key").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind"))).alias("items"))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["e"].alias("at")
    )
    whole = F.aggregate("items", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return base.join(items, ["src", "key"], "left").select("src", "key", F.when(F.col("items").isNull(), F.col("text")).otherwise(whole).alias("text"))
