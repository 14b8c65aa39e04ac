"""Language identification, ranked search and spelling variants on small fixtures: brute force, held-out accuracy, odd rows."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.llm import language, lexical, spelling

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id, text, lang and columns with names that the operators use themselves
DOCS = "doc_id long, text string, lang string, key string, word string, n int, number string, item string, score string, __found string, id string, entry string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "x", 1, "x", "x", "x", "x", "x", "x") for i, t, g in rows], DOCS)


ODD = [(1, None, "en"), (2, "", "en"), (3, "1234 ... ²\n", "en"), (4, "the", None), (5, "日本語", "en"), (None, "the one", "en"), (6, "the " * 60_000, "en"), (7, "THE ONE", "en"), (7, "THE ONE", "en")]


# --- language ------------------------------------------------------------------------------


def prose(rnd, parts, n):
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n)).capitalize() + "."


SYLLABLES = {"en": "th er in the ing on".split(), "de": "sch ein der ung ä ü".split(), "fr": "eau oi é les que è".split()}


def test_language_of_texts(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, SYLLABLES[g], rnd.randrange(2, 40)), g) for i, g in enumerate(rnd.choices(list(SYLLABLES), [8, 2, 1], k=600), 100)]
    frame = docs(spark, rows + ODD)
    got = language.predict(frame).collect()
    assert len(got) == len(rows) + len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, _t, _g in rows:
        assert by[i][0].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(by[i][0].lang_pred, g) for i, _t, g in rows if by[i][0].held_out]
    assert len(held) > 80
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    for i in (1, 2, 3):
        assert (by[i][0].lang_pred, by[i][0].score) == ("und", 0.0)
    assert by[5][0].lang_pred in SYLLABLES  # letters without evidence: the most frequent language
    assert by[4][0].lang_pred == by[6][0].lang_pred == "en"
    assert by[7][0] == by[7][1]
    assert not by[None][0].held_out
    assert language.predict(frame.limit(0)).count() == 0
    unlabelled = language.predict(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_predictions_come_from_learnt_rows_only(spark):
    """Labels of held-out rows don't matter, and a label is no input of its own row."""
    rnd = random.Random(5)
    rows = [(i, prose(rnd, SYLLABLES[g], 20), g) for i, g in enumerate(rnd.choices(list(SYLLABLES), k=200))]
    frame = docs(spark, rows)
    out = language.held_out(F.col("doc_id"))
    lied = frame.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(str, language.predict(frame).collect())) == sorted(map(str, language.predict(lied).collect()))


def test_words_before_ngrams_and_bounded_memory(spark, monkeypatch):
    rows = [(i, t, g) for i, (t, g) in enumerate([("gift gift present", "en"), ("gift giftig", "de")] * 40)]
    model = language.fit(docs(spark, rows))
    scorer = language.Scorer(model)
    en, de = model.languages.index("en"), model.languages.index("de")
    known = model.table[model.rows[0]["gift"]]
    assert known[de] < known[en]  # two of three words there, one of two here
    assert scorer("giftig")[0] == "de"
    assert scorer("giftiges")[0] == "de"  # unseen: the longest n-grams that are known
    assert scorer("presents presenting")[0] == "en"
    monkeypatch.setattr(language, "REMEMBERED", 3)
    monkeypatch.setattr(language, "AT_ONCE", 4)
    few = language.Scorer(model)
    text = " ".join(f"gift{chr(97 + k % 26)}{chr(97 + k // 26)} present" for k in range(60))
    assert few(text) == pytest.approx(scorer(text)) or few(text)[0] == scorer(text)[0]
    assert len(few.added) <= 3 + 4


# --- ranked search -------------------------------------------------------------------------


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_ranks(rows, items, k):
    terms = [collections.Counter(TERM.findall((t or "").translate(UP))) for _i, t, _g in rows]
    sizes = [sum(c.values()) for c in terms]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _t, _g), c, n in zip(rows, terms, sizes, strict=True):
            s = 0
            for t in TERM.findall((text or "").translate(UP)):
                if c[t]:
                    m = 25 + 75 * n * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_terms", [200_000, 12])
def test_ranked_search(spark, slice_terms, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 40)
    rnd = random.Random(9)
    words = ["the", "THE", "a", "ab", "É", "é", "straße", "x1", "日本", "it's", "then", "\x00the\x7f", "n_m"]
    rows = [(i, rnd.choice([" ", "--", "\n"]).join(rnd.choices(words, k=rnd.randrange(0, 12))), "x") for i in range(120)]
    rows += [(500 + i, "ab the a", "x") for i in range(30)] + [(500, "ab the a", "x")] + ODD
    items = [(1, "the ab the"), (2, None), (3, ""), (4, "absent words"), (5, "日本 Straße é"), (5, "x1"), (6, " ".join(words)), (None, "a")]
    asked = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, key string, rank string")
    got = lexical.search(docs(spark, rows).repartition(5), asked, k=10, slice_terms=slice_terms).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str) == brute_ranks(rows, items, 10)
    assert lexical.search(docs(spark, rows), asked.limit(0)).count() == 0
    assert lexical.search(docs(spark, []), asked).count() == 0


# --- spelling ------------------------------------------------------------------------------


def brute_variants(rows, least_length, least_n, typo):
    counts = collections.Counter()
    for i, t, _g in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo and h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(close[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], len(close[w]), form[w], n.get(form[w]), root(w)) for w in n}


@pytest.mark.parametrize(("block", "together"), [(2048, 256), (7, 256), (3, 5)])
def test_spelling_variants(spark, block, together, monkeypatch):
    monkeypatch.setattr(spelling, "TOGETHER", together)
    monkeypatch.setattr(spelling, "STRIP", 4)
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abé", [5, 3, 1], k=rnd.randrange(3, 8))) for _ in range(120)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "Abcab", "àbcab", "ÀBCAB", "ß×÷ÿb", "x" * 400, "x" * 399, "x" * 200 + "y" + "x" * 199]
    weights = [rnd.choice([1, 2, 4, 9, 30]) for _ in words]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 40))), "x") for i in range(60)]
    rows += [(None, "aaaaa-aaaab_aaaab1aaaab", "x"), (3, None, "x"), (4, "", "x"), (5, " ".join(["aaaab"] * 20_000), "x"), (5, "x" * 400, "x"), (6, "x" * 399, "x")] + ODD
    got = spelling.variants(docs(spark, rows), least_n=2, typo=5, block=block).collect()
    want = brute_variants(rows, 5, 2, 5)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    assert len(got) == len(want)
    assert any(form and root != form for _w, _n, _c, form, _f, root in want)
    assert spelling.variants(docs(spark, []), block=block).count() == 0


def test_long_chains_of_forms(spark):
    steps = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [(f"v{i}", "w000") for i in range(500)]
    ends = spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect()
    assert len(ends) == 540
    assert {r.root for r in ends} == {"w040"}
