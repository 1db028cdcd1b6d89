"""Language ID and toxicity: held-out accuracy on generated tables, what is learnt from, and edge cases."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.llm import common, language_id, letters, ngram_join, queries, toxicity
from driftloom.llm.learning import temperature

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = queries.op9_language_id(spark, FOLDER).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r["held_out"] and truth[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in test)
    assert len(test) > 50 and right >= 0.95 * len(test), (right, len(test))
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in truth[r["doc_id"]]["text"] or "")) and 0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(documents):
    known = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    docs = documents([*known, (900, None, "en", "s"), (901, "", None, "s"), (902, "12 !? 34", "de", "s"), (903, "the dog " * 20_000, None, None), (903, "und die katze", None, "s"), (None, "the cat", "en", "s")])
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert by[900] == by[901] == by[902] == ["und"] and sorted(by[903]) == ["de", "en"] and by[None] == ["en"]
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(documents([(1, "no label", None, "s")])).collect()} == {"und"}


def test_toxicity_held_out(spark):
    """On 2,600 rows to learn from: 280 at the smallest scale hold too few of the telling words."""
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op4_toxicity(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    test = [(r["predicted"], r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    ones, zeros = [s for _, s, y in test if y == 1], [s for _, s, y in test if y == 0]
    ranked = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert ranked >= 0.9, ranked
    assert sum(p for p, _, y in test if y == 0) <= 0.05 * len(zeros)


def test_toxicity_learns_only_from_its_rows(spark, documents):
    rows = [(i, "you are a filthy idiot" if i % 2 else "a pleasant walk by the river", "en", "s") for i in range(90)]
    docs = documents([*rows, (500, None, "en", "s"), (501, "", None, None), (501, "x " * 100_000, None, None), (None, "filthy idiot", "en", "s")])
    held = {i for i in range(90) if zlib.crc32(str(i).encode()) % 3 == 1}
    label = lambda wrong: spark.createDataFrame([(i, 1, (i % 2) ^ (i in held and wrong), "x") for i in range(90)], "doc_id long, quality int, toxic int, text string")
    plain, other = (sorted(map(str, toxicity.score_toxicity(docs, label(w)).collect())) for w in (False, True))
    assert plain == other and len(plain) == docs.count()
    assert toxicity.score_toxicity(docs.limit(0), label(False)).count() == 0
    assert [r["score"] for r in toxicity.score_toxicity(docs, label(False).limit(0)).collect()] == [pytest.approx(0)] * docs.count()


def test_group_mentions_move_scores_little(spark, documents):
    rows = [(i, f"those women are {'stupid' if i % 2 else 'clever'} people of our town {i}", "en", "s") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    test = documents([(1, "the women of our town", "en", "s"), (2, "the men of our town", "en", "s")])
    model = toxicity.fit(documents(rows), labels)
    a, b = (r["score"] for r in toxicity.predict(test, model).orderBy(F.col("doc_id")).collect())
    assert abs(a - b) < 0.05


def test_the_penalty_evens_out_a_planted_bias(spark, documents):
    """Toxic rows name women three times of four, others men: without the penalty the mention alone decides."""
    draw = random.Random(3)
    words = "stupid rotten clever kind quiet tall brown river town market".split()
    rows = []
    for i in range(400):
        toxic = i % 2
        group = "women" if (draw.random() < 0.75) == bool(toxic) else "men"
        rows.append((i, f"{group} of the {' '.join(draw.sample(words[2:], 4))} {draw.choice(words[:2]) if toxic and draw.random() < 0.6 else ''}", "en", "s"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    test = documents([(1, "the women of our town", "en", "s"), (2, "the men of our town", "en", "s")])

    def gap(**options):
        a, b = (r["score"] for r in toxicity.predict(test, toxicity.fit(documents(rows), labels, **options)).orderBy("doc_id").collect())
        return abs(a - b)

    free, held = gap(swap_penalty=0.0), gap()
    assert free > 0.15 and held < free / 4, (free, held)
    assert gap(terms=()) == pytest.approx(free)  # no terms, no counterparts


def test_swapping():
    swapped = toxicity.swapper(toxicity.IDENTITY_TERMS)
    assert swapped("Women and boys. Womens") == "men and girls. Womens" and swapped("Frauen, hommes; mujer") == "männer, femmes; hombre" and swapped("nobody") is None


M = 2**64


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def plain_ngrams(text):
    points = [32]
    for c in text.lower():
        if c.isalpha():
            points.append(ord(c))
        elif points[-1] != 32:
            points.append(32)
    counts = {}
    for i in range(len(points)):
        h = 0
        for n in range(1, 4):
            if i + n > len(points):
                break
            h = (h * int(letters.CODE_BASE) + points[i + n - 1]) % M
            if n > 1 or points[i] != 32:
                f = ((h ^ (h >> 29)) * int(letters.SPREAD) % M) >> 48
                counts[f] = counts.get(f, 0) + 1
    return counts


def plain_words(text):
    out, word = set(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        for k in (0, 4, 5, 6):
            if word and (not k or len(word) > k):
                h = sum(plain_mix(ord(x) + 1) * pow(int(letters.CODE_BASE), i, M) for i, x in enumerate(word[: k or None])) + k
                out.add(plain_mix(h % M) >> 46)
        word = ""
    return out


class PlainFtrl:
    def __init__(self, columns, alpha, l1, l2, beta=1.0):
        self.z, self.n, self.columns, self.alpha, self.l1, self.l2, self.beta = {}, {}, columns, alpha, l1, l2, beta

    def weight(self, f, c):
        z, n = self.z.get((f, c), 0.0), self.n.get((f, c), 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def move(self, gradients):
        for (f, c), (w, g) in gradients.items():
            n = self.n.get((f, c), 0.0)
            self.z[f, c] = self.z.get((f, c), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
            self.n[f, c] = n + g * g

    def scores(self, values):
        return [sum(v * self.weight(f, c) for f, v in values.items()) + self.weight("bias", c) for c in range(self.columns)]

    def learn(self, values, label, importance=1.0, other=None, penalty=0.0):
        s = self.scores(values)
        if self.columns == 1:
            p, truth = [1 / (1 + math.exp(-s[0]))], [float(label)]
        else:
            e = [math.exp(x - max(s)) for x in s]
            p, truth = [x / sum(e) for x in e], [float(c == label) for c in range(self.columns)]
        self.move({(f, c): (self.weight(f, c), importance * v * (p[c] - truth[c])) for f, v in {**values, "bias": 1.0}.items() for c in range(self.columns)})
        if other is not None:
            d = {f: values.get(f, 0.0) - other.get(f, 0.0) for f in {*values, *other} if values.get(f, 0.0) != other.get(f, 0.0)}
            change = sum(x * self.weight(f, 0) for f, x in d.items())
            self.move({(f, 0): (self.weight(f, 0), 2 * penalty * x * change) for f, x in d.items()})


def test_language_scores_against_a_plain_version(documents):
    draw = random.Random(5)
    vocabulary = {"en": "the cat and dog with Über; house river", "de": "der hund und Katze mit haus-fluss", "fr": "le chat et chien avec maison rivière"}
    rows = [(i, " ".join(draw.choices(vocabulary[lang].split(), k=draw.randrange(1, 12))), lang, "s") for i, lang in ((i, draw.choice(list(vocabulary))) for i in range(90))]
    got = {r["doc_id"]: r for r in language_id.identify(documents(rows)).collect()}
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    grams = {r[0]: plain_ngrams(r[1]) for r in rows}
    seen = {}
    for r in known:
        for f in grams[r[0]]:
            seen[f] = seen.get(f, 0) + 1
    idf = lambda f: math.log((1 + len(known)) / (1 + seen.get(f, 0))) + 1
    values = lambda i: {f: 50.0 * c / sum(grams[i].values()) * idf(f) for f, c in grams[i].items()}
    languages = sorted(vocabulary)
    learn, test = [r for i, r in enumerate(known) if i % 5], known[::5]
    model, rng = PlainFtrl(3, 0.3, 0.3, 0.1), np.random.default_rng(7)
    for _ in range(3):
        for i in rng.permutation(len(learn)):
            model.learn(values(learn[i][0]), languages.index(learn[i][2]))
    t = temperature(np.array([model.scores(values(r[0])) for r in test]), np.array([languages.index(r[2]) for r in test]))
    for i, _, _, _ in rows:
        s = [x / t for x in model.scores(values(i))]
        e = [math.exp(x - max(s)) for x in s]
        assert got[i]["score"] == pytest.approx(max(e) / sum(e), rel=1e-6) and got[i]["lang_pred"] == languages[s.index(max(s))]


def test_toxicity_scores_against_a_plain_version(spark, documents):
    draw = random.Random(6)
    words = "stupid rotten awful clever kind quiet river town market women men garden".split()
    rows = [(i, " ".join(draw.choices(words[:6] if i % 3 == 0 else words[3:], k=8)), "en", "s") for i in range(150)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(rows), labels).collect()}
    swapped = toxicity.swapper(toxicity.IDENTITY_TERMS)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    seen = {}
    for r in known:
        for f in plain_words(r[1]):
            seen[f] = seen.get(f, 0) + 1
    values = lambda text: {f: 1.0 for f in plain_words(text) if seen.get(f, 0) >= 3}
    ones = sum(r[0] % 3 == 0 for r in known)
    importance = [len(known) / (2 * (len(known) - ones)), len(known) / (2 * ones)]
    model, rng = PlainFtrl(1, 0.5, 2.0, 0.5), np.random.default_rng(7)
    for _ in range(8):
        for i in rng.permutation(len(known)):
            _, text, _, _ = known[i]
            label = int(known[i][0] % 3 == 0)
            other = swapped(text)
            model.learn(values(text), label, importance[label], None if other is None else values(other), 1.0)
    assert len({round(x, 6) for x in got.values()}) > 10
    for i, text, _, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-model.scores({f: 1.0 for f in plain_words(text)})[0])), rel=1e-6)


def test_examples_are_bounded_by_row(spark, documents):
    a, b = [i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, f"wort {i}", "de", "s") for i in range(300)] + [(b, "word", "en", "s")] * 300
    assert len(language_id.examples(documents(rows), 50)) == 50
    labels = spark.createDataFrame([(a, 1, 1), (b, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.examples(documents(rows), labels, 50, toxicity.IDENTITY_TERMS)) == 2


def test_long_texts_take_little_memory():
    text = " ".join(f"word{i}" for i in range(420_000))[: 4 << 20]
    model = language_id.Model(["a", "b", "c"], np.zeros((1 << language_id.BITS, 3)), np.zeros(3))

    def described():
        made = ngram_join.Minima(common.Words(pa.array([text])))
        made.sketches()
        made.paths(range(8))

    for work in (lambda: model.named([text]), described):
        work()
        tracemalloc.start()
        work()
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()
