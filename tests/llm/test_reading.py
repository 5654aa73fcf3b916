import os
import random

import pytest

from bibliome.llm import reading as R
from bibliome.llm.words import document_frequencies, is_english, sentence_lengths, words_of

EASY = "frogs bees trees stones clouds birds fish plants towns rivers".split()
MID = "samples surveys vaccines regions climates hospitals patients sequences materials infections".split()
HARD = "photoelectrocatalysts heteroscedasticity immunoglobulins diffeomorphisms transcriptomes glycosyltransferases".split()


def text(level, rng):
    out = []
    while sum(map(len, out)) < 90:
        n = 3 + 5 * level + rng.randrange(3)
        pool = EASY if level == 1 else EASY + MID if level == 2 else MID if level == 3 else MID + HARD if level == 4 else HARD
        out.append([rng.choice(["the", "of", "in", "and", "that"]) if i % 3 == 0 else rng.choice(pool) for i in range(n)])
    return " ".join(" ".join(s).capitalize() + "." for s in out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    truth = {i: 1 + i % 5 for i in range(500)}
    docs = [(i, text(v, rng), "en", "k") for i, v in truth.items()] + [(900, None, "en", "k"), (901, "", "en", "k"), (902, "the frogs", "en", "k"), (903, "les grenouilles vertes " * 30, "en", "k"), (904, text(1, rng), "fr", "k"), (904, text(1, rng), "fr", "k")]
    labels = [(i, min(5, max(1, v + rng.choice([0, 0, 0, 0, 1, -1]))), rng.choice("ab")) for i, v in truth.items() if i % 3 == 0] + [(1, None, "a"), (99999, 3, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, doc_kind string"), spark.createDataFrame(labels, "doc_id bigint, reading_level int, rater string"), truth


def test_levels(spark, corpus):
    docs, labels, truth = corpus
    out = R.reading_levels(docs, labels).collect()
    got = {r.doc_id: r.reading_level for r in out}
    held = [i for i in truth if i % 3]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9
    assert set(got) == set(truth) | {904} and sum(r.doc_id == 904 for r in out) == 2
    profile = R.level_profile(docs, labels).collect()
    assert sum(r.texts for r in profile) >= 500


def test_without_ratings_and_empty(spark, corpus):
    docs, labels, truth = corpus
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs, labels.limit(0)).collect()}
    assert set(got) == set(truth) | {904} and got[0] <= got[4]
    assert R.reading_levels(docs.limit(0), labels).count() == 0


def test_words():
    assert words_of("<p>Don’t go</p> to https://x.y now 12") == ["don’t", "go", "to", "now"]
    assert sentence_lengths("One two three. Four five! Six") == [3, 2]
    assert is_english("the cat of that house".split()) and not is_english("die katze im haus".split()) and not is_english([])


def test_frequencies_cover_all_texts(spark):
    df = spark.createDataFrame([(i, "Alpha beta " + ("gamma" if i % 2 else "")) for i in range(100)] + [(200, None)], "id bigint, text string").repartition(7)
    docs, counts = document_frequencies(df, "text", lambda t: (words_of(t), len(words_of(t)) - 2), 2)
    assert docs == [50, 50] and counts == {"alpha": [50, 50], "beta": [50, 50], "gamma": [0, 50]}
    _, top = document_frequencies(df, "text", lambda t: (words_of(t), 0), 1, most=1)
    assert top == {"alpha": [100]}
    _, often = document_frequencies(df, "text", lambda t: (words_of(t), 0), 1, share=0.6)
    assert often == {"alpha": [100], "beta": [100]}


def test_words_on_no_list_are_outside_every_list():
    f = R.Formula({"sea": 1.0, "law": 5.0}, (), ())
    known, unknown = f.features((["sea", "law"], [2])), f.features((["sea", "xylem"], [2]))
    assert known[4:15] == unknown[4:15] == [0.5] * 11 and unknown[-1] == 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver data")
def test_agreement_on_driver_data(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_label.parquet")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs, labels).collect()}
    rated = [(r.doc_id, r.reading_level) for r in labels.where("reading_level IS NOT NULL").collect() if r.doc_id in got]
    assert sum(got[i] == v for i, v in rated) / len(rated) > 0.75
