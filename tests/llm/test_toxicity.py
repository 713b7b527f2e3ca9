"""The swap penalty on sentences that are really swapped, and a level chosen without held-out texts."""

import random
import zlib

import numpy as np

from vitrine.llm import toxicity
from vitrine.llm.toxicity import LISTS, TERMS, features_of

WORDS = ["good", "bad", "friends", "house", "women", "men", "muslims", "christians", "person", "gay", "people", "scum"]


def swapped_scores(texts, model):
    """Mean squared change, by writing out every swapped sentence; the swaps of one term in one sentence weigh one."""
    total = 0.0
    for text in texts:
        for sentence in toxicity.SENTENCE.split(text.lower()):
            words = sentence.split()
            for a in sorted(set(words) & TERMS):
                others = [b for b in LISTS[a] if b != a]
                before = model.score(sentence)
                total += sum((before - model.score(" ".join(b if w == a else w for w in words))) ** 2 for b in others) / len(others)
    return total / len(texts)


def coded(texts, place):
    swaps = [s for t in texts for s in toxicity.sentence_swaps(t)]
    known = lambda found: sorted(place[w] for w in found if w in place)
    flat = [(i, place[a], -1 if b is None else place[b]) for i, (_, own) in enumerate(swaps) for a, b in own]
    sentences = toxicity.Sample.of(np.zeros(len(swaps)), [known(f) for f, _ in swaps])
    return toxicity._swaps(sentences, *(np.array([f[j] for f in flat]) for j in range(3)), len(texts))


def test_the_penalty_is_that_of_swapped_sentences():
    rng = random.Random(1)
    texts = [". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))) for _ in range(3)) for _ in range(40)]
    place = {w: i for i, w in enumerate(sorted(set().union(*map(features_of, texts)) | TERMS))}
    w = np.random.default_rng(2).normal(size=len(place))
    swaps = coded(texts, place)
    value, grad, slope = swaps.penalty(w, 0.3)
    assert abs(value - swapped_scores(texts, toxicity.Model({t: w[i] for t, i in place.items()}, 0.3))) < 1e-9 and value > 0.01
    for i in random.Random(3).sample(range(len(w)), 25):
        step = np.zeros(len(w))
        step[i] = 1e-5
        assert abs((swaps.penalty(w + step, 0.3)[0] - swaps.penalty(w - step, 0.3)[0]) / 2e-5 - grad[i]) < 1e-6
    assert abs((swaps.penalty(w, 0.3 + 1e-5)[0] - swaps.penalty(w, 0.3 - 1e-5)[0]) / 2e-5 - slope) < 1e-6


def corpus(n, seed):
    rng = random.Random(seed)
    noise = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = rng.sample(noise, 12) + (["vile"] if bad and rng.random() < 0.8 else []) + (["scum"] if bad and rng.random() < 0.6 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_the_level_drops_noise_and_keeps_words_of_any_number():
    rows, labels = corpus(900, 5)
    features = [np.array([zlib.crc32(w.encode()) for w in sorted(features_of(t))]) for _, t in rows]
    level = toxicity.choose_level(np.array([x for *_, x in labels]), features, toxicity.RIDGE)
    assert level >= 2.5  # hundreds of words without meaning
    assert toxicity.choose_level(np.array([1, 1]), features[:2], toxicity.RIDGE) in toxicity.LEVELS


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lambda marks: spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert flipped != labels
    one, two = toxicity.fit(docs, table(labels)), toxicity.fit(docs, table(flipped))
    assert one.words == two.words and one.intercept == two.intercept and one.score("vile scum") > 0.7 > one.score("w1 w2")


def test_rows_pass_with_any_columns(spark):
    rows = [(2**60 + 1, "vile", 1, "a", 0.5, 3), (None, "good", None, None, None, None), (3, None, 2, "b", 0.1, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, row string, score double, _text int")
    model = toxicity.Model({"vile": 5.0}, -1.0)
    assert sorted(map(tuple, toxicity.kept(docs, model).collect()), key=str) == sorted(rows[1:], key=str)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, keep=("row", "label")).collect()}
    assert set(got) == {2**60 + 1, None, 3} and got[2**60 + 1] > 0.9
