"""Each stage, and the chain, against brute force on a small corpus; columns of any name."""

import hashlib
import random

import pytest
import sentencepiece

import corpus_pipeline
from vitrine.llm import pii, sentencepiece_codec, toxicity
from vitrine.session import scratch_path

CLASHES = ["_kept", "_rows", "_held", "kept", "rows", "row", "id", "t", "held", "found", "spans", "_email", "_base", "n_shingles", "component_id", "item_id", "h", "label", "score", "doc"]


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))


def shingles(t):
    w = (t or "").encode().lower().split()
    return set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(word(rng) for _ in range(n))
    docs = {i: text(rng.randrange(1, 90)) for i in range(1, 80)}
    for i in range(80, 140):  # toxic and labelled clean ones
        docs[i] = text(30) + (" you vile scum " if i % 3 == 0 else " dear friends ") + text(10)
    base = text(60).split()
    for i in range(140, 160):  # near copies at growing distances
        own = list(base)
        for j in rng.sample(range(60), (i - 140) // 4):
            own[j] = word(rng)
        docs[i] = " ".join(own)
    for i in range(160, 170):
        docs[i] = docs[i - 120]
    items = {i: text(14) for i in range(1, 6)}
    for i in range(170, 180):
        docs[i] = text(40) + " " + items[i % 5 + 1] + " " + text(40)
    for i in range(180, 190):
        docs[i] = f"{text(20)} write to u{i}@mail.com or +49 151 2345{i} from 10.0.0.{i} {text(5)}"
    docs |= {190: "", 191: None, 192: " \n "}
    rows = [(i, t, "en", "src", len(t or ""), *(f"{c} {i}" for c in CLASHES)) for i, t in docs.items()] + [(None, text(20), None, None, 0, *([None] * len(CLASHES))), (5, docs[5], "en", "src", 0, *(["again"] * len(CLASHES)))]
    folder = scratch_path(spark, "corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(80 <= i < 140 and i % 3 == 0)) for i in range(60, 140)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def kept_of_copies(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_chain_against_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs, labels)
    one = stages["toxicity"](spark, docs, folder)
    want = [r for r in docs.collect() if model.score(r.text or "") < toxicity.REJECT_FROM]
    assert sorted(map(str, one.collect())) == sorted(map(str, want)) and one.columns == docs.columns
    assert {i for i in range(80, 140) if i % 3 == 0} & set(by_id(one)) == set() and len(want) >= 170

    two = stages["near_duplicates"](spark, one, folder)
    alive = kept_of_copies(want)
    assert {r.doc_id for r in two.collect()} - {None} == alive and two.columns == docs.columns
    assert two.count() == len(alive) + 1 and not alive & set(range(160, 170))

    three = stages["decontamination"](spark, two, folder)
    rows = two.collect()
    held = {r.doc_id for r in rows for t in items.values() if r.doc_id is not None and 100 * len(shingles(t) & shingles(r.text)) >= 75 * len(shingles(t))}
    assert held == set(range(170, 180)) and sorted(map(str, three.collect())) == sorted(str(r) for r in rows if r.doc_id not in held)

    four = stages["pii"](spark, three, folder)
    before, after = by_id(three), by_id(four)
    spans = by_id(pii.find(three))
    assert set(before) == set(after) and four.columns == docs.columns
    for i, r in before.items():
        want_text, at = "", 0
        for s in sorted(spans[i].spans, key=lambda s: (s.s, s.e)):
            if s.s >= at:
                want_text += r.text[at : s.s] + f"[{s.kind.upper()}]"
            at = max(at, s.e)
        assert after[i].text == (want_text + r.text[at:] if spans[i].spans else r.text)
        assert all(after[i][c] == r[c] for c in CLASHES) and (after[i].n_chars == len(after[i].text) if r.text is not None else after[i].n_chars is None)
    assert all("[EMAIL]" in after[i].text and "[IP]" in after[i].text for i in range(180, 190))

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    final = by_id(corpus_pipeline.run(spark, folder))
    assert set(final) == set(after)
    for i, r in after.items():
        ids = sp.encode(r.text or "")
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (final[i].n_tokens, final[i].ids_sha256, final[i].decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))


def test_the_chain_on_empty_tables(spark, corpus):
    folder, _ = corpus
    empty = scratch_path(spark, "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
