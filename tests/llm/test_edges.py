"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns; small brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from vitrine.llm import bit_codes, decontaminate, interpolated_lm, main_text, near_duplicates, pii, rule_quality, sentencepiece_codec, toxicity, warc
from vitrine.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, n_chars long, n int, digest string, band long, label int, score double, rep long"
LABELS = "doc_id long, quality int, toxic int"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = {i: sentence(rng, rng.randrange(1, 120)) for i in range(1, 60)}
    base = sentence(rng, 90).split()
    for i in range(60, 90):  # near copies at all distances, and exact ones
        own = list(base)
        for j in rng.sample(range(90), (i - 60) // 3):
            own[j] = word(rng)
        texts[i] = " ".join(own)
    for i in range(90, 100):
        texts[i] = texts[i - 60]
    texts |= {100: "", 101: None, 102: " \t\n", 103: sentence(rng, 30_000), 104: "a b c", 105: "A  B\tC", 106: "one"}
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", len(t or ""), 1, "x", 2, 3, 0.5, 4) for i, t in corpus.items()]
    rows += [(None, "no id here at all", None, None, None, None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(1, 107)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1)]
    return spark.createDataFrame(rows, LABELS)


def shingles(t):
    w = (t or "").encode().lower().split()
    return set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_against_all_pairs(docs, empty, corpus):
    sets = {i: shingles(t) for i, t in corpus.items()}
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
    out = near_duplicates.near_duplicates(docs).toPandas()
    assert len(out) == docs.count()
    for r in out.itertuples():
        if pd.isna(r.doc_id):
            assert pd.isna(r.component_id) and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_hidden_links_are_found_in_small_blocks(spark, monkeypatch):
    """Centre of a bucket far from two members that are linked with each other; blocks of four rows."""
    monkeypatch.setattr(near_duplicates.hidden_links, "__defaults__", (4,))
    rng = random.Random(8)
    shared, rows = sentence(rng, 60), []
    for family in range(12):
        tail = sentence(rng, 16).split()
        for copy in range(3):
            own = list(tail)
            own[copy] = word(rng)
            rows.append((family * 3 + copy, shared + " " + " ".join(own)))
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = {i: shingles(t) for i, t in rows}
    linked = defaultdict(set)
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                linked[a].add(b)
    for a, others in linked.items():
        assert all(out.component_id[a] == out.component_id[b] for b in others)


def test_sentencepiece_is_the_library(docs, empty, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = sentencepiece_codec.encode_decode(docs).toPandas()
    assert len(out) == docs.count()
    for r in out.itertuples():
        if not pd.isna(r.doc_id):
            ids = sp.encode(corpus[r.doc_id] or "")
            assert list(r.ids) == ids and r.decoded == sp.decode(ids)
    table = sentencepiece_codec.ChunkTable(open(sentencepiece_codec.default_model(), "rb").read(), most_chars=50)
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab \t\n▁é中🎉\x00 ﬁ") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for start in range(0, 3000, 100):
        part = odd[start : start + 100]
        ids, back = table.code(pd.Series(part))
        assert ids == sp.encode(part) and back == sp.decode(ids)
    assert sentencepiece_codec.digests(sentencepiece_codec.encode_decode(empty)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if fine(k, m[0])]


def test_base_spans_against_regular_expressions(spark, empty):
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "x@", "@y.z", "1.2.3.4", "300.1.1.1", "00012.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
            "+49", " ", ".", "-", "é", "中", "+", "8", "\n", "token = \"" + "0af1" * 10 + "\"", "jo [at] mail [dot] com", "017 555 7713"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["", None, "7" * 100_000, "a" * 100_000 + "@", "1." * 20_000, "+1" + " " * 50_000, "a.b@c.d," * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.digests(pii.find(df)).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert out.base_sha256[i] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(out.spans[i].split(",")) | {""} if want else True
        assert out.n_email[i] == sum(w.startswith("email") for w in want)
    assert pii.digests(pii.find(empty)).count() == 0


def test_redaction_leaves_no_span(spark, docs):
    df = spark.createDataFrame([(1, "to a@b.com, é 1.2.3.4 end", 3), (2, "clean", 5), (None, None, None)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "to [EMAIL], é [IP] end" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[None].text is None
    assert pii.redact(docs).columns == docs.columns


def test_reliabilities_prefer_the_agreeing_labelers():
    posterior, _ = pii.reliabilities([("email", (1, 1, 1, 0, 0), 50), ("email", (-1, -1, -1, 0, 0), 50), ("email", (1, -1, -1, 0, 0), 1)])
    assert posterior["email", (1, 1, 1, 0, 0)] > 0.9 > 0.5 > posterior["email", (1, -1, -1, 0, 0)]


def test_contaminated_against_sets(spark, docs, empty, corpus):
    held = " ".join(corpus[103].split()[20_000:20_040])
    items = [(1, held), (2, " ".join(corpus[70].split()[3:30])), (3, "a b c"), (4, "not there at all in any text here"), (5, ""), (6, None), (None, held), (1, held),
             (7, " ".join(corpus[103].split()[5:14])), (8, held + " " + sentence(random.Random(9), 8))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(docs, bench).toPandas()
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in out.itertuples()}
    want = {}
    for i, t in items:
        if i is not None and (s := shingles(t)):
            for d, text in corpus.items():
                both = len(s & shingles(text))
                if 100 * both >= 75 * len(s):
                    want[d, i] = (len(s), both)
    assert got == want and (103, 8) in want
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.count() == docs.where(f"doc_id is null or doc_id not in ({','.join(str(d) for d, _ in want)})").count()
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def test_many_items_of_one_document_in_short_lists(spark, monkeypatch):
    """Hundreds of items from one template that a document holds, checked a few at a time."""
    monkeypatch.setattr(decontaminate, "LIST_ITEMS", 7)
    rng = random.Random(31)
    template = sentence(rng, 8)
    items = [(i, f"{template} {word(rng)}{i}") for i in range(200)]
    text = " ".join(t for _, t in items[:120]) + " " + sentence(rng, 50)
    docs = spark.createDataFrame([(1, text), (2, template), (3, sentence(rng, 30))], "doc_id long, text string")
    out = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i): len(shingles(t) & shingles(x)) for d, x in ((1, text), (2, template)) for i, t in items if 100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(t))}
    assert {(r.doc_id, r.item_id): r.n_shared for r in out} == want and len(want) > 200


def test_language_model_against_counts(docs, empty, corpus):
    out = interpolated_lm.score(docs).toPandas()
    assert len(out) == docs.count()
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in corpus.items()}
    seen = defaultdict(int)
    rows = [*[t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10], *[tokens[1]] * (2 * (zlib.crc32(b"1") % 10 > 0)), b"no id here at all".split() + [None]]
    for t in rows:
        for w in t:
            seen[w] += 1
    total, words = sum(seen.values()), len(seen)
    for r in out[out.doc_id.notna()].itertuples():
        t = tokens[r.doc_id]
        want = sum(np.log10((seen.get(w, 0) + 0.1) / (total + 0.1 * (words + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(seen.get(w, 0) > 0 for w in t), total)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0
    assert interpolated_lm.score(empty).count() == 0


def test_mixture_weights_follow_the_better_estimate():
    w = interpolated_lm._learn([(3, [8, 40], 900), (3, [8, None], 100)], 3)[3]
    assert abs(w.sum() - 1) < 1e-9 and w[2] > 0.8


def test_quality_and_toxicity_edges(docs, empty, labels):
    scored = rule_quality.quality(docs, labels).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    assert rule_quality.quality(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert rule_quality.quality(empty, labels).count() == 0
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.kept(docs, toxicity.Model({}, -5.0)).count() == docs.count()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_swapped_terms_end_with_one_small_weight(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        # One group is named mostly in bad texts: without the penalty its name would be a sign.
        group = "muslims" if bad or i % 10 == 1 else "christians"
        rows.append((i, f"{sentence(rng, 12)} {group} {'scum' if bad else 'friends'} {sentence(rng, 5)}"))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    fair, plain = toxicity.fit(docs, marks), toxicity.fit(docs, marks, swap_penalty=0.0)
    gap = lambda m: abs(m.words.get("muslims", 0) - m.words.get("christians", 0))
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.score("muslims friends") < 0.5 < fair.score("christians scum")
    assert abs(fair.score("friends met muslims here") - fair.score("friends met christians here")) < 0.05


def test_tree_paths_become_rules():
    text = "Model\n  If (feature 0 <= 1.5)\n   If (feature 2 <= -3.0E-4)\n    Predict: 0.0\n   Else (feature 2 > -3.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    assert rule_quality.tree_rules(text) == [((0, "<=", 1.5),), ((0, "<=", 1.5), (2, "<=", -3e-4)), ((0, "<=", 1.5), (2, ">", -3e-4)), ((0, ">", 1.5),)]


PAGES = [
    ("<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>The <b>first</b>\n par.<p>Sh.</p><script>var t='</p><p>';</script><div class='ad box'>Buy</div>"
     "<form>Name</form><p title='a > b'>Last.</article><footer>&copy; x</footer>", "A & B\n\nThe first par.\n\nSh.\n\nLast."),
    ("<article><p>Cut off in <i>the", "Cut off in the"), ("<article><p>One</p><section id=comments><p>Me too</p></section></article>", "One"),
    ("<main><header>Top</header><p>Text.</p></main><p>Other</p>", "Text."), (None, ""), ("", ""), ("<!-- <p>no</p> --><nav>a</nav>", ""), ("<article><p>x<", "x<"),
    ("<div>" * 3000 + "<p>" + "long text without article markup " * 5 + "</p><p>Short.</p>", "long text without article markup " * 4 + "long text without article markup\n\nShort."),
    ("<ul>" + "<li><a href=x>Link text of a menu</a></li>" * 40 + "</ul><p>" + "w " * 60 + "</p>", ("w " * 60).strip()),
]


def test_main_text(spark, empty):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in main_text.extract(df).collect()}
    assert out == {**{i: t for i, (_, t) in enumerate(PAGES)}, None: ""}
    assert main_text.extract(df.limit(0)).count() == 0


def test_unmatched_end_tags_take_linear_time():
    import time

    for page in ("<span>" * 100_000 + "</b>" * 100_000, "<b><div>" + "<span>" * 50_000 + "</b>" * 50_000, "<p>" * 50_000 + "</i>" * 50_000):
        start = time.process_time()
        main_text.main_text(page + "<p>" + "long text at the end of it all " * 5)
        assert time.process_time() - start < 2
    # The innermost open tag is closed, unless a container is open inside it.
    assert [t for t, *_ in main_text.lines("<b>one<div>two</b>three</div></b>four") if t] == ["one", "twothree", "four"]


def test_archive_round_trip(spark):
    rows = [(1, "u\r\nX: y", "same"), (2, "u", "same"), (5, "u", "same"), (3, "u", ""), (4, "u", None), (6, "u", "é" * 10_000), (None, None, "lone"), (7, "u", "one"), (7, "u", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write(df, path)
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    top = {"same": 5, "": 4, "é" * 10_000: 6, "lone": None, "one": 7}
    for r in back:
        text = r.payload.decode()
        assert r.record_type == ("response" if r.page_id == top[text] else "revisit")
        assert r.refers_to == (None if r.record_type == "response" else top[text])
        assert r.payload_bytes == len(r.payload) and bytes(r.record).endswith((bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n")
        assert b"\r\nX: y" not in bytes(r.record)
        assert (b"\r\nWARC-Profile: http://netpreserve.org/" in bytes(r.record)) == (r.record_type == "revisit")
    path = scratch_path(spark, "warc")
    warc.write(df, path, min_bytes=10**6)
    assert warc.read(spark, path).where("record_type = 'revisit'").count() == 0


def test_nearest_vectors_against_distances(spark):
    rng = np.random.default_rng(4)
    e = rng.standard_normal((700, 16))
    e[50:90] = e[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(e)] + [(900, None), (901, [0.0] * 16), (902, [None] * 16), (903, [float("nan")] * 16), (904, [1.0]), (None, [1.0] * 16), (5, [float(x) for x in e[5]])]
    index, centre, bits = bit_codes.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = bit_codes.search(index, index.where("vec_id % 10 = 0"), centre, bits, query_block=16, vector_block=100).toPandas()
    hit = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((e - e[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(700), d))[:10]
        g = g.sort_values("rank")
        hit += len(set(want) & set(g.vec_id))
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id])
    assert out.query_id.nunique() == 70 and hit >= 0.98 * 700
    # An index per length; of a repeated id the smaller vector counts.
    mixed = [(i, [float(x) for x in rng.standard_normal(3 if i % 4 else 5)]) for i in range(60)]
    mixed += [(7, [9.0, 9.0, 9.0]), (7, [-9.0, 9.0, 9.0])]
    found = [bit_codes.search(x, x, c, b).toPandas() for x, c, b in bit_codes.build_all(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"))]
    vectors = dict(mixed) | {7: min(v for i, v in mixed if i == 7)}
    assert len(found) == 2 and sum(f.query_id.nunique() for f in found) == 60
    for f in found:
        for r in f.itertuples():
            a, b = np.array(vectors[r.query_id]), np.array(vectors[r.vec_id])
            assert len(a) == len(b) and abs(np.linalg.norm(a - b) - r.score) < 1e-12
    none, centre, bits = bit_codes.build(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert bit_codes.search(none, none, centre, bits).count() == 0
