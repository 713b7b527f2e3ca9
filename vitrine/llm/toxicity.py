"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of their beginnings. Every sentence of a labelled
text that names a group is also read with that term swapped for each other term of its list, and
the squared change of the sentence's score is penalised, so a mention of any group, alone or beside
others, says as much as one of another group or of the neutral word at the head of the list.

Features are all words and beginnings whose evidence for a label passes a level. The level is
chosen by cross-validation inside the training texts; nothing is read off held-out ones.

Null texts count as empty ones. Without a labelled text every score is 0.5. Rows without a key are
scored, never learned from. Extra columns are not looked at, and ``kept`` returns them unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .common import arrow_slices, fold, labelled, slices, texts

#: At most so many labelled texts are fitted, chosen by the hash of their key.
TRAIN_ROWS = 20_000
#: Levels of evidence (deviations of a log odds ratio: 32, 10, 5, 1 and 0.1 %, two-sided) that compete.
LEVELS = (1.0, 1.645, 1.96, 2.576, 3.291)
#: Of the fitted texts so many choose the level, in so many folds.
LEVEL_ROWS, LEVEL_FOLDS = 2_000, 3
#: Weight of the mean squared change of a score, which is small: a change of 0.03 costs as much as 0.9 nats.
SWAP_PENALTY = 1_000.0
RIDGE = 2e-5
REJECT_FROM = 0.7
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Lengths of the beginnings of words that are features besides the words.
STEMS = (4, 5, 6, 7)

# Identity terms that may stand for each other, a neutral word first.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "latinos", "arabs", "africans", "europeans", "americans", "mexicans"),
    ("person", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "gay", "lesbian", "black", "white", "asian", "latino", "arab", "african", "european", "american", "mexican", "jewish", "transgender", "disabled", "deaf", "blind", "old", "young"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "athées", "immigrés", "réfugiés", "noirs", "blancs", "arabes", "homosexuels"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "atheisten", "einwanderer", "flüchtlinge", "schwarze", "weiße", "araber", "schwule"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "ateos", "inmigrantes", "refugiados", "negros", "blancos", "árabes", "gais"),
)


TERMS = frozenset(t for group in IDENTITIES for t in group)
LISTS = {t: group for group in IDENTITIES for t in group}


def features_of(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings: stems carry over to unseen endings.

    Identity terms have no beginnings, which would escape the swaps.
    """
    out = set(WORD.findall(text.lower()))
    words = out - TERMS
    for n in STEMS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass
class Model:
    words: dict[str, float]
    intercept: float

    def score(self, text: str) -> float:
        known = self.words
        logit = self.intercept + sum(known[w] for w in sorted(features_of(text).intersection(known)))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _train_rows(docs: DataFrame, labels: DataFrame, key: str, parts: int, left_out: int, rows: int) -> DataFrame:
    """Labelled texts outside the held-out fold, ``rows`` at most: the broadcast is of that bound."""
    pool = labelled(labels, "toxic").where(fold(F.col("doc_id"), parts) != left_out)
    few = pool.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", key)
    return texts(docs, key).join(F.broadcast(few), key)


@dataclass
class Sample:
    """Encoded texts: their labels, the features of all of them in a row, and which text each is of."""

    y: np.ndarray
    at: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, labels, features) -> Sample:
        sizes = np.array([len(f) for f in features], dtype=np.int64)
        return cls(np.asarray(labels, dtype=float), np.concatenate([*map(np.asarray, features), np.empty(0)]).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes))


@dataclass
class Swaps:
    """Sentences that name a group (``sentences``), and one row per term and term in its place.

    ``added`` is -1 where the other term is in the sentence already.
    """

    sentences: Sample
    sentence: np.ndarray
    removed: np.ndarray
    added: np.ndarray
    share: np.ndarray

    def penalty(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """Mean squared change of the score over swaps, each term's swaps weighing one together; with its gradient."""
        x = self.sentences
        z = bias + np.bincount(x.text, weights=w[x.at], minlength=len(x.y))
        extra = np.where(self.added >= 0, w[self.added], 0.0)
        before, after = _sigmoid(z)[self.sentence], _sigmoid(z[self.sentence] - w[self.removed] + extra)
        change = before - after
        scale = 2 * self.share * change
        here, there = scale * before * (1 - before), scale * after * (1 - after)
        common = np.bincount(self.sentence, weights=here - there, minlength=len(x.y))
        grad = np.bincount(x.at, weights=common[x.text], minlength=len(w))
        grad += np.bincount(self.removed, weights=there, minlength=len(w))
        new = self.added >= 0
        grad -= np.bincount(self.added[new], weights=there[new], minlength=len(w))
        return float(self.share @ change**2), grad, float(common.sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sentence_swaps(text: str) -> list[tuple[set[str], list[tuple[str, str | None]]]]:
    """For each sentence that names a group: its features, and each swap as (term, the other term or None if it is there already)."""
    out = []
    for sentence in SENTENCE.split(text.lower()):
        found = features_of(sentence)
        terms = sorted(found & TERMS)
        if terms:
            out.append((found, [(a, None if b in found else b) for a in terms for b in LISTS[a] if b != a]))
    return out


def _descend(x: Sample, size: int, swaps: Swaps | None, swap_penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic model, by Adam on the whole sample."""
    yes = x.y.sum()
    w, bias = np.zeros(size), np.log((yes + 0.5) / (len(x.y) - yes + 0.5))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        error = _sigmoid(bias + np.bincount(x.text, weights=w[x.at], minlength=len(x.y))) - x.y
        grad = np.bincount(x.at, weights=error[x.text], minlength=size) / len(x.y) + ridge * w
        slope = error.mean()
        if swaps is not None and swap_penalty:
            _, more, bias_more = swaps.penalty(w, bias)
            grad, slope = grad + swap_penalty * more, slope + swap_penalty * bias_more
        full = np.append(grad, slope)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def evidence(yes, no, all_yes, all_no, log=np.log, sqrt=np.sqrt):
    """Deviations of a feature's log odds ratio from 0, from the numbers of texts that have it."""
    odds = lambda hit, of: log((hit + 0.5) / (of - hit + 0.5))
    return (odds(yes, all_yes) - odds(no, all_no)) / sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))


def choose_level(labels: np.ndarray, features: list[np.ndarray], ridge: float, levels: tuple[float, ...] = LEVELS, folds: int = LEVEL_FOLDS, steps: int = 120) -> float:
    """The level whose models lose least on texts they were not fitted on; the highest of equal ones.

    Evidence is counted anew for each fold, from its own training texts.
    """
    lost = np.zeros(len(levels))
    fold_of = np.arange(len(labels)) % folds
    _, at = np.unique(np.concatenate([*features, np.empty(0, np.int64)]), return_inverse=True)
    text = np.repeat(np.arange(len(labels)), [len(f) for f in features])
    size = int(at.max()) + 1 if len(at) else 0
    for f in range(folds):
        train, test = fold_of != f, fold_of == f
        y = labels[train].astype(float)
        if not test.any() or not y.sum() or y.sum() == len(y):
            continue
        own = train[text]
        yes, no = (np.bincount(at[own & (labels[text] == v)], minlength=size) for v in (1, 0))
        strength = np.abs(evidence(yes, no, y.sum(), len(y) - y.sum()))
        number = np.cumsum(train) - 1
        for i, level in enumerate(levels):
            passes = strength >= level
            place = np.cumsum(passes) - 1
            used = passes[at]
            x = Sample(y, place[at[used & own]], number[text[used & own]])
            w, bias = _descend(x, int(passes.sum()), None, 0.0, ridge, steps)
            unseen = used & ~own
            p = _sigmoid(bias + np.bincount(text[unseen], weights=w[place[at[unseen]]], minlength=len(labels))[test])
            lost[i] -= (labels[test] * np.log(p) + (1 - labels[test]) * np.log(1 - p)).sum()
    return levels[len(levels) - 1 - int(np.argmin(lost[::-1]))]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", parts: int = 3, left_out: int = 1, train_rows: int = TRAIN_ROWS,
        swap_penalty: float = SWAP_PENALTY, ridge: float = RIDGE, least_evidence: float | None = None, level_rows: int = LEVEL_ROWS) -> Model:
    """Learn from the labelled texts whose fold (crc32 of the key, modulo ``parts``) is not ``left_out``.

    At most ``train_rows`` of them are fitted, with all features that pass the level (chosen on
    ``level_rows`` of them unless ``least_evidence`` gives it), so what the driver holds is
    bounded by those texts. Without a labelled text every score is 0.5; with one label only, that
    label's rate.
    """
    rows = cut(_train_rows(docs, labels, key, parts, left_out, train_rows))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            texts_seen = Counter(part["label"])
            for text, label in zip(part["text"], part["label"], strict=True):
                seen[label].update(features_of(text))
            out = [(w, seen[0][w], seen[1][w]) for w in seen[0].keys() | seen[1].keys()]
            yield pd.DataFrame([*out, ("", texts_seen[0], texts_seen[1])], columns=["word", "no", "yes"])

    sums = rows.mapInPandas(count, "word string, no long, yes long").groupBy("word").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    total = sums.where("word = ''").first()
    no, yes = (total["no"], total["yes"]) if total else (0, 0)
    if not no or not yes:
        return Model({}, float(np.log((yes + 0.5) / (no + 0.5))))
    level = least_evidence if least_evidence is not None else _level(rows, key, ridge, level_rows)
    strength = F.abs(evidence(F.col("yes"), F.col("no"), yes, no, F.log, F.sqrt))
    chosen = sums.where((F.col("word") != "") & (strength >= level)).select("word")
    place = {w: i for i, w in enumerate(sorted({r["word"] for r in chosen.collect()} | TERMS))}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda found: sorted(place[w] for w in found if w in place)
        for part in slices(batches, "text"):
            rows = []
            for text, label in zip(part["text"], part["label"], strict=True):
                swaps = [(known(found), own) for found, own in sentence_swaps(text)]
                flat = [(i, place[a], -1 if b is None else place[b]) for i, (_, own) in enumerate(swaps) for a, b in own]
                named = [(i, w) for i, (found, _) in enumerate(swaps) for w in found]
                rows.append((label, known(features_of(text)), len(swaps), [i for i, _ in named], [w for _, w in named], *([f[j] for f in flat] for j in range(3))))
            yield pd.DataFrame(rows, columns=["label", "at", "sentences", "named_of", "named", "of", "removed", "added"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, bias = _fit_coded(pd.concat([*batches]), size, swap_penalty, ridge)
        used = np.flatnonzero(w)
        yield pd.DataFrame({"at": np.append(used, -1), "weight": np.append(w[used], bias)})

    # One task holds the coded texts, train_rows at most; the driver gets the model. Sentences are
    # numbered within their text.
    fields = "label int, at array<int>, sentences int, named_of array<int>, named array<int>, of array<int>, removed array<int>, added array<int>"
    size = len(place)
    weights = {r["at"]: r["weight"] for r in rows.mapInPandas(encode, fields).repartition(1).mapInPandas(learn, "at int, weight double").collect()}
    return Model({t: weights[i] for t, i in place.items() if i in weights}, weights[-1])


def _fit_coded(coded: pd.DataFrame, size: int, swap_penalty: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias from coded texts."""
    x = Sample.of(coded["label"], coded["at"])
    start = (coded["sentences"].cumsum() - coded["sentences"]).to_numpy()
    flat = lambda c: np.concatenate([*coded[c], np.empty(0)]).astype(np.int64)
    numbered = lambda c: flat(c) + np.repeat(start, coded[c].str.len())
    sentences = Sample(np.zeros(int(coded["sentences"].sum())), flat("named"), numbered("named_of"))
    swaps = _swaps(sentences, numbered("of"), flat("removed"), flat("added"), len(coded))
    return _descend(x, size, swaps, swap_penalty, ridge, 400)


def _swaps(sentences: Sample, of: np.ndarray, removed: np.ndarray, added: np.ndarray, n_texts: int) -> Swaps | None:
    """The swaps of all sentences; those of one term in one sentence share the weight of a text."""
    if not len(of):
        return None
    term = np.unique(of * (removed.max() + 1) + removed, return_inverse=True)[1]
    return Swaps(sentences, of, removed, added, 1 / np.bincount(term)[term] / n_texts)


def _level(rows: DataFrame, key: str, ridge: float, level_rows: int) -> float:
    """The level of evidence, chosen on ``level_rows`` of the training texts, drawn by the hash of their key."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for part in slices(batches, "text"):
            at = [[xxhash.xxh3_64_intdigest(w) >> 1 for w in sorted(features_of(t))] for t in part["text"]]
            yield pd.DataFrame({"label": part["label"], "at": at})

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coded = pd.concat([*batches])
        yield pd.DataFrame({"level": [choose_level(coded["label"].to_numpy(), [np.asarray(a, dtype=np.int64) for a in coded["at"]], ridge)]})

    few = rows.orderBy(F.xxhash64(F.lit(5), F.col(key)), key, F.xxhash64("text")).limit(level_rows)
    return few.mapInPandas(hashed, "label int, at array<long>").repartition(1).mapInPandas(chosen, "level double").first()["level"]


def score(docs: DataFrame, model: Model, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, the columns in ``keep``, and score (0 to 1) of every row; null texts as empty ones."""
    names = [key, *[c for c in keep if c != key]]
    src = docs.select(F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([src.schema["row"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text"):
            scores = pa.array([model.score(t) for t in part["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([part["row"].cast(arrow.field(0).type), scores], schema=arrow)

    return src.mapInArrow(run, schema).select("row.*", "score")


def kept(docs: DataFrame, model: Model, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows whose text scores below ``reject_from``, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [model.score(t or "") < reject_from for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
