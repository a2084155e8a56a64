"""Toxicity scores of a counterfactual-regularised linear classifier."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import batch_of, cut, decoded, map_rows, text_rows

#: Labelled texts that a fit takes at most.
MAX_TEXTS = 6_000
#: Bytes that the texts of a fit have together at most; the first by the order of a hash are taken.
MAX_BYTES = 64_000_000
#: Distinct features that a fit keeps at most, the most frequent first.
MAX_FEATURES = 300_000
#: Cached words of a task before the cache starts anew.
CACHE_ENTRIES = 200_000

#: Terms that name groups; those of a line can stand in for one another.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_WORDS = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*").findall


def word_features(word: str) -> tuple[str, ...]:
    """A lower-case word and its beginnings of 4, 5 and 7 letters, marked as such."""
    return (word, *[word[:n] + "*" for n in (4, 5, 7) if len(word) > n])


def features(text: str) -> set[str]:
    """The features that a text holds, each once; none for an empty text."""
    return {f for w in set(_WORDS(text.lower())) for f in word_features(w)}


def swapped(text: str, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> str | None:
    """The text with each identity term replaced by the next of its group; None if it has none."""
    turn = {a: g[(i + 1) % len(g)] for g in groups for i, a in enumerate(g)}
    words = set(_WORDS(text.lower()))
    if words.isdisjoint(turn):
        return None
    return regex.sub(r"[\p{L}\p{M}]+", lambda m: turn.get(m[0].lower(), m[0]), text)


def mentions(text: str, number: int, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> str:
    """The text with one identity term set among its words; term and place depend on `number`.

    A labelled sentence without a term becomes one that can be swapped; what
    it says of the group is nothing, so its label stays.
    """
    terms, words = [t for g in groups for t in g], text.split(" ")
    if not terms:
        return text
    at = zlib.crc32(str(number).encode()) % (len(words) + 1)
    return " ".join([*words[:at], terms[number % len(terms)], *words[at:]])


@dataclass
class Model:
    """Weights of the features that the fit left non-zero, and the intercept."""

    weights: dict[str, float]
    intercept: float

    def score(self, text: str) -> float:
        """The probability of label 1."""
        z = self.intercept + sum(sorted(map(self.weights.__getitem__, features(text) & self.weights.keys())))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of all entries."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return row, np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)


def fit(examples: list[tuple[str, int]], counterfactual: float = 1.0, sparsity: float = 0.02, ridge: float = 1e-4, least_texts: int = 4, rounds: int = 300, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> Model:
    """Logistic loss + counterfactual * squared change of the log-odds under identity swaps + elastic net.

    Terms that a swap exchanges come from `groups`.  Sentences without one
    are given one first (`mentions`) and swapped then, so the penalty holds
    for every group, whether the labelled texts mention it or not: it keeps
    the weights of all its terms, and of what their beginnings share with
    other words, at one value.

    The weight of the absolute values is `sparsity` over the root of the
    number of examples.  Solved by accelerated proximal gradient steps.  The swapped texts carry no
    label of their own; what they add is the penalty that makes a swap leave
    the score as it was.  Without examples of both labels the model is the
    base rate.
    """
    y = np.array([label for _, label in examples], float)
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < rate < 1:
        return Model({}, 20.0 if rate == 1 else -20.0)
    df: Counter[str] = Counter()
    changed: list[tuple[str, str]] = []
    for i, (text, _) in enumerate(examples):
        df.update(features(text))
        # What a text and its swap share cancels out: for a text without a term the planted term alone will do.
        before = text if swapped(text, groups) is not None else mentions("", i, groups)
        if (after := swapped(before, groups)) is not None:
            changed.append((before, after))
            df.update(features(after) if before is text else features(before) | features(after))
    frequent = sorted((f for f, k in df.items() if k >= least_texts), key=lambda f: (-df[f], f))
    names = sorted(frequent[:MAX_FEATURES])
    del df, frequent
    index = {f: i for i, f in enumerate(names)}

    def numbered(text):
        return np.fromiter(sorted(index[f] for f in features(text) & index.keys()), np.int32)

    sets = [numbered(t) for t, _ in examples]
    pairs = [(numbered(before), numbered(after)) for before, after in changed]
    r, c = _csr(sets)
    pr, pc = _csr([np.setdiff1d(a, b) for a, b in pairs])
    mr, mc = _csr([np.setdiff1d(b, a) for a, b in pairs])
    del sets, index
    n, p = len(y), len(names)

    def forward(w):
        return np.bincount(r, w[c], n)

    def change(w):
        return np.bincount(pr, w[pc], len(pairs)) - np.bincount(mr, w[mc], len(pairs)) if pairs else np.zeros(0)

    def gradient(w, b):
        e = 1 / (1 + np.exp(-np.clip(forward(w) + b, -40, 40))) - y
        g = np.bincount(c, e[r], p) / n + ridge * w
        if pairs:
            d = change(w)
            g += 2 * counterfactual / len(pairs) * (np.bincount(pc, d[pr], p) - np.bincount(mc, d[mr], p))
        return g, e.mean()

    top = np.random.default_rng(1).random(p)  # the largest curvature, by power iteration
    norm = 1.0
    for _ in range(12):
        top /= np.linalg.norm(top)
        h = np.bincount(c, forward(top)[r], p) / n / 4
        if pairs:
            d = change(top)
            h += 2 * counterfactual / len(pairs) * (np.bincount(pc, d[pr], p) - np.bincount(mc, d[mr], p))
        norm, top = float(np.linalg.norm(h)), h
    step = 1 / (1.2 * norm + ridge + 1e-9)
    w, b, shrink = np.zeros(p), math.log(rate / (1 - rate)), sparsity / math.sqrt(n)
    v, vb, t = w, b, 1.0
    for _ in range(rounds):
        g, gb = gradient(v, vb)
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
        new_b = vb - 1.0 * gb
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b
        w, b, t = new, new_b, t2
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(b))


def sample_of(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS, fold: int = 2, folds: int = 4, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most `max_texts` labelled rows whose crc32(doc_id) mod `folds` is not `fold`.

    Taken by the order of a hash, as long as their texts have `max_bytes`
    bytes together, so reruns agree.  Rows without doc_id, text or label give
    none; equal rows count once; of several labels of a document each is an
    example, and of several texts of a doc_id the least is.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label is not null").distinct()
    chosen = (
        marked.filter(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_texts)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    found = cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label")  # over max_texts rows at most
    sizes = found.select("doc_id", "label", F.sum(F.octet_length("text")).over(so_far).alias("size")).filter(F.col("size") <= max_bytes)
    rows = found.join(F.broadcast(sizes), ["doc_id", "label"]).select("text", "label", F.xxhash64("doc_id").alias("h"), "doc_id").collect()
    return [(x["text"], x["label"]) for x in sorted(rows, key=lambda x: (x["h"], x["doc_id"], x["label"]))]


class Scorer:
    """Scores raw texts; keeps the weighted features of the words it has met."""

    def __init__(self, model: Model):
        self.weights, self.intercept, self.known = model.weights, model.intercept, {}

    def _of_word(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            got = self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
        return got

    def __call__(self, raw: bytes | None) -> float:
        held = {f for w in set(_WORDS(decoded(raw).lower())) for f in self._of_word(w)}
        z = self.intercept + sum(sorted(self.weights[f] for f in held))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of `docs`, from the whole text alone.

    Null and empty texts score the intercept; texts of any length are read
    whole; null doc_ids and repeated rows stay; an empty table gives none;
    other columns are not read.
    """

    def make():
        scorer = Scorer(model)

        def run(batch):
            s = [scorer(x) for x in batch.column("raw").to_pylist()]
            return batch_of(doc_id=batch.column("doc_id"), score=pa.array(s, pa.float64()), predicted=pa.array([int(x >= threshold) for x in s], pa.int32()))

        return run

    return map_rows(text_rows(docs), make, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores under `threshold`."""

    def make():
        scorer = Scorer(model)

        def run(batch):
            text = batch.column("text").cast(pa.binary()).to_pylist()
            return batch.filter(pa.array([scorer(x) < threshold for x in text], pa.bool_()))

        return run

    return map_rows(docs, make, docs.schema)


def held_out(doc_id: int, fold: int = 2, folds: int = 4) -> bool:
    """Whether a document's label is kept from the fit."""
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_texts: int = MAX_TEXTS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; a null doc_id is not held out."""
    model = fit(sample_of(docs, labels, max_texts))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scores(docs, model, threshold).select("doc_id", out.alias("held_out"), "score", "predicted")
