"""Toxicity by weak supervision.

1. Voters.  From a bounded sample of labelled rows, entries that toxic texts hold
   far more often than others become voters: a word of the lexicon; a beginning of
   words, met at least once, twice or three times with different endings, or in
   one of fifty different words.  Pattern voters (several hits, shouting) stand
   beside them.  A voter fires on a text or not.
2. Label model.  A latent class model over the voters' firings, fitted by
   expectation-maximisation: each voter has a rate of firing in either class (its
   accuracy).  Voters that go together within a class beyond their rates are
   correlated; each voter's evidence is divided by one plus the sum of its
   correlations, re-estimated at each step, so that ten copies of one voter count
   about once.  EM starts from the rates in the labelled sample.
3. Classifier.  A logistic regression over the presence of the lexicon entries is
   trained on the posterior labels, and gives the score of every text.

Only texts enter the score.  The sample bounds the entries that can pass; they go to
the executors with the function.

Defined results: a null or empty text gets the score of a text without any entry;
without labelled rows of both classes every score is the smoothed share of toxic
labels; repeated rows stay; of repeated labels of one id the largest counts; an
empty table gives an empty result; columns named as the operator's own are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices
from .langid import sample

FIT_ROWS = 3000
BITS = 22
WORDS = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6, 7, 8)
#: A beginning counts as dense if it begins one of this many different words.
DENSE = 50


def entries_of(words: set[str], wanted: set[str] | None = None, close: set[str] | None = None) -> set[str]:
    """The entries that a text with these words holds; ``wanted`` limits them, and only words ``close`` can hit these."""
    out, stems = set(), {}
    for w in words if close is None else close:
        if wanted is None or w in wanted:
            out.add(w)
        for k in STEMS:
            if len(w) <= k:
                break
            stem = w[:k]
            if wanted is None or stem in wanted:
                stems[stem] = stems.get(stem, 0) + 1
    for stem, n in stems.items():
        out.add(f"{stem}*1")
        if n >= 2:
            out.add(f"{stem}*2")
            if n >= 3:
                out.add(f"{stem}*3")
            if n * DENSE >= len(words):
                out.add(f"{stem}*%")
    return out


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


@dataclass
class Model:
    entries: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    shrink: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, hits: list[list[int]]) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights[i] for i in own) for own in hits], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def mine(texts: list[str], labels: np.ndarray) -> list[str]:
    """Entries by how surely they tell toxic texts, strongest first; of entries on the same toxic texts one.

    Buckets of a hash first bound how many toxic texts hold an entry, so that only
    entries that may pass are counted by name.
    """
    toxic_words = clean_words = 0
    bound = np.zeros(1 << BITS, dtype=np.int32)
    for text, y in zip(texts, labels, strict=True):
        words = words_of(text)
        if y:
            toxic_words += len(words)
            marks = np.fromiter((zlib.crc32(e.encode("utf-8", "surrogatepass")) for e in entries_of(words)), dtype=np.int64)
            np.add.at(bound, np.unique(marks & ((1 << BITS) - 1)), 1)
        else:
            clean_words += len(words)
    # The share of all words that toxic texts hold is what an entry that tells nothing would have.
    base = min(max(toxic_words / max(1, toxic_words + clean_words), 1e-6), 1 - 1e-6)
    least = math.log(max(1, int((bound > 0).sum()))) + 5
    enough = max(3, math.ceil(least / -math.log(base)))
    toxic, clean, where = Counter(), Counter(), {}
    for i, (text, y) in enumerate(zip(texts, labels, strict=True)):
        if y:
            mark = zlib.crc32(b"%d" % i) << 32 | zlib.crc32(b"text %d" % i)
            for e in entries_of(words_of(text)):
                if bound[zlib.crc32(e.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)] >= enough:
                    toxic[e] += 1
                    where[e] = where.get(e, 0) ^ mark
    toxic = {e: n for e, n in toxic.items() if n >= enough}
    known = {e.split("*")[0] for e in toxic}
    for text, y in zip(texts, labels, strict=True):
        if not y:
            clean.update(e for e in entries_of(words_of(text), known) if e in toxic)
    ranked = []
    for entry, hits in toxic.items():
        misses = clean[entry]
        share = (hits + 0.5) / (hits + misses + 1)
        sure = hits * math.log(share / base) + misses * math.log((1 - share) / (1 - base))
        if share >= 0.9 and share > base and sure >= least:  # holds against as many tries as there are entries
            ranked.append((-sure, "*" not in entry, -len(entry), entry))
    ranked.sort()
    out, seen = [], set()
    for *_, entry in ranked:
        if where[entry] not in seen:
            seen.add(where[entry])
            out.append(entry)
    return out


def votes(texts: list[str], entries: list[str]) -> np.ndarray:
    """Firings: a column for each entry, then the pattern voters."""
    index = {e: i for i, e in enumerate(entries)}
    known = {e.split("*")[0] for e in entries}
    out = np.zeros((len(texts), len(entries) + 4), dtype=np.float64)
    k = len(entries)
    for i, text in enumerate(texts):
        hits = [index[e] for e in entries_of(words_of(text), known) if e in index]
        out[i, hits] = 1
        out[i, k] = len(hits) >= 2
        out[i, k + 1] = len(hits) >= 4
        out[i, k + 2] = "!!" in text
        out[i, k + 3] = sum(map(str.isupper, text)) > 0.5 * max(1, sum(map(str.isalpha, text)))
    return out


def label_model(fired: np.ndarray, labels: np.ndarray, known: np.ndarray, steps: int = 12):
    """Posterior labels, firing rates and divisors; ``known`` marks the rows whose labels start it."""
    n, k = fired.shape
    post = np.where(known, labels, 0.5).astype(np.float64)
    start = known.astype(np.float64)
    rates, divisor, prior = np.zeros((k, 2)), np.ones(k), 0.1
    for step in range(steps):
        weight = start if step == 0 else np.ones(n)
        for c in (0, 1):
            own = weight * (post if c else 1 - post)
            rates[:, c] = (own @ fired + 0.05) / (own.sum() + 0.5)
        prior = float(np.clip((weight * post).sum() / max(1.0, weight.sum()), 1e-3, 1 - 1e-3))
        expected = (1 - post)[:, None] * rates[:, 0] + post[:, None] * rates[:, 1]
        rest = fired - expected
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / n / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        divisor = 1 + np.where(correlation > 0.1, correlation, 0).sum(axis=1)
        ratio = np.log(rates[:, 1] / rates[:, 0]) / divisor
        against = np.log((1 - rates[:, 1]) / (1 - rates[:, 0])) / divisor
        z = math.log(prior / (1 - prior)) + fired @ ratio + (1 - fired) @ against
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if step == 0:
            post = np.where(known, 0.5 * post + 0.5 * labels, post)
    return post, rates, divisor


def fit_local(texts: list[str], labels: list[int], steps: int = 400) -> Model:
    once = {x: i for i, x in enumerate(texts)}  # copies of a text would count as evidence again and again
    texts, labels = list(once), [labels[i] for i in once.values()]
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not y.sum() or y.sum() == len(y):
        return Model(bias=math.log(share / (1 - share)))
    entries = mine(texts, y)
    fired = votes(texts, entries)
    post, rates, divisor = label_model(fired, y, np.ones(len(y), bool))
    x = fired[:, : len(entries)]
    # Logistic regression on the posteriors, by gradient descent with momentum.
    target = np.clip(post, 0.01, 0.99)
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.full(len(y), 1 / len(y))
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        g = weight * (p - target)
        vw = 0.9 * vw - 3.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 3.0 * g.sum()
        w, b = np.maximum(w + vw, 0), b + vb  # an entry never speaks for a clean text
    return Model(entries, w, float(b), rates, divisor)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS
) -> Model:
    """Fits on about ``fit_rows`` labelled documents of each class, chosen by a hash of the id."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    chosen = sample(known, "_y", fit_rows, id_col)  # about 2 * fit_rows rows of two numbers
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).orderBy(id_col, text_col).collect()
    return fit_local([r[text_col] or "" for r in rows], [int(r["_y"]) for r in rows])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic."""
    rest = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    schema = T.StructType([*rest, T.StructField(out, T.DoubleType(), False)])
    names = [f.name for f in rest]
    at = names.index(text_col)
    index = {e: i for i, e in enumerate(model.entries)}
    known = {e.split("*")[0] for e in model.entries}
    #: A word that can hit an entry shares its first characters.
    heads = {e[:3] for e in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, at):
                hits = []
                for text in batch.column(at).to_pylist():
                    words = words_of(text) if text else set()
                    close = {w for w in words if w[:3] in heads}
                    hits.append(sorted(index[e] for e in entries_of(words, known, close) if e in index))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(hits), pa.float64())], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)
