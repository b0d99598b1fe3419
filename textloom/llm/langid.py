"""Language of the words of a text, and of the text, by a linear-chain CRF.

Words are maximal runs of letters.  A word's features are its lower-case form, its
prefixes and suffixes of up to four bytes, its n-grams of two to five bytes, whether it is in the lexicon (a word that the training sample has
often, with the language it is most often in), and its letter case; they are hashed
into one table of weights per language.  Transition weights between the languages
of adjacent words are learned with them, by gradient ascent on the likelihood of
the label sequences.  Forward-backward gives every word its posterior over the
languages; the language of a text is the one with the largest expected number of
words, and its score is that number over the number of words.

The model is fitted on a bounded sample: about ``fit_docs`` labelled documents for
each language, chosen by a hash of the id.  The weights have a fixed size and go to
the executors with the function.  Prediction reads every word of every text.

Defined results: ``und`` with score 0 for a null text or one without a letter; with
no labelled document at all every text is ``und``; equal sums go to the language
that sorts first; repeated rows stay; an empty table gives an empty result; extra
columns pass through, and columns named as the operator's own are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, mix64, text_slices

BITS = 18
FIT_DOCS = 600
#: Words of a training sequence; one in MIXED of the sequences is made of stretches of different languages.
WINDOW = 24
MIXED = 3
#: Words of a long text whose messages are computed together.
BLOCK = 256
#: Bytes of text that a worker labels at once.
SLICE_BYTES = 1 << 20
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    found = WORDS.findall(text)
    if found and not any(c.isalpha() for w in found for c in w):
        return []  # numerals that aren't digits
    return found


def feature_rows(types: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the features of distinct words, and the word that each belongs to.

    Words are marked at both ends, so their n-grams of two to five bytes hold their
    prefixes and suffixes.
    """
    mask = np.uint64((1 << BITS) - 1)
    low = [w.lower() for w in types]
    raw = [w.encode("utf-8", "surrogatepass") for w in low]
    text = np.frombuffer(b"".join([b"\x02%b\x03" % w for w in raw]), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(types)), [len(w) + 2 for w in raw])
    rows, owners = [], []
    code = text
    for k in range(2, 6):
        code = code[:-1] | text[k - 1 :] << np.uint64(8 * (k - 1))
        inside = owner[: len(code)] == owner[k - 1 :]
        rows.append(mix64(code[inside] << np.uint64(3) | np.uint64(k)) & mask)
        owners.append(owner[: len(code)][inside])
    every = np.arange(len(types))
    whole = np.fromiter(map(zlib.crc32, raw), dtype=np.uint64, count=len(types))
    case = np.fromiter(((w[0] != x[0]) + 2 * (len(w) > 1 and w.isupper()) for w, x in zip(types, low, strict=True)), dtype=np.uint64, count=len(types))
    known = np.fromiter((lexicon.get(x, -1) + 1 for x in low), dtype=np.uint64, count=len(types))
    for kind, value in ((1, whole), (6, case), (7, known)):
        rows.append(mix64(value << np.uint64(3) | np.uint64(kind)) & mask)
        owners.append(every)
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def _sums(values: np.ndarray, owners: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(owners, values[:, k], minlength=size) for k in range(values.shape[1])], axis=1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (1 << BITS, languages)
    transitions: np.ndarray  # (languages, languages)
    start: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, types: list[str]) -> np.ndarray:
        out = np.empty((len(types), len(self.languages)), dtype=np.float32)
        for at in range(0, len(types), 20_000):
            part = types[at : at + 20_000]
            rows, owners = feature_rows(part, self.lexicon)
            out[at : at + len(part)] = _sums(self.weights[rows], owners, len(part))
        return out


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Posteriors of every word, for sequences that lie one after another in ``emit``.

    All sequences advance together, the longest first, so a step is one array
    operation over those that haven't ended.  ``enter`` has what stands before the first
    word of each sequence in place of ``start``, ``leave`` the backward message at its
    last.  Also returns forward and backward messages, both scaled to sum to 1.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    begins = (np.cumsum(lengths) - lengths)[order]
    local = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    forward, backward = np.empty_like(local), np.empty_like(local)
    step = np.exp(transitions)
    enter = np.exp(start) if enter is None else enter[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
    for t in range(longest):
        at = begins[: alive[t]] + t
        got = local[at] * (enter if t == 0 else forward[at - 1] @ step)
        forward[at] = got / got.sum(axis=1, keepdims=True)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = begins[:n] + t
        on = alive[t + 1] if t + 1 < longest else 0
        got = np.ones((n, local.shape[1])) if leave is None else leave[order[:n]].copy()
        if on:
            after = at[:on] + 1
            got[:on] = (local[after] * backward[after]) @ step.T
        backward[at] = got / got.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward, local


def posteriors(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The posteriors of :func:`marginals`, with long sequences cut into blocks that advance together.

    A block maps the message that enters it to the one that leaves it; these maps are
    products of its steps, found for all blocks at once and then applied in order.
    """
    if not len(lengths) or int(lengths.max()) <= block:
        return marginals(emit, lengths, transitions, start)[0]
    parts = -(-lengths // block)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.minimum(block, lengths[owner] - nth * block)
    begins = np.cumsum(sizes) - sizes
    step, k = np.exp(transitions), emit.shape[1]
    long = np.flatnonzero(parts[owner] > 1)
    maps = np.zeros((len(long), k, k))
    for t in range(block):
        on = np.flatnonzero(sizes[long] > t)
        raw = emit[begins[long[on]] + t].astype(np.float64)
        local = np.exp(raw - raw.max(axis=1, keepdims=True))[:, None, :]
        got = np.eye(k)[None] * local if t == 0 else (maps[on] @ step) * local
        maps[on] = got / got.sum(axis=(1, 2), keepdims=True)
    slot = np.full(len(owner), -1)
    slot[long] = np.arange(len(long))
    enter, leave = np.tile(np.exp(start), (len(owner), 1)), np.ones((len(owner), k))
    for n in range(1, int(parts.max())):
        own = np.flatnonzero(nth == n)
        out = np.einsum("bi,bij->bj", enter[own - 1], maps[slot[own - 1]]) @ step
        enter[own] = out / out.sum(axis=1, keepdims=True)
    for n in range(int(parts.max()) - 1, 0, -1):
        own = np.flatnonzero(nth == n)
        out = np.einsum("bij,bj->bi", maps[slot[own]], leave[own]) @ step.T
        leave[own - 1] = out / out.sum(axis=1, keepdims=True)
    return marginals(emit, sizes, transitions, start, enter, leave)[0]


def _sequences(rows: list[list[str]], labels: list[int], window: int, rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Training sequences of words with a label each: windows of the texts, and mixes of stretches of 1 to 8 words.

    Every word is in one window; the words of mixes are drawn from windows of any language.
    """
    pure = [(words[at : at + window], y) for words, y in zip(rows, labels, strict=True) for at in range(0, len(words), window)]
    out = [(words, [y] * len(words)) for words, y in pure]
    for _ in range(len(pure) // MIXED if len(set(labels)) > 1 else 0):
        words: list[str] = []
        gold: list[int] = []
        while len(words) < window:
            own, y = pure[int(rng.integers(len(pure)))]
            at, size = int(rng.integers(len(own))), int(rng.integers(1, 9))
            words += own[at : at + size]
            gold += [y] * len(own[at : at + size])
        out.append((words, gold))
    return out


def fit_local(rows: list[tuple[str, str]], epochs: int = 3, window: int = WINDOW, seed: int = 7) -> Model:
    """Fits on (text, language) pairs; long texts are cut into windows of words, all of which are used.

    Windows hold one language; mixes of stretches from several show the model what a
    switch looks like.
    """
    languages = sorted({lang for _, lang in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    n = len(languages)
    counts: dict[str, Counter] = {}
    texts, labels = [words_of(text) for text, _ in rows], [index[lang] for _, lang in rows]
    rng = np.random.default_rng(seed)
    sequences = _sequences(texts, labels, window, rng)
    for words, (_, lang) in zip(texts, rows, strict=True):
        for w in words:
            counts.setdefault(w.lower(), Counter())[index[lang]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if sum(c.values()) >= 20}
    model = Model(languages, np.zeros((1 << BITS, n), np.float32), np.zeros((n, n)), np.zeros(n), lexicon)
    if n < 2 or not sequences:
        return model
    squares, t_squares = np.full((1 << BITS, n), 1e-2, np.float32), np.full((n, n), 1e-2)
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 512)):
            own = [sequences[i] for i in chunk]
            types: dict[str, int] = {}
            ids = np.array([types.setdefault(w, len(types)) for words, _ in own for w in words])
            lengths = np.array([len(words) for words, _ in own])
            gold = np.array([y for _, ys in own for y in ys])
            flat, owners = feature_rows(list(types), lexicon)
            emit = _sums(model.weights[flat], owners, len(types))[ids]
            post, forward, backward, local = marginals(emit, lengths, model.transitions, model.start)
            wrong = -post
            wrong[np.arange(len(ids)), gold] += 1
            by_type = _sums(wrong, ids, len(types))
            used, place = np.unique(flat, return_inverse=True)
            gradient = _sums(by_type[owners], place, len(used)) / len(own)
            gradient -= 1e-5 * model.weights[used]
            squares[used] += gradient**2
            model.weights[used] += (0.1 * gradient / np.sqrt(squares[used])).astype(np.float32)
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(lengths)[:-1]] = False
            inner[0] = False
            at = np.flatnonzero(inner)
            joint = forward[at - 1][:, :, None] * np.exp(model.transitions)[None] * (local[at] * backward[at])[:, None, :]
            expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[at - 1], gold[at]), 1)
            t_gradient = (seen - expected) / len(own) - 1e-2 * model.transitions
            t_squares += t_gradient**2
            model.transitions += 0.1 * t_gradient / np.sqrt(t_squares)
    return model


def sample(docs: DataFrame, label: str, rows_each: int, id_col: str = "doc_id") -> DataFrame:
    """About ``rows_each`` rows of each label, by a hash of the id."""
    sizes = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for value, count in sorted(sizes.items()):
        wanted = wanted | ((F.col(label) == F.lit(value)) & (draw < F.lit(min(1.0, rows_each / count))))
    return docs.filter(wanted)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    """Fits on about ``fit_docs`` rows of each language, with texts and languages that aren't null."""
    known = docs.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(id_col, text_col, label_col)
    rows = sample(known, label_col, fit_docs, id_col).orderBy(id_col, text_col).select(text_col, label_col).collect()
    return fit_local([(r[0], r[1]) for r in rows])


def label_texts(texts: list[str], model: Model):
    """Words, their posteriors and the number of words of each text."""
    types: dict[str, int] = {}
    found = [words_of(x) for x in texts]
    ids = np.array([types.setdefault(w, len(types)) for own in found for w in own], dtype=np.int64)
    lengths = np.array([len(own) for own in found], dtype=np.int64)
    n = len(model.languages)
    if not n or not len(ids):
        return found, np.zeros((len(ids), n)), lengths
    filled = lengths[lengths > 0]
    post = posteriors(model.emissions(list(types))[ids], filled, model.transitions, model.start)
    return found, post, lengths


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", words_col: str | None = None, out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the language and score of each text and, if asked for, the (word, language) pairs."""
    own = {x.lower() for x in (*out, words_col or out[0])}
    rest = [f for f in docs.schema.fields if f.name.lower() not in own]
    schema = T.StructType([*rest, T.StructField(out[0], T.StringType(), False), T.StructField(out[1], T.DoubleType(), False)])
    if words_col:
        pair = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType())])
        schema = schema.add(words_col, T.ArrayType(pair), False)
    names = [f.name for f in rest]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, at, SLICE_BYTES):
                found, post, lengths = label_texts(["" if x is None else x for x in batch.column(at).to_pylist()], model)
                ends = np.cumsum(lengths)
                labels, scores, pairs = [], [], []
                for own, end, size in zip(found, ends.tolist(), lengths.tolist(), strict=True):
                    if size and model.languages:
                        mine = post[end - size : end]
                        total = mine.sum(axis=0)
                        best = int(total.argmax())
                        labels.append(model.languages[best])
                        scores.append(min(1.0, float(total[best]) / size))
                        if words_col:
                            pairs.append([{"word": w, "lang": model.languages[k]} for w, k in zip(own, mine.argmax(axis=1).tolist(), strict=True)])
                    else:
                        labels.append(UNKNOWN)
                        scores.append(0.0)
                        pairs.append([])
                columns = [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
                if words_col:
                    columns.append(pa.array(pairs, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *out, *([words_col] if words_col else [])])

    return docs.select(*names).mapInArrow(giving_back(run), schema)
