"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The softmax over the vocabulary is factored by nested classes.  Words that end in the
same two characters are a class (the ``CLASSES`` most frequent endings, and one class
for all others); classes that stand in like surroundings are clustered, two by two, up
to the class of all words; inside its class a word has a Huffman code by its count.  So
a word is a leaf of a binary tree, and its probability is the product of the softmaxes
of two subclasses along its path.  Each of these is a logistic model: the logarithm of
the ratio of the subclasses' counts, plus a weight for each feature of the tokens
before.  Features: the word before, the endings of the two words before together
(n-grams), and the endings two and three words back (skips); feature and node are
hashed to one weight.  Weights reach from the classes down to single frequent words
(the ``nodes_of`` heaviest nodes); below, subclasses have their share of the counts.
The rarer words of a class are one leaf of it, in which a word has its smoothed share,
and words that training hasn't seen share one smoothed event; so probabilities sum to 1.
A text is the sequence of its words and an end token.

* Counts of words, endings and pairs of neighbouring endings cover all training texts:
  each task counts its own, Spark sums them up.
* The weights are trained by distributed gradient updates over all training texts, each
  of which belongs to one of the rounds: in a round every partition makes gradient steps
  from the common weights, each scaled by the curvature that its weight has met so far,
  and the results are averaged, weight by weight, by that curvature.  A weight that few
  partitions know isn't watered down by the others.
* What is learned grows with the training tokens: counts with all words; weights as
  their square root; leaves of single words, and nodes, as their cube root.  Tasks that
  train or score hold the latter three.
* For scoring, each task sums up what it can tell of a document; the words that are no
  leaf go by a shuffle to the table of counts, with the document's key, and their shares
  are summed up by a second one.  No task needs the vocabulary, and a word frequent
  enough to be a hot key is a leaf.

Defined results: a null or empty text is the end token alone; without training texts
every token is unknown and the base is that of an empty table (N = 0, V = 0);
repeated rows get a score each; an empty table gives an empty result; columns other
than the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, release, text_slices
from .segments import spans

CLASSES = 255
#: Weights, leaves and weighted nodes at TOKENS training tokens or fewer, as powers of two.
TABLE_BITS, LEAF_BITS, NODE_BITS = 19, 16, 8
TOKENS = 1 << 22
ROUNDS = 2
#: Training text of a partition, of a step's texts, and tokens of a step; weights that are averaged together.
PART_BYTES = 256 << 20
FIT_BYTES = 2 << 20
STEP = 4096
#: Tokens that are scored together, and of these at a node.
SCORED, NODE_TOKENS = 1 << 19, 1 << 14
CHUNK = 1 << 16
#: Share of a step's full correction that each template makes, and the curvature that every weight starts with.
RATE, PRIOR = 0.4, 2.0
SMOOTH = 0.1
#: The end token; no word is empty.
END = ""
TEMPLATES = 4
_NODE = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD6E8FEB86659FD93)


def _grown(base: int, tokens: int, root: int) -> int:
    """``base`` as a power of two at TOKENS, and one more for each ``root`` doublings of the tokens."""
    return base + max(0, (tokens // TOKENS).bit_length() - 1) // root


def table_bits(tokens: int) -> int:
    return _grown(TABLE_BITS, tokens, 2)


def leaves_of(tokens: int) -> int:
    return 1 << _grown(LEAF_BITS, tokens, 3)


def nodes_of(tokens: int) -> int:
    return 1 << _grown(NODE_BITS, tokens, 3)


def _split(texts: pa.Array) -> pa.ListArray:
    """The words of each text; white space at an edge leaves an empty one."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, the token numbers of all texts one after another, and the lengths."""
    split = _split(texts)
    coded = split.flatten().dictionary_encode()
    types = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = np.asarray(coded.indices, dtype=np.int64)
    end = types.index(END) if END in types else len(types)
    if end == len(types):
        types.append(END)
    return types, *_ended(codes, codes != end, split, end)


def _ended(codes: np.ndarray, word: np.ndarray, split: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` of the parts of ``split`` that are a ``word``, with ``end`` behind each text; and the lengths."""
    offsets = np.asarray(split.offsets, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(word)])[offsets - offsets[0]]
    counts = np.diff(before)
    ids = np.full(int(counts.sum()) + len(counts), end, dtype=np.int64)
    ids[spans(before[:-1] + np.arange(len(counts)), counts)] = codes[word]
    return ids, counts + 1


def endings_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Like :func:`tokens_of`, of the tokens' endings."""
    split = _split(texts)
    coded = pc.utf8_slice_codeunits(split.flatten(), -2, None).dictionary_encode()
    types, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
    end = types.index(END) if END in types else len(types)
    if end == len(types):
        types.append(END)
    return types, *_ended(codes, codes != end, split, end)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: Longer words are left to zlib one by one.
CRC_BYTES = 32


def _crcs(types: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """zlib's crc32 of each word's bytes, and of its last three bytes from the value 7."""
    column = pa.array(types, pa.large_string())
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(types) + 1]
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
    first, size = ends[:-1], np.diff(ends)

    def run(first: np.ndarray, size: np.ndarray, value: int) -> np.ndarray:
        state = np.full(len(size), value ^ 0xFFFFFFFF, np.uint32)
        on = np.arange(len(size))
        for j in range(int(size.max(initial=0))):
            on = on[size[on] > j]
            own = state[on]
            state[on] = _CRC[(own ^ raw[first[on] + j]) & np.uint32(255)] ^ (own >> np.uint32(8))
        return ~state

    short = size <= CRC_BYTES
    word = run(first, np.where(short, size, 0), 0)
    for k in np.flatnonzero(~short).tolist():
        word[k] = zlib.crc32(raw[ends[k] : ends[k + 1]])
    tail = np.minimum(size, 3)
    return word, run(ends[1:] - tail, tail, 7)


def _places(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _back(ids: np.ndarray, place: np.ndarray, k: int, none: int) -> np.ndarray:
    """What stands ``k`` tokens before each, ``none`` before the text."""
    out = np.full(len(ids), none, dtype=np.int64)
    out[k:] = ids[: max(0, len(ids) - k)]
    out[place < k] = none
    return out


def features(ids: np.ndarray, place: np.ndarray, types: list[str]) -> np.ndarray:
    """Codes of the features of every token, (TEMPLATES, tokens); ``place`` is its position in its text."""
    word, tail = (np.append(x, none).astype(np.uint64) for x, none in zip(_crcs(types), (1, 2), strict=True))
    one, two, three = (_back(ids, place, k, len(types)) for k in (1, 2, 3))
    return np.stack(
        [
            mix64(word * np.uint64(8) + np.uint64(1))[one],
            mix64((tail[one] * np.uint64(0x9E3779B1) + tail[two]) * np.uint64(8) + np.uint64(2)),
            mix64(tail * np.uint64(8) + np.uint64(3))[two],
            mix64(tail * np.uint64(8) + np.uint64(4))[three],
        ]
    )


def ending_of(word: str) -> str:
    return word[-2:]


@dataclass
class Lexicon:
    """The leaves, and the weighted part of the path to each."""

    words: dict[str, int] = field(default_factory=dict)
    endings: dict[str, int] = field(default_factory=dict)  # the leaf of the rarer words with an ending
    other: int = 0  # the leaf of the rarer words with any other ending
    counts: np.ndarray = field(default_factory=lambda: np.zeros(1))  # training tokens of leaves of one word
    rare: np.ndarray = field(default_factory=lambda: np.ones(1, bool))
    #: What is added to a token's log probability for its leaf, below the weighted nodes.
    constant: np.ndarray = field(default_factory=lambda: np.zeros(1))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    _ways: tuple | None = None

    def ways(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each leaf's path, and for each node the first path through it, the first that turns left there, and the end.

        Paths are numbered down the tree, right turns first, so those through a node are neighbours.
        """
        if self._ways is None:
            starts, at, path = np.unique(self.at, return_index=True, return_inverse=True)
            size = self.size[at]
            number, step = np.repeat(np.arange(len(starts)), size), spans(starts, size)
            node, right = self.nodes[step], self.right[step]
            held = np.zeros((len(self.bias), 3), np.int64)
            held[:, 0] = len(starts)
            np.minimum.at(held[:, 0], node, number)
            np.maximum.at(held[:, 2], node, number + 1)
            held[:, 1] = held[:, 0] + np.bincount(node[right], minlength=len(held))
            self._ways = path.astype(np.min_scalar_type(len(starts))), held
        return self._ways

    def leaves(self, types: list[str]) -> np.ndarray:
        endings, other = self.endings.get, self.other
        out = np.fromiter(map(self.words.get, types, repeat(-1)), dtype=np.int64, count=len(types))
        missing = np.flatnonzero(out < 0)
        out[missing] = [endings(types[k][-2:], other) for k in missing.tolist()]
        return out


def _halves(vectors: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Which of the classes go right: the best cut in two groups along the axis of their largest spread."""
    share = mass / mass.sum()
    rest = vectors - share @ vectors
    axis = rest[int(np.argmax(share))] + 1e-6
    for _ in range(60):  # power iteration
        axis = rest.T @ (share * (rest @ axis))
        axis /= np.linalg.norm(axis) + 1e-300
    along = rest @ axis
    order = np.argsort(along, kind="stable")
    weight = np.cumsum(share[order])[:-1]
    moment = np.cumsum((share * along)[order])[:-1]
    between = moment**2 / np.maximum(weight * (1 - weight), 1e-12)
    cut_at = int(np.argmax(between)) + 1
    right = np.ones(len(mass), bool)
    right[order[:cut_at]] = False
    return right


def build(classes: list[str | None], contexts: np.ndarray, rare: list[tuple[float, int]], words: list[tuple[str, int, int]], weighted: int) -> Lexicon:
    """The tree.

    ``classes`` are the endings (None for all others) and ``contexts`` counts of the
    classes around each; ``rare`` has (mass, number of words) of the rarer words of each
    class and ``words`` (word, class, count) of those that are leaves.
    """
    out = Lexicon()
    leaf_mass: list[float] = []
    inner: list[tuple[int, int, float, float]] = []  # children and masses of nodes; a leaf k is -1 - k
    members: list[list[tuple[float, int]]] = [[] for _ in classes]
    counts, is_rare, scale = [], [], []
    for k, (mass, n) in enumerate(rare):
        leaf = len(leaf_mass)
        if classes[k] is None:
            out.other = leaf
        else:
            out.endings[classes[k]] = leaf
        leaf_mass.append(mass + SMOOTH * (n + 1))
        counts.append(0)
        is_rare.append(True)
        scale.append(-math.log(leaf_mass[-1]))
        members[k].append((leaf_mass[-1], leaf))
    for word, k, c in words:
        out.words[word] = len(leaf_mass)
        members[k].append((c + SMOOTH, len(leaf_mass)))
        leaf_mass.append(c + SMOOTH)
        counts.append(c)
        is_rare.append(False)
        scale.append(0.0)

    def join(a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        inner.append((a[1], b[1], a[0], b[0]))
        return a[0] + b[0], len(inner) - 1

    tops = []
    for own in members:
        heap = [(m, -1 - leaf) for m, leaf in own]
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, join(heapq.heappop(heap), heapq.heappop(heap)))
        tops.append(heap[0])
    near = np.sqrt((contexts + 1e-9) / (contexts + 1e-9).sum(axis=1, keepdims=True))

    def cluster(group: np.ndarray) -> tuple[float, int]:
        if len(group) == 1:
            return tops[int(group[0])]
        right = _halves(near[group], np.array([tops[int(k)][0] for k in group]))
        return join(cluster(group[~right]), cluster(group[right]))

    root = cluster(np.arange(len(classes)))[1]
    heavy = sorted(range(len(inner)), key=lambda i: (-inner[i][2] - inner[i][3], i))[:weighted]
    number = {i: n for n, i in enumerate(heavy)}
    out.bias = np.array([math.log(inner[i][3] / inner[i][2]) for i in heavy], dtype=np.float32)
    out.counts, out.rare = np.array(counts, dtype=np.float64), np.array(is_rare)
    out.at, out.size = np.zeros(len(leaf_mass), np.int64), np.zeros(len(leaf_mass), np.int64)
    out.constant = np.array(scale)
    nodes: list[int] = []
    right: list[bool] = []
    # Down the tree; the weighted part of a path is shared by all leaves below its end.
    stack: list[tuple[int, tuple[int, ...], tuple[bool, ...], float]] = [(root, (), (), math.log(sum(leaf_mass)))]
    placed: dict[tuple, int] = {}
    while stack:
        at, path, turns, top = stack.pop()
        if at < 0:
            leaf = -1 - at
            if (path, turns) not in placed:
                placed[path, turns] = len(nodes)
                nodes += path
                right += turns
            out.at[leaf], out.size[leaf] = placed[path, turns], len(path)
            # Below the last weighted node a leaf has its share of the mass there.
            out.constant[leaf] += math.log(leaf_mass[leaf]) - top
            continue
        a, b, mass_a, mass_b = inner[at]
        n = number.get(at)
        if n is None:
            stack += [(a, path, turns, top), (b, path, turns, top)]
        else:
            stack += [(a, (*path, n), (*turns, False), math.log(mass_a)), (b, (*path, n), (*turns, True), math.log(mass_b))]
    out.nodes, out.right = np.array(nodes, dtype=np.int32), np.array(right, dtype=bool)
    return out


class Weights:
    """The hashed weights and the curvature that each has met."""

    def __init__(self, bits: int, weights: np.ndarray | None = None, met: np.ndarray | None = None):
        self.bits = bits
        self.weights = np.zeros(1 << bits, np.float32) if weights is None else weights
        self.met = np.zeros(1 << bits, np.float32) if met is None else met
        self._both: np.ndarray | None = None

    def _side_by_side(self) -> np.ndarray:
        """A weight and its curvature next to each other, as a step needs both; ``weights`` and ``met`` are views of it from here on."""
        if self._both is None:
            self._both = np.empty(2 << self.bits, np.float32)
            self._both[0::2], self._both[1::2] = self.weights, self.met
            self.weights, self.met = self._both[0::2], self._both[1::2]
        return self._both

    def log_probs(self, lexicon: Lexicon, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's leaf (of the token itself, if no others are in the leaf)."""
        out = lexicon.constant[leaf]
        weights = np.ascontiguousarray(self.weights)
        for at in range(0, len(leaf) if len(lexicon.nodes) else 0, SCORED):
            own = slice(at, at + SCORED)
            out[own] -= self._logs(weights, lexicon, codes[:, own], leaf[own])
        return out

    def _logs(self, weights: np.ndarray, lexicon: Lexicon, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The sum of log(1 + e^z) along each token's path, node by node: tokens in order of their paths are neighbours at each node."""
        paths, held = lexicon.ways()
        path = paths[leaf]
        order = np.argsort(path, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(path, minlength=int(held.max(initial=0))))])
        mixed = codes.take(order, axis=1)
        mixed *= _SLOT
        key = np.arange(len(held), dtype=np.uint64) * _NODE * _SLOT
        shift = np.uint64(64 - self.bits)

        def each_node() -> Iterator[tuple[slice, np.ndarray]]:
            for n, (first, left, last) in enumerate(ends[held].tolist()):
                for at in range(first, last, NODE_TOKENS):
                    own = slice(at, min(at + NODE_TOKENS, last))
                    slots = mixed[:, own] + key[n]
                    slots >>= shift
                    z = np.full(slots.shape[1], lexicon.bias[n])
                    for s in slots.view(np.int64):
                        z += weights.take(s, mode="clip")
                    if at < left:
                        np.negative(z[: left - at], out=z[: left - at])
                    yield own, z

        # log(1 + e^z) summed along a path is the logarithm of a product, unless that is too large a number.
        total = np.ones(len(leaf))
        with np.errstate(over="ignore"):
            for own, z in each_node():
                np.exp(z, out=z)
                z += 1
                total[own] *= z
        if np.isfinite(total).all():
            np.log(total, out=total)
        else:
            total[:] = 0
            for own, z in each_node():
                total[own] += np.logaddexp(0, z.astype(np.float64))
        out = np.empty(len(leaf))
        out[order] = total
        return out

    def learn(self, lexicon: Lexicon, codes: np.ndarray, leaf: np.ndarray, rng: np.random.Generator) -> None:
        """Gradient steps over all tokens, in random order of steps."""
        weights = self._side_by_side()
        met = weights[1:]
        # Places of weights are even: a slot is twice the highest bits of the hash.
        shift, even = np.uint64(63 - self.bits), ~np.uint64(1)
        key = lexicon.nodes.astype(np.uint64) * _NODE * _SLOT
        bias = lexicon.bias[lexicon.nodes]
        for at in rng.permutation(np.arange(0, len(leaf), STEP)).tolist():
            own = slice(at, at + STEP)
            size = lexicon.size[leaf[own]]
            step = spans(lexicon.at[leaf[own]], size)
            if not len(step):
                continue
            hashed = key.take(step, mode="clip")
            z = bias.take(step, mode="clip")
            slots = []
            for code in codes[:, own] * _SLOT:
                s = np.repeat(code, size)
                s += hashed
                s >>= shift
                s &= even
                slots.append(s.view(np.int64))
                z += weights.take(slots[-1], mode="clip")
            p = 1 / (1 + np.exp(-z))
            curved = p * (1 - p)
            wrong = (lexicon.right.take(step, mode="clip") - p) * np.float32(RATE)
            for s in slots:
                np.add.at(met, s, curved)
                by = met.take(s, mode="clip")
                by += np.float32(PRIOR)
                np.add.at(weights, s, np.divide(wrong, by, out=by))


def count_words(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all texts; each task hands on one row for each word of a part of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 0, 32 << 20):
                counts = pc.value_counts(_split(batch.column(0)).flatten())
                words, c = counts.field("values"), counts.field("counts")
                word = pc.not_equal(words, END)  # each text has one end, and any number of empty parts
                words, c = words.filter(word).cast(pa.string()), c.filter(word)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.string())]), pa.concat_arrays([c, pa.array([batch.num_rows], pa.int64())])], names=["word", "c"])

    return texts.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_neighbours(texts: DataFrame, text_col: str, classes: list[str | None]) -> np.ndarray:
    """How often a token of each class stands one or two before or after a token of each class, over all texts."""
    index = {e: k for k, e in enumerate(classes) if e is not None}
    size, other = len(classes), len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for whole in batches:
            for batch in text_slices(whole, 0, 4 << 20):
                types, ids, lengths = endings_of(batch.column(0))
                kind = np.array([index.get(e, other) for e in types])[ids]
                place = _places(lengths)
                for k in (1, 2):
                    on = np.flatnonzero(place >= k)
                    total += np.bincount(kind[on] * size + kind[on - k], minlength=size * size)
        rows = total.reshape(size, size)
        rows = rows + rows.T
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([rows[k].astype("<i8").tobytes() for k in used.tolist()], pa.binary())], names=["k", "near"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in parts["near"])
        return pa.table({"k": parts["k"].slice(0, 1), "near": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((size, size))
    parts = texts.select(text_col).mapInArrow(run, "k int, near binary")
    for row in parts.groupBy("k").applyInArrow(add, "k int, near binary").toLocalIterator():
        out[row["k"]] = np.frombuffer(row["near"], "<i8")
    return out


def fit(train: DataFrame, lexicon, text_col: str, tokens: int, rounds: int = ROUNDS) -> Weights:
    """Rounds of local gradient steps over the partitions of ``train``, which has ``tokens`` tokens, averaged weight by weight.

    Each round takes another share of the texts, by their hash.  ``lexicon`` is a
    broadcast variable.
    """
    spark = train.sparkSession
    bits = table_bits(tokens)
    model = Weights(bits)
    held = int(train.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    parts = max(spark.sparkContext.defaultParallelism, -(-held // PART_BYTES))
    spread = train.select(text_col).coalesce(parts)
    schema = "at int, weights binary, met binary"
    for number in range(rounds if tokens else 0):
        sent = spark.sparkContext.broadcast((model.weights.astype(np.float16), np.sqrt(model.met).astype(np.float16)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number: int = number) -> Iterator[pa.RecordBatch]:
            first, root = sent.value
            own, rng = None, np.random.default_rng(number)
            words = lexicon.value
            for whole in batches:
                for batch in text_slices(whole, 0, FIT_BYTES):
                    own = own or Weights(bits, first.astype(np.float32), np.square(root.astype(np.float32)))
                    types, ids, lengths = tokens_of(batch.column(0))
                    own.learn(words, features(ids, _places(lengths), types), words.leaves(types)[ids], rng)
            for at in range(0, 1 << bits if own else 0, CHUNK):
                yield _chunk(at, own.weights[at : at + CHUNK], own.met[at : at + CHUNK])

        share = spread.filter(F.pmod(F.xxhash64(text_col), F.lit(rounds)) == number)
        averaged = share.mapInArrow(run, schema).groupBy("at").applyInArrow(_average, schema)
        weights, met = model.weights.copy(), model.met.copy()
        for row in averaged.toLocalIterator():
            w = np.frombuffer(row["weights"], "<f2").astype(np.float32)
            weights[row["at"] : row["at"] + len(w)] = w
            met[row["at"] : row["at"] + len(w)] = np.square(np.frombuffer(row["met"], "<f2").astype(np.float32))
        model = Weights(bits, weights, met)
        sent.destroy()
        release(spark)
    return model


def _chunk(at: int, weights: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """A stretch of weights for a row of the shuffle; the curvature is kept by its root."""
    columns = [weights.astype("<f2").tobytes(), np.sqrt(met).astype("<f2").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], names=["at", "weights", "met"])


def _average(parts: pa.Table) -> pa.Table:
    """Means of the weights of a stretch by the curvature that each partition met; and the mean curvature."""
    total, summed = 0.0, 0.0
    for w, m in zip(parts["weights"], parts["met"], strict=True):
        met = np.square(np.frombuffer(m.as_buffer(), "<f2").astype(np.float64))
        total = total + met
        summed = summed + met * np.frombuffer(w.as_buffer(), "<f2").astype(np.float64)
    mean = summed / np.maximum(total, 1e-12)
    return pa.Table.from_batches([_chunk(parts["at"][0].as_py(), mean.astype(np.float32), (total / parts.num_rows).astype(np.float32))])


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words above the lowest count that no more than ``most`` words pass (to a hundredth of its logarithm), by count and word.

    The threshold comes from a histogram of a few thousand bars, so no task sends words that don't pass.
    """
    bar = F.floor(F.log("c") * 100).cast("int")
    held = 0
    least = None
    for k, n in sorted(counts.groupBy(bar.alias("k")).count().collect(), reverse=True):
        held += n
        if held > most:
            break
        least = k
    if least is None:
        return []
    found = [(r["word"], int(r["c"])) for r in counts.filter(bar >= least).select("word", "c").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def learn_tree(counts: DataFrame, train: DataFrame, text_col: str, total: int, distinct: int, ends: int) -> Lexicon:
    """Classes, leaves and paths, from the counts of all words: ``total`` tokens, ``distinct`` ones, and ``ends`` end tokens."""
    words = frequent(counts.filter(F.col("word") != END), leaves_of(total))
    ending = F.expr("substring(word, -2, 2)")
    by_ending = counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    top = by_ending.orderBy(F.col("n").desc(), "e").limit(CLASSES).collect()
    classes: list[str | None] = [r["e"] for r in top] + [None]
    mass = [int(r["n"]) for r in top] + [total - sum(int(r["n"]) for r in top)]
    size = [int(r["v"]) for r in top] + [distinct - sum(int(r["v"]) for r in top)]
    index = {e: k for k, e in enumerate(classes) if e is not None}
    leaves = [*([(END, ends)] if ends else []), *words]
    placed = []
    for word, c in leaves:
        k = index.get(ending_of(word), len(index))
        mass[k] -= c
        size[k] -= 1
        placed.append((word, k, c))
    near = count_neighbours(train, text_col, classes)
    return build(classes, near, list(zip(mass, size, strict=True)), placed, nodes_of(total))


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (both log10) of every document."""
    spark = docs.sparkSession
    counts = cut(count_words(train, text_col))
    seen = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    total, distinct, ends = (int(x or 0) for x in seen)
    lexicon = spark.sparkContext.broadcast(learn_tree(counts, train, text_col, total, distinct, ends))
    model = fit(train, lexicon, text_col, total)
    sent = spark.sparkContext.broadcast((model.bits, model.weights))
    norm = math.log10(total + SMOOTH * (distinct + 1))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "mark", "word", "n", "tokens", "known", "base", "score"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its word begins with a space) and for each of its words that is no leaf."""
        words, (bits, weights) = lexicon.value, sent.value
        model = Weights(bits, weights, weights)
        log_counts = np.log10(words.counts + SMOOTH)
        for whole in batches:
            for batch in text_slices(whole, 2, 2 << 20):
                types, ids, lengths = tokens_of(batch.column(2))
                leaf = words.leaves(types)
                own = leaf[ids]
                rare = words.rare[own]
                first = np.cumsum(lengths) - lengths
                found = model.log_probs(words, features(ids, _places(lengths), types), own) / math.log(10)
                base = np.where(rare, 0.0, log_counts[own]) - norm
                doc = np.repeat(np.arange(len(lengths)), lengths)
                key = np.sort(doc[rare] * len(types) + ids[rare])
                at = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.diff(at, append=len(key))
                key = key[at]
                n, m = len(lengths), len(key)
                order = np.concatenate([np.arange(n), key // len(types)])
                word = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), pc.cast(batch.column(1), pa.string()), ""), pa.array(types, pa.string()).take(pa.array(key % len(types)))])
                zero = np.zeros(m)
                values = [
                    pa.array(np.concatenate([np.ones(n, np.int64), times])),
                    pa.array(np.concatenate([lengths, zero.astype(np.int64)])),
                    pa.array(np.concatenate([np.add.reduceat((~rare).astype(np.int64), first), zero.astype(np.int64)])),
                    pa.array(np.concatenate([np.add.reduceat(base, first), zero])),
                    pa.array(np.concatenate([np.add.reduceat(found, first), zero])),
                ]
                for part in range(0, n + m, 50_000):
                    pick = pa.array(order[part : part + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pick), batch.column(1).take(pick), word.slice(part, 50_000), *(x.slice(part, 50_000) for x in values)], names=names
                    )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(told, f"id {kind}, mark long, word string, n long, tokens long, known long, base double, score double")
    is_doc = F.col("tokens") > 0
    met = rows.join(counts, "word", "left")
    rare = F.when(is_doc, F.lit(0.0)).otherwise(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)))
    summed = met.groupBy("id", "mark").agg(
        F.sum(is_doc.cast("long")).alias("copies"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when(~is_doc & F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("known"),
        F.sum(F.col("base") + rare).alias("base"),
        F.sum(F.col("score") + rare).alias("score"),
    )
    # Rows that repeat id and text were summed up together; each gets its share, which is the same.
    each = lambda name: F.col(name) / F.col("copies")
    return summed.select(
        F.col("id").alias(id_col),
        each("tokens").cast("long").alias("n_tokens"),
        each("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        each("base").alias("base_score"),
        each("score").alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
