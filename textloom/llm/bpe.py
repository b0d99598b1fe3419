"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a piece of bytes, entry ``e`` of its table is the last token of the encoding
of its first ``e`` bytes.  That token is the only one that ends there and forms a
valid pair with the last token of what precedes it (two tokens form a valid pair
if their joined bytes encode to just these two), so a table grows by one entry
per byte, exactly:

* appending bytes only appends entries (:meth:`PrefixTable.append`);
* after an edit, entries are recomputed from there until as many of them as the
  longest token has bytes equal the old ones; all later ones are then as before
  (:meth:`PrefixTable.replace`).

Reading the table backwards gives the ids.  A text is first cut into pieces by
the pattern of the vocabulary and each piece is encoded alone; a piece that is
itself a token is that token.  :class:`Tables` fills the tables of all distinct
pieces of a batch at once, one prefix length after another, in arrays; pieces too
long for it get a :class:`PrefixTable`.  Each worker remembers segments of texts and
decisions on pairs within bounds.

Defined results: a null or empty text has no ids and decodes to no bytes; ids
outside the vocabulary raise ``ValueError`` when decoded; texts are encoded whole
whatever their length; repeated rows stay; an empty table gives an empty result;
columns that clash with the operator's own are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, mix64, text_slices
from .segments import SegmentEncoder, gather

#: Bytes of text that a worker encodes at once, and pieces whose tables it fills at once.
SLICE_BYTES = 1 << 20
PIECES = 12_000
#: Segments that a worker remembers.
CACHE_SEGMENTS = 150_000
#: Longest piece, in bytes, whose table is filled in arrays; tokens of more than WIDE bytes also get a table of their own.
LONGEST = 48
WIDE = 16
#: Decisions on pairs that a worker remembers, as a power of two.
PAIR_BITS = 18


class Vocabulary:
    """Token bytes by rank, and the pair rule of the prefix tables."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1 if ranks else 0)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            tails.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of the tokens that end in these two bytes (or are this one byte), longest first.
        self.tails = {tail: tuple(sorted(found, reverse=True)) for tail, found in tails.items()}
        self._pairs: dict[int, bool] = {}
        self._odd: set[int] = set()
        self._prepare()

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: the adjacent pair of lowest rank (under ``below``) merges first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best) and (below is None or rank < below):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _prepare(self) -> None:
        """The last merge of each token, and the tokens that their own bytes don't encode to."""
        self._split: list[tuple[int, int]] = [(-1, -1)] * len(self.tokens)
        ranks = self.ranks
        for token, rank in ranks.items():
            parts = self.merged(token, below=rank)
            if len(parts) == 2:
                self._split[rank] = (parts[0], parts[1])
            elif len(parts) > 2:
                self._odd.add(rank)

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        return token not in self._odd

    def pair(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens encode to these two.

        Undoing merges from the latest to the earliest walks the states in which
        a part of ``left`` met a part of ``right``.  The pair fails if the two
        would have merged before the merge undone last; of merges of one rank
        the leftmost comes first, so a tie counts against the right side only.
        """
        ranks, tokens, split = self.ranks, self.tokens, self._split
        a, b, limit = left, right, 1 << 62
        while True:
            token = ranks.get(tokens[a] + tokens[b])
            if token is not None and token < limit:
                return False
            parts_a, parts_b = split[a], split[b]
            if parts_a[0] >= 0 and (a > b or parts_b[0] < 0):
                limit, a = a, parts_a[1]
            elif parts_b[0] >= 0:
                limit, b = b + 1, parts_b[0]
            else:
                return True

    def entry(self, piece: bytes, last: list[int], end: int) -> int:
        """The last token of the encoding of ``piece[:end]``; ``last`` holds the entries before."""
        ranks, pairs = self.ranks, self._pairs
        for size in self.tails.get(piece[end - 2 : end], ()) if end > 1 else ():
            start = end - size
            if start < 0:
                continue
            token = ranks.get(piece[start:end])
            if token is None:
                continue
            if start == 0:
                if token not in self._odd:
                    return token
                continue
            left = last[start - 1]
            valid = pairs.get(left << 32 | token)
            if valid is None:
                if len(pairs) > 400_000:
                    pairs.clear()
                valid = pairs[left << 32 | token] = self.pair(left, token)
            if valid:
                return token
        token = ranks.get(piece[end - 1 : end])
        if token is None:
            raise ValueError(f"the vocabulary has no token for byte {piece[end - 1 : end]!r}")
        return token

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else PrefixTable(self, piece).ids()

    def decode(self, ids) -> bytes:
        tokens, out = self.tokens, []
        for i in ids:
            token = tokens[i] if 0 <= i < len(tokens) else None
            if token is None:
                raise ValueError(f"no token has id {i}")
            out.append(token)
        return b"".join(out)


class PrefixTable:
    """The table of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        entry, last, piece = self.vocabulary.entry, self.last, self.piece
        for end in range(len(last) + 1, len(piece) + 1):
            last.append(entry(piece, last, end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in the place of bytes ``start`` to ``stop``; returns how many entries were computed."""
        old_last, size = self.last, self.vocabulary.longest
        piece = self.piece = self.piece[:start] + new + self.piece[stop:]
        shift, last, same, done = start + len(new) - stop, old_last[:start], 0, 0
        for end in range(start + 1, len(piece) + 1):
            last.append(self.vocabulary.entry(piece, last, end))
            done += 1
            # Only entries whose bytes the edit left alone can count as equal.
            same = same + 1 if end > start + len(new) and last[-1] == old_last[end - shift - 1] else 0
            if same > size:
                last += old_last[end - shift :]
                break
        self.last = last
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Lookup:
    """Numbers of 64-bit keys that are all different: open addressing in arrays, -1 for a key that isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slots(keys)
        while len(left):
            free = self.values[slot[left]] < 0
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out = self.values[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.values[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[slot[left]] != keys[left])]
        return out


def _packed(token: bytes) -> int:
    return int.from_bytes(token, "big")


class Tables:
    """Fills the prefix tables of many pieces at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ranks, tokens = vocabulary.ranks, vocabulary.tokens
        by_size: dict[int, list[bytes]] = {}
        for token in ranks:
            by_size.setdefault(len(token), []).append(token)
        #: Tokens of each size up to WIDE by their last eight bytes, and the bytes before these as a second key.
        self.by_size = {}
        for size in sorted(k for k in by_size if 2 <= k <= WIDE):
            own = by_size[size]
            near = np.array([_packed(t[-8:]) for t in own], dtype=np.uint64)
            far = np.array([_packed(t[:-8]) for t in own], dtype=np.uint64)
            self.by_size[size] = Lookup(near ^ mix64(far) if size > 8 else near, np.array([ranks[t] for t in own], np.int32))
        self.single = np.full(256, -1, np.int32)
        for token in by_size.get(1, ()):
            self.single[token[0]] = ranks[token]
        #: Sizes of the tokens that end in three bytes, as bits, by a hash; two bytes for tokens of these alone.
        self.sizes = np.zeros(1 << 20, np.uint32)
        self.wide = np.zeros(1 << 20, bool)
        for size, own in by_size.items():
            if size >= 3:
                at = self._end(np.array([_packed(t[-3:]) for t in own], dtype=np.uint64))
                if size <= WIDE:
                    np.bitwise_or.at(self.sizes, at, np.uint32(1 << size))
                else:
                    self.wide[at] = True
        count = len(tokens)
        self.near = np.array([_packed(t[-8:]) if t else 0 for t in tokens], dtype=np.uint64)
        self.far = np.array([_packed(t[-16:-8]) if t else 0 for t in tokens], dtype=np.uint64)
        self.length = np.array([len(t) if t else 0 for t in tokens], dtype=np.int64)
        self.odd = np.zeros(count, bool)
        self.odd[list(vocabulary._odd)] = True
        split = np.array(vocabulary._split, dtype=np.int64).reshape(-1, 2)
        self.left, self.right = split[:, 0], split[:, 1]
        both, made = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None:
                    b = ranks.get(token[k:])
                    if b is not None:
                        both.append(a << 32 | b)
                        made.append(rank)
        self.merges = Lookup(np.array(both, dtype=np.uint64), np.array(made, dtype=np.int32))
        self.pair_keys = np.zeros(1 << PAIR_BITS, np.uint64)
        self.pair_valid = np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def _end(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`Vocabulary.pair` of many pairs, each distinct new one decided once."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (mix64(keys) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_valid[slot]
        # No pair has the key 0 unless token 0 follows itself; that one is decided each time.
        new = np.flatnonzero((self.pair_keys[slot] != keys) | (keys == 0))
        if len(new):
            distinct, place = np.unique(keys[new], return_inverse=True)
            decided = self._decide((distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[new] = decided[place]
            at = (mix64(distinct) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            self.pair_keys[at], self.pair_valid[at] = distinct, decided
        return out

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        valid = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 62, np.int64)
        alive = np.arange(len(a))
        while len(alive):
            joined = self.merges.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            fails = (joined >= 0) & (joined < limit)
            valid[alive[fails]] = False
            splits_a, splits_b = self.left[a] >= 0, self.left[b] >= 0
            take_a = splits_a & ((a > b) | ~splits_b)
            limit = np.where(take_a, a, b + 1)
            on = ~fails & (splits_a | splits_b)
            a, b = np.where(take_a, self.right[a], a), np.where(take_a, b, self.left[b])
            alive, limit, a, b = alive[on], limit[on], a[on], b[on]
        return valid

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        short = np.flatnonzero((size > 0) & (size <= LONGEST))
        slow = np.flatnonzero(size > LONGEST).tolist()
        for at in range(0, len(short), PIECES):
            own = short[at : at + PIECES]
            ids, held, missed = self._encode_short([pieces[i] for i in own.tolist()], size[own])
            slow += own[missed].tolist()
            counts[own] = held
            parts.append((own, ids))
        for i in slow:
            ids = np.array(self.vocabulary.encode_piece(pieces[i]), dtype=np.int32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        if not parts:
            return np.zeros(0, np.int32), counts
        order = np.concatenate([x for x, _ in parts])
        flat = np.concatenate([x for _, x in parts])
        # Pieces that were left to the slow way stand in ``order`` twice, the first time with no ids.
        held = counts[order]
        first = np.zeros(len(order), bool)
        first[len(short) :] = True
        left = np.zeros(len(pieces), bool)
        left[slow] = True
        held = np.where(first | ~left[order], held, 0)
        starts = np.zeros(len(pieces), np.int64)
        final = held > 0
        starts[order[final]] = (np.cumsum(held) - held)[final]
        return gather(flat, starts, counts), counts

    def _encode_short(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each piece has, and the numbers of pieces that need a table of their own (these have none)."""
        vocabulary, text = self.vocabulary, np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(text)
        ends = np.cumsum(size)
        begin = np.repeat(ends - size, size)  # where each byte's piece starts
        nth = np.arange(n) - begin + 1  # length of the prefix that ends with it
        wide = text.astype(np.uint64)
        # The eight bytes up to each position, with zeros before the piece.
        near = wide.copy()
        for k in range(1, 8):
            near[k:] |= np.where(nth[k:] > k, wide[:-k] << np.uint64(8 * k), np.uint64(0))
        far = np.zeros(n, np.uint64)
        far[8:] = np.where(nth[8:] > 8, near[:-8], np.uint64(0))
        hashed = self._end(near & np.uint64(0xFFFFFF))
        sizes = np.where(nth >= 3, self.sizes[hashed], np.uint32(0))
        missed = np.zeros(len(pieces), bool)
        maybe = np.flatnonzero(self.wide[hashed] & (nth > WIDE))
        if len(maybe):
            missed[np.searchsorted(ends, maybe, side="right")] = True

        # All tokens that end at a position, as (position, size, token), longest first.
        found_at, found_size, found = [], [], []
        for k in sorted(self.by_size, reverse=True):
            at = np.flatnonzero((sizes >> np.uint32(k)) & np.uint32(1) & (nth >= k)) if k > 2 else np.flatnonzero(nth >= 2)
            if not len(at):
                continue
            key = near[at] & np.uint64((1 << 64) - 1 >> max(0, 64 - 8 * k))
            if k > 8:
                key = key ^ mix64(far[at] & np.uint64((1 << 8 * (k - 8)) - 1))
            token = self.by_size[k].find(key)
            hit = np.flatnonzero(token >= 0)
            at, token = at[hit], token[hit].astype(np.int64)
            if k > 8:  # two keys in one: compare the bytes
                same = (self.near[token] == near[at]) & (self.far[token] == far[at] & np.uint64((1 << 8 * (k - 8)) - 1)) if k < 16 else (self.near[token] == near[at]) & (self.far[token] == far[at])
                at, token = at[same], token[same]
            found_at.append(at)
            found_size.append(np.full(len(at), k, np.int64))
            found.append(token)
        every = np.arange(n)
        found_at.append(every)
        found_size.append(np.ones(n, np.int64))
        found.append(self.single[text].astype(np.int64))
        at, k, token = np.concatenate(found_at), np.concatenate(found_size), np.concatenate(found)
        order = np.argsort(at, kind="stable")  # sizes are already falling
        at, k, token = at[order], k[order], token[order]
        first = np.searchsorted(at, every)
        count = np.diff(first, append=len(at))

        last = np.full(n, -1, np.int64)
        # A whole piece that is a token is that token.
        for_end = first[ends - 1]
        whole = k[for_end] == size
        by_nth = np.argsort(nth, kind="stable")
        bounds = np.searchsorted(nth[by_nth], np.arange(1, int(size.max()) + 2))
        for e in range(1, int(size.max()) + 1):
            now = by_nth[bounds[e - 1] : bounds[e]]
            tried = 0
            while len(now):
                here = first[now] + tried
                k_now, token_now = k[here], token[here]
                start = now - k_now + 1
                valid = (k_now == e) & ~self.odd[token_now]
                inner = np.flatnonzero(k_now < e)
                valid[inner] = self.pairs(last[start[inner] - 1], token_now[inner])
                last_one = count[now] == tried + 1
                valid |= last_one  # the byte itself
                last[now[valid]] = token_now[valid]
                now = now[~valid]
                tried += 1
        if (last < 0).any():
            bad = int(text[np.flatnonzero(last < 0)[0]])
            raise ValueError(f"the vocabulary has no token for byte {bytes([bad])!r}")
        # Backwards from the end of every piece at once.
        steps, where = [], ends - 1
        alive = np.flatnonzero(~missed)
        whole = whole[alive]
        spot = where[alive]
        while len(alive):
            got = np.where(whole, token[for_end[alive]], last[spot])
            steps.append((alive, got))
            spot = spot - self.length[got]
            on = spot >= (ends - size)[alive]
            alive, spot, whole = alive[on], spot[on], np.zeros(int(on.sum()), bool)
        held = np.zeros(len(pieces), np.int64)
        for own, _ in steps:
            held[own] += 1
        out = np.zeros(int(held.sum()), np.int32)
        place = np.cumsum(held) - 1
        for own, got in steps:
            out[place[own]] = got
            place[own] -= 1
        return out, held, np.flatnonzero(missed)


class Encoder:
    """The encoder of a worker: prefix tables behind a bounded memory of segments."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.from_file(path)
        self.tables = Tables(self.vocabulary)
        self.segments = SegmentEncoder(regex.compile(pattern), self._pieces, CACHE_SEGMENTS)
        tokens = [t or b"" for t in self.vocabulary.tokens]
        self.tokens = pa.array(tokens, pa.binary())
        self.unused = np.array([t is None for t in self.vocabulary.tokens], dtype=bool)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.tables.encode([p.encode("utf-8", "surrogatepass") for p in pieces])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        return self.segments.encode(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of lists of ids that stand one after another."""
        bad = (ids < 0) | (ids >= len(self.unused))
        if not bad.any() and self.unused.any():
            bad = self.unused[ids]
        if bad.any():
            raise ValueError(f"no token has id {int(ids[np.flatnonzero(bad)[0]])}")
        taken = self.tokens.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        byte_at = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        bounds = byte_at[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.tobytes()), data])


@lru_cache(maxsize=2)
def _tools(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    return _tools(path, pattern).encode(pa.array([text], pa.string()))[0]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)), type=pa.list_(pa.field("element", pa.int32(), False)))


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each text, and with ``decoded_col`` the bytes that these ids decode to."""
    own = {ids_col.lower(), (decoded_col or ids_col).lower()}
    rest = [f for f in docs.schema.fields if f.name.lower() not in own]
    schema = T.StructType([*rest, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    if decoded_col:
        schema = schema.add(decoded_col, T.BinaryType(), False)
    names = [f.name for f in rest]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(path, pattern)
        for whole in batches:
            for batch in text_slices(whole, at, SLICE_BYTES):
                ids, counts = encoder.encode(batch.column(at))
                columns = [*batch.columns, _lists(ids, counts)]
                if decoded_col:
                    columns.append(encoder.decode(ids, counts))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids_col, *([decoded_col] if decoded_col else [])])

    return docs.select(*names).mapInArrow(giving_back(run), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded", pattern: str = ".") -> DataFrame:
    """``rows`` with the bytes that each list of ids decodes to (null: none)."""
    rest = [f for f in rows.schema.fields if f.name.lower() != decoded_col.lower()]
    schema = T.StructType([*rest, T.StructField(decoded_col, T.BinaryType(), False)])
    names = [f.name for f in rest]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(path, pattern)
        for batch in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0), dtype=np.int64)
            ids = np.asarray(pc.list_flatten(batch.column(at)).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, encoder.decode(ids, counts)], names=[*names, decoded_col])

    return rows.select(*names).mapInArrow(run, schema)


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
