"""Encodes batches of texts by the distinct segments that they consist of.

A tokenizer's pattern that lets a piece begin with one space, and hold no other space
behind its first character, cuts before every space that stands between two
characters that aren't white space.  So a text is cut there first: Arrow splits a
batch at spaces and numbers the distinct words; words with white space at an edge are
joined again with their neighbours.  Each distinct segment is encoded once for a
batch, and segments that a batch holds more than once are remembered, within bounds.
The ids of the texts are then gathered by one array operation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An empty word, or one with white space (or what may count as such) at an edge.
_EDGE = r"^$|^[\s\x0B\x1C-\x1F\x{85}\p{Z}]|[\s\x0B\x1C-\x1F\x{85}\p{Z}]$"
#: Letters of a few scripts; a word of these alone is one piece together with the space before it.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}\x{4E00}-\x{9FA5}]+$"
#: Longer segments aren't remembered.
MEMO_CHARS = 64


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return flat[spans(starts, lengths)]


def cut_at_spaces(texts: pa.Array) -> tuple[list[str], pa.Array, list[str], np.ndarray, np.ndarray]:
    """Segments of texts that aren't null.

    Returns the segments that begin a text, the distinct words and the distinct joined
    words (both without the space before them), the number of every segment in these two
    lists (-1 for one that begins a text), and how many segments each text has.
    """
    split = pc.split_pattern(texts, " ")
    offsets = np.asarray(split.offsets, dtype=np.int64)
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices)
    edge = np.asarray(pc.match_substring_regex(words, _EDGE))[codes]
    begins = np.zeros(len(codes), dtype=bool)
    begins[offsets[:-1]] = True
    if not edge.any():
        firsts = words.take(pa.array(codes[offsets[:-1]])).to_pylist()
        numbers = codes.astype(np.int64)
        numbers[offsets[:-1]] = -1
        return firsts, words, [], numbers, np.diff(offsets)
    starts = ~edge
    starts[1:] &= ~edge[:-1]
    starts |= begins
    at = np.flatnonzero(starts)
    size = np.diff(at, append=len(codes))
    numbers = codes[at].astype(np.int64)
    # Only the words of joined segments and those that begin a text are needed as strings here.
    lead = np.flatnonzero(begins[at])
    several = np.flatnonzero((size > 1) & ~begins[at])
    chosen = np.concatenate([several, lead])
    parts = iter(words.take(pa.array(codes[spans(at[chosen], size[chosen])])).to_pylist())
    texts_of = [" ".join([next(parts) for _ in range(n)]) for n in size[chosen].tolist()]
    joined: dict[str, int] = {}
    numbers[several] = [len(words) + joined.setdefault(x, len(joined)) for x in texts_of[: len(several)]]
    firsts = texts_of[len(several) :]
    numbers[lead] = -1
    return firsts, words, list(joined), numbers, np.diff(lead, append=len(at))


class SegmentEncoder:
    """Ids of texts, from ``encode_pieces``: distinct pieces to their ids, one after another, and how many each has.

    ``cut`` is the compiled pattern of the pieces; ``most`` bounds the segments that
    are remembered, and ``most_chars`` their characters.
    """

    def __init__(self, cut, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, most_chars: int = 16 << 20):
        self.cut, self.encode_pieces = cut, encode_pieces
        self.most, self.most_chars = most, most_chars
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fresh(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, those in ``plain`` being pieces themselves; and how many each has."""
        index = {piece: i for i, piece in enumerate(plain)}
        number, findall = index.setdefault, self.cut.findall
        rows = [[number(p, len(index)) for p in findall(x)] for x in others]
        flat, counts = self.encode_pieces(list(index))
        starts = np.cumsum(counts) - counts
        own = np.fromiter((i for row in rows for i in row), dtype=np.int64, count=sum(map(len, rows)))
        order = np.concatenate([np.arange(len(plain), dtype=np.int64), own])
        held = counts[order]
        ends = np.concatenate([np.arange(len(plain) + 1), len(plain) + np.cumsum([len(row) for row in rows], dtype=np.int64)])
        bounds = np.concatenate([[0], np.cumsum(held)])[ends]
        return gather(flat, starts[order], held), np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; null reads as the empty text."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        firsts, words, joined, numbers, held = cut_at_spaces(pc.fill_null(texts, ""))
        behind = pc.binary_join_element_wise(pa.scalar(" "), words, "").to_pylist() + [" " + x for x in joined]
        # A text may begin with what stands behind a space elsewhere; then the segment is listed twice.
        begin = {x: len(behind) + i for i, x in enumerate(dict.fromkeys(firsts))}
        segments = behind + list(begin)
        numbers[numbers < 0] = [begin[x] for x in firsts]
        times = np.bincount(numbers, minlength=len(segments))

        slots = np.fromiter(map(self.known.get, segments, [-1] * len(segments)), dtype=np.int64, count=len(segments))
        missing = np.flatnonzero((slots < 0) & (times > 0))
        of_words = missing[missing < len(words)]
        alone = np.asarray(pc.match_substring_regex(words.take(pa.array(of_words)), PLAIN), dtype=bool) if len(of_words) else np.zeros(0, bool)
        plain, rest = of_words[alone], np.concatenate([of_words[~alone], missing[len(of_words) :]])
        order = np.concatenate([plain, rest])
        flat, lengths = self._fresh([segments[i] for i in plain.tolist()], [segments[i] for i in rest.tolist()])
        starts = np.cumsum(lengths) - lengths

        size, start = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        old = np.flatnonzero(slots >= 0)
        size[old], start[old] = self.lengths[slots[old]], self.starts[slots[old]]
        size[order], start[order] = lengths, starts + len(self.flat)
        ids = gather(np.concatenate([self.flat, flat]), start[numbers], size[numbers])
        total = np.concatenate([[0], np.cumsum(size[numbers])])
        bounds = np.concatenate([[0], np.cumsum(held)])
        self._remember([segments[i] for i in order.tolist()], times[order], flat, starts, lengths)
        return ids, np.diff(total[bounds])

    def _remember(self, segments: list[str], times: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Keeps the segments that the batch held more than once; forgets all when there are too many."""
        keep = [i for i in np.flatnonzero(times > 1).tolist() if len(segments[i]) <= MEMO_CHARS]
        if not keep:
            return
        if len(self.starts) + len(keep) > self.most or self.chars > self.most_chars:
            self._forget()
        keep = keep[: self.most]
        for n, i in enumerate(keep, len(self.starts)):
            self.known[segments[i]] = n
            self.chars += len(segments[i])
        held = lengths[keep]
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(held) - held])
        self.lengths = np.concatenate([self.lengths, held])
        self.flat = np.concatenate([self.flat, gather(flat, starts[keep], held)])
