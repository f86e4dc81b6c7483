"""Phrases of two and three words that occur together, by weighted acyclic automata.

Texts, A-Z in lower case, are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
at spaces and tabs into words; everything is per ``lang`` (null: ``und``).  f(phrase)
counts contiguous occurrences within pieces, n all words.  A candidate has
a = f(phrase) >= ``least``; each cut into two parts with l and r occurrences scores
floor(10 ** 6 a a / (l r)), and the lowest cut counts, of equal ones the first.  A
candidate within a longer one that has at least ``percent`` of its occurrences goes.

1. Each task turns some tens of MB of texts at a time, a shard, into count
   transducers: for every word the path lang, word and the next two words of the
   piece, with the number of its occurrences.  Paths come sorted and are added from first to last; a
   state is closed when the paths leave it, and shares the arcs of an equal state
   closed before it.  An arc's weight is the sum of all paths through it, so the
   arc that ends a phrase bears f(phrase), and the one of a lang bears n.
2. Transducers are cut at bounds of paths, and each range's parts are united and
   their weights summed, many at a time.  Bounds are whole paths, so the range of
   a word that is a third of all words is cut within it; they come from a bounded
   sample of texts and decide on balance alone.  What a bound cuts through is
   added up afterwards.  A shard is cut at the bounds of groups of ranges only, and
   a group once its parts are united: parts are as many as shards times groups,
   and both are large, so that parts do not become many and tiny.
3. The parts that candidates are cut into, distinct, go to the ranges that may hold
   them as an acceptor, which is composed with the range's transducer: the
   product's arcs bear the counts that were asked for.

A null text has no words.  Repeated rows count each; doc_id is not read.  An empty
table has no phrase.  Long texts are taken in pieces of a bounded number of words.
Other columns are not looked at.
"""

import ctypes
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trophos.llm.words import LOWER, byte_view
from trophos.plans.scratch import Scratch

#: Bytes of text whose words a task looks for at a time, about; words at most.
TEXT_BYTES, TEXT_WORDS = 3 << 20, 1 << 20
#: Words that a task counts at a time, about: a shard.
SHARD_WORDS = 2_000_000
#: Paths that a task unites at a time, about.
MERGED = 1 << 20
#: Bytes of text that a range stands for, about.
RANGE_BYTES = 6 << 20
#: Ranges of a group at most, and groups before that.
GROUPED, GROUPS = 4, 64
#: Bytes of parts that a task hands over at a time, about.
HANDED = 4 << 20
#: Sampled texts, and paths of each, that the bounds come from.
SAMPLE_TEXTS, SAMPLE_PATHS = 4096, 32
#: Words of a path: a phrase is up to three words of a lang.
DEPTH = 4
_ZSTD = pa.Codec("zstd", compression_level=1)

SPACE, BREAK = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[32, 9]] = True
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
OUTSIDE = SPACE | BREAK


# --- transducers ----------------------------------------------------------------


class Transducer:
    """An acyclic automaton over sorted labels whose arcs bear weights.

    ``labels``: sorted distinct byte strings.  Level i holds the arcs that i labels lead to, by state: state s has the
    arcs first[i][s] to first[i][s + 1]; label[i], weight[i] and target[i], the state of the next level or -1, are by
    arc.  Level 0 has one state.
    """

    def __init__(self, labels: pa.Array, first: list, label: list, weight: list, target: list, size: int):
        self.labels, self.first, self.label, self.weight, self.target = labels, first, label, weight, target
        self.size = size  # paths

    @classmethod
    def of_paths(cls, labels: pa.Array, paths: np.ndarray, weights: np.ndarray) -> "Transducer":
        """Of distinct sorted paths, rows of DEPTH label numbers with -1 after the end."""
        n = len(paths)
        opens = np.zeros(n, bool)
        opens[:1] = True
        first, label, weight, target = [], [], [], []
        above = np.zeros(1, np.int64)
        for i in range(DEPTH):  # where a path differs from the one before it within its first i + 1 labels
            own = paths[:, i]
            opens[1:] |= own[1:] != own[:-1]
            ends = np.flatnonzero(opens)
            here = own[ends] >= 0
            at = ends[here]
            before = np.concatenate([[0], np.cumsum(opens & (own >= 0))])  # arcs that begin before a path
            first.append(before[np.append(above, n)] if i else np.array([0, len(at)]))
            label.append(own[at])
            weight.append((np.add.reduceat(weights, ends) if n else weights)[here])
            target.append(np.arange(len(at), dtype=np.int32))
            above = at
        out = cls(labels, first, label, weight, target, n)
        out._share_states()
        return out

    def _share_states(self) -> None:
        """From the last level up, equal states become one: those with the same labels, weights and targets."""
        for i in range(DEPTH - 1, 0, -1):
            first, count = self.first[i], np.diff(self.first[i])
            if i == DEPTH - 1:
                self.target[i] = np.full(len(self.label[i]), -1, np.int32)
            # states of one arc are told apart by it; those of more seldom are equal and stay
            one = np.flatnonzero(count == 1)
            arcs = first[one]
            same_as = one[_first_equal(self.label[i][arcs], self.weight[i][arcs], self.target[i][arcs] + 1)]
            stands_for = np.arange(len(count))
            stands_for[one] = same_as
            stands_for[count == 0] = -1
            kept = np.flatnonzero(stands_for == np.arange(len(count)))
            number = np.full(len(count) + 1, -1, np.int32)
            number[kept] = np.arange(len(kept))
            self.target[i - 1] = np.where(stands_for >= 0, number[stands_for], -1)
            take, begins = _spans(first[kept], count[kept])
            self.first[i] = begins
            self.label[i], self.weight[i], self.target[i] = (c[i][take] for c in (self.label, self.weight, self.target))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted paths and their weights without those that go on."""
        state, weights, columns = np.zeros(1, np.int64), np.zeros(1, np.int64), []  # state -1: the path has ended
        for i in range(DEPTH):
            on = state >= 0
            count = np.ones(len(state), np.int64)
            count[on] = (self.first[i][1:] - self.first[i][:-1])[state[on]]
            begins = np.cumsum(count) - count
            owner = np.repeat(np.arange(len(state)), count)
            on = on[owner]
            arc = (np.arange(len(owner)) + np.repeat(self.first[i][state] - begins, count))[on]
            label, target = np.full(len(owner), -1, np.int32), np.full(len(owner), -1, np.int64)
            weights = weights[owner]
            label[on], target[on], weights[on] = self.label[i][arc], self.target[i][arc], self.weight[i][arc]
            columns = [*(c[owner] for c in columns), label]
            goes_on = np.flatnonzero(target >= 0)
            if len(goes_on):  # what ends here comes before what goes on
                sums = np.concatenate([[0], np.cumsum(self.weight[i + 1])])[self.first[i + 1]]
                rest = weights[goes_on] - np.diff(sums)[target[goes_on]]
                both = goes_on[rest > 0]
                copies = np.ones(len(target), np.int64)
                copies[both] = 2
                ends = both + np.arange(len(both))
                target, weights, *columns = (np.repeat(c, copies) for c in (target, weights, *columns))
                target[ends], weights[ends] = -1, rest[rest > 0]
            state = target
        return _matrix(columns), weights

    def arcs(self, depth: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All prefixes of ``depth`` labels that weigh ``least``, sorted, and their weights."""
        state, columns = np.zeros(1, np.int64), []
        for i in range(depth):
            take, begins = _spans(self.first[i][state], self.first[i][state + 1] - self.first[i][state])
            owner = np.repeat(np.arange(len(state)), np.diff(begins))
            keep = self.weight[i][take] >= least  # what it goes on to weighs no more
            if i < depth - 1:
                keep &= self.target[i][take] >= 0
            take, owner = take[keep], owner[keep]
            columns = [*(c[owner] for c in columns), self.label[i][take]]
            weight, state = self.weight[i][take], self.target[i][take]
        return _matrix(columns), weight

    def weight_of(self, path: tuple[bytes, ...]) -> int:
        """What one prefix weighs; 0 if there is none."""
        state, weight = 0, 0
        for i, name in enumerate(path):
            number = pc.index(self.labels, pa.scalar(name, self.labels.type)).as_py() if state >= 0 else -1
            if number < 0:
                return 0
            a, b = self.first[i][state], self.first[i][state + 1]
            at = a + int(np.searchsorted(self.label[i][a:b], self.label[i].dtype.type(number)))
            if at == b or self.label[i][at] != number:
                return 0
            state, weight = int(self.target[i][at]), int(self.weight[i][at])
        return weight

    def to_bytes(self) -> bytes:
        _, offsets, data = self.labels.buffers()
        offsets = np.frombuffer(offsets, np.int32)[self.labels.offset : self.labels.offset + len(self.labels) + 1]
        text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        columns = [np.diff(offsets)]
        for i in range(DEPTH):
            columns += [np.diff(self.first[i], prepend=0), self.label[i], self.weight[i], self.target[i] + 1]
        planes = [_planes(c) for c in columns]
        body = np.concatenate([text, *(p.ravel() for p in planes)]).tobytes()
        head = [self.size, len(body), len(text), *(x for p in planes for x in p.shape)]
        return np.array(head, np.int64).tobytes() + _ZSTD.compress(body, asbytes=True)

    @classmethod
    def from_bytes(cls, data) -> "Transducer":
        data = memoryview(data)
        head = np.frombuffer(data[: 8 * HEAD], np.int64).tolist()
        body = np.frombuffer(_ZSTD.decompress(data[8 * HEAD :], decompressed_size=head[1]), np.uint8)
        columns, at = [], head[2]
        for bytes_each, n in zip(head[3::2], head[4::2]):
            columns.append(_numbers(body[at : at + bytes_each * n].reshape(bytes_each, n)))
            at += bytes_each * n
        offsets = np.concatenate([[0], np.cumsum(columns[0])]).astype(np.int32)
        labels = pa.Array.from_buffers(pa.binary(), len(columns[0]), [None, pa.py_buffer(offsets), pa.py_buffer(body[: head[2]])])
        first = [np.cumsum(c) for c in columns[1::4]]
        return cls(labels, first, [c.astype(np.int32) for c in columns[2::4]], columns[3::4], [(c - 1).astype(np.int32) for c in columns[4::4]], head[0])


#: Numbers before the body of a transducer's bytes.
HEAD = 3 + 2 * (1 + 4 * DEPTH)


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of numbers from 0, all lowest ones first, as many as the greatest needs."""
    own = np.ascontiguousarray(numbers, np.int64 if numbers.itemsize == 8 else np.int32)
    needed = -(-int(own.max(initial=0)).bit_length() // 8)
    return own.view(np.uint8).reshape(len(own), own.itemsize).T[:needed]


def _numbers(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


def _matrix(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers whose columns lie in one piece each."""
    out = np.empty((len(columns), len(columns[0])), np.int32)
    for i, column in enumerate(columns):
        out[i] = column
    return out.T


def _first_equal(*columns: np.ndarray) -> np.ndarray:
    """The number of the first of the rows that each row, of numbers from 0, equals."""
    n = len(columns[0])
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) <= 64:
        keys = np.zeros(n, np.uint64)
        for column, width in zip(columns, bits):
            keys = (keys << np.uint64(width)) | column.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = keys[1:] != keys[:-1]
    else:
        order = np.lexsort(columns)
        new = np.zeros(max(n - 1, 0), bool)
        for column in columns:
            column = column[order]
            new |= column[1:] != column[:-1]
    at = np.flatnonzero(np.concatenate([[True], new])) if n else np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    out[order] = np.repeat(order[at], np.diff(np.append(at, n)))
    return out


def _spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all spans, one after the other, and where each begins."""
    begins = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    return np.arange(begins[-1]) + np.repeat(start - begins[:-1], count), begins


def _sorted_labels(labels: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct labels in the order of their bytes, and the number of each of the given."""
    coded = labels.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _packed(paths: np.ndarray) -> tuple[np.ndarray, list] | None:
    """One number per path, in the order of the paths, and what tells the paths from them; None beyond 64 bits."""
    most = [int(paths[:, i].max(initial=-1)) + 1 for i in range(DEPTH)]
    values, ranks = [None] * DEPTH, [None] * DEPTH
    for i in range(DEPTH):
        if sum(m.bit_length() for m in most) <= 64:
            break
        present = np.zeros(most[i] + 1, bool)  # numbers that are there, told by their rank; -1 is the last place
        present[paths[:, i]] = True
        values[i] = np.flatnonzero(np.roll(present, 1)).astype(np.int32)
        ranks[i] = np.roll(np.cumsum(np.roll(present, 1), dtype=np.int32) - 1, -1)
        most[i] = len(values[i]) - 1
    bits = [m.bit_length() for m in most]
    if sum(bits) > 64:
        return None
    keys = np.zeros(len(paths), np.uint64)
    for i in range(DEPTH):
        keys <<= np.uint64(bits[i])
        column = paths[:, i]
        keys += (column + np.int32(1) if ranks[i] is None else ranks[i][column]).view(np.uint32)
    return keys, list(zip(bits, values))


def _unpacked(keys: np.ndarray, columns: list) -> np.ndarray:
    out = np.empty((DEPTH, len(keys)), np.int32)
    for i in reversed(range(DEPTH)):
        bits, values = columns[i]
        own = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        out[i] = (own if values is None else values[own]) - 1
        keys = keys >> np.uint64(bits) if bits < 64 else np.zeros_like(keys)
    return out.T


def summed_paths(paths: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted paths and the sums of their weights; None: each weighs 1."""
    if not len(paths):
        return paths, np.zeros(0, np.int64)
    order, n = None, len(paths)
    if packed := _packed(paths):
        keys, columns = packed
        if weights is None:
            paths = None  # large, and the caller need not hold them
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
        new = keys[1:] != keys[:-1]
    else:  # two labels make one number
        high, low = ((paths[:, i].astype(np.int64) + 1 << 32) + paths[:, i + 1] + 1 for i in (0, 2))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(np.concatenate([[True], new]))
    sums = np.diff(np.append(at, n)) if weights is None else np.add.reduceat(weights[order], at)
    return _unpacked(keys[at], columns) if packed else paths[order[at]], sums


def _united_paths(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The union of labels, and of paths in them with the sums of their weights."""
    labels, number = _sorted_labels(pa.concat_arrays([own for own, _, _ in parts]))
    columns, start = np.empty((DEPTH, sum(len(paths) for _, paths, _ in parts)), np.int32), 0
    at = 0
    for own, paths, _ in parts:
        own = np.append(number[start : start + len(own)], np.int32(-1))  # -1 stays -1
        start += len(own) - 1
        for i in range(DEPTH):
            columns[i, at : at + len(paths)] = own[paths[:, i]]
        at += len(paths)
    return labels, *summed_paths(columns.T, np.concatenate([weights for _, _, weights in parts]))


def united(parts: list[Transducer]) -> Transducer:
    """The union of transducers, with the sums of their weights."""
    return Transducer.of_paths(*_united_paths([(p.labels, *p.paths()) for p in parts]))


def composed(asked: Transducer, counts: Transducer) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth, the prefixes of ``asked`` in its labels and what they weigh in ``counts``: the arcs of the product."""
    of = pc.index_in(asked.labels, value_set=counts.labels.cast(asked.labels.type))
    of = of.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 0), np.int32)
    out = []
    for i in range(DEPTH):
        take, begins = _spans(asked.first[i][left], asked.first[i][left + 1] - asked.first[i][left])
        owner = np.repeat(np.arange(len(left)), np.diff(begins))
        label = of[asked.label[i][take]]
        state = right[owner]
        # arcs of a state are sorted by label: find each within its state's
        key = np.repeat(np.arange(len(counts.first[i]) - 1), np.diff(counts.first[i])) * (len(counts.labels) + 1) + counts.label[i]
        wanted = state.astype(np.int64) * (len(counts.labels) + 1) + label
        at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        hit = (label >= 0) & (key[at] == wanted) if len(key) else np.zeros(len(wanted), bool)
        take, owner, at = take[hit], owner[hit], at[hit]
        prefix = np.concatenate([prefix[owner], asked.label[i][take][:, None]], axis=1)
        out.append((prefix, counts.weight[i][at]))
        left, right = asked.target[i][take], counts.target[i][at]
        on = (left >= 0) & (right >= 0)
        left, right, prefix = left[on], right[on], prefix[on]
    return out


# --- texts ------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of about TEXT_BYTES at a time; a longer text comes alone."""
    langs, texts, size = [], [], 0
    for batch in batches:
        lang, text = batch["lang"], batch["text"].cast(pa.large_string()).fill_null("")
        _, ends = byte_view(text)
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + TEXT_BYTES - size, "right")) - 1)
            langs.append(lang.slice(a, b - a))
            texts.append(text.slice(a, b - a))
            size += int(ends[b] - ends[a])
            a = b
            if size >= TEXT_BYTES:
                yield pa.concat_arrays(langs), pa.concat_arrays(texts)
                langs, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(langs), pa.concat_arrays(texts)


def _words(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, lang number of each, whether the next one follows it in its piece, where each lang number is in langs)
    of at most TEXT_WORDS words and the two after them, which are marked by lang -1."""
    data, bounds = byte_view(texts)
    own, bounds = LOWER[data[bounds[0] : bounds[-1]]], bounds - bounds[0]
    inside = ~OUTSIDE[own]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[filled] = inside[filled]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[filled[1:] - 1] = inside[filled[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return
    text = np.searchsorted(bounds, start, "right") - 1
    breaks = np.flatnonzero(BREAK[own])
    piece = np.searchsorted(breaks, start)
    follows = np.zeros(len(start), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    lang = langs.dictionary_encode()
    number = lang.indices.to_numpy(zero_copy_only=False)[text]
    del begins, ends, filled, text, breaks, piece
    for a in range(0, len(start), TEXT_WORDS):
        b = min(a + TEXT_WORDS, len(start))
        c = min(b + 2, len(start))
        lengths = end[a:c] - start[a:c]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        held = own[start[a] : end[c - 1]][inside[start[a] : end[c - 1]]]
        words = pa.Array.from_buffers(pa.binary(), c - a, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])
        marked = number[a:c].astype(np.int64)
        marked[b - a :] = -1
        yield words, marked, follows[a:c], lang.dictionary


def _coded(words: pa.Array, lang: np.ndarray, follows: np.ndarray, langs: pa.Array) -> tuple:
    """Labels, and by number of them the words, and the lang of each that has one; whether the next word follows."""
    names, words = langs.cast(pa.string()).cast(pa.binary()), words.dictionary_encode()
    word = words.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(len(names))
    return pa.concat_arrays([names, words.dictionary]), word, lang[lang >= 0].astype(np.int32), follows


def counted_paths(coded: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Labels, and the distinct sorted paths that begin at each word with a lang, with their numbers; ``coded`` is emptied."""
    labels, number = _sorted_labels(pa.concat_arrays([own for own, *_ in coded]))
    return labels, *summed_paths(_paths_of(coded, number), None)


def _paths_of(coded: list[tuple], number: np.ndarray) -> np.ndarray:
    columns, at, start = np.full((DEPTH, sum(len(lang) for _, _, lang, _ in coded)), -1, np.int32), 0, 0
    while coded:
        own, word, lang, follows = coded.pop(0)
        own = number[start : start + len(own)]
        start += len(own)
        word, n = own[word], len(lang)
        paths = columns[:, at : at + n]
        paths[0], paths[1] = own[lang], word[:n]
        on = np.ones(n, bool)
        for i in range(2, DEPTH):  # the word i - 1 places on, if every one before it is followed
            more = max(0, min(n, len(word) - i + 1))
            on = on[:more] & follows[i - 2 : i - 2 + more]
            paths[i, :more] = np.where(on, word[i - 1 : i - 1 + more], np.int32(-1))
        at += n
    return columns.T


def counted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Labels, paths and numbers of about SHARD_WORDS words at a time."""
    coded, words = [], 0
    for block in _blocks(batches):
        for found in _words(*block):
            coded.append(_coded(*found))
            words += len(coded[-1][2])
            if words >= SHARD_WORDS:
                yield counted_paths(coded)
                coded, words = [], 0
    if coded:
        yield counted_paths(coded)


def _give_back() -> None:
    """Memory that is free again goes back to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


# --- ranges -----------------------------------------------------------------------


class Bounds:
    """Sorted paths that cut all paths into ranges: range r is from bound r - 1 to below bound r."""

    def __init__(self, paths: list[tuple[bytes, ...]]):
        self.paths = sorted(set(paths))
        self.cut = {d: [p[:d] for p in self.paths] for d in range(1, DEPTH + 1)}

    def ranges(self, prefix: tuple[bytes, ...]) -> range:
        """The ranges that may hold paths with this prefix."""
        return range(bisect_right(self.paths, prefix), bisect_right(self.cut[len(prefix)], prefix) + 1)

    def places(self, labels: pa.Array, paths: np.ndarray) -> np.ndarray:
        """Where each bound cuts sorted paths of numbered labels."""
        known = {}
        names = sorted({label for p in self.paths for label in p})
        if names:
            values = labels.to_pylist() if len(names) * 20 > len(labels) else None
            for name in names:
                at = bisect_right(values, name) if values is not None else _rank(labels, name)
                present = at > 0 and (values[at - 1] if values is not None else labels[at - 1].as_py()) == name
                known[name] = (at - 1, True) if present else (at, False)
        out = []
        for p in self.paths:
            low, high = 0, len(paths)
            for i in range(DEPTH):
                if i == len(p):
                    break  # the bound itself comes before what it begins
                number, present = known[p[i]]
                column = paths[low:high, i]
                a, b = (int(np.searchsorted(column, np.int32(number), side)) for side in ("left", "right"))
                if not present:
                    high = low = low + a
                    break
                low, high = low + a, low + b
            out.append(low)
        return np.array(out, np.int64)


def _rank(labels: pa.Array, name: bytes) -> int:
    low, high = 0, len(labels)
    while low < high:
        middle = (low + high) // 2
        if labels[middle].as_py() <= name:
            low = middle + 1
        else:
            high = middle
    return low


def _cut(labels: pa.Array, paths: np.ndarray, weights: np.ndarray, bounds: Bounds) -> Iterator[tuple[int, Transducer]]:
    """The transducers of sorted paths by range, each with the labels it uses."""
    edges = [0, *bounds.places(labels, paths).tolist(), len(paths)]
    number, there = np.full(len(labels) + 1, -1, np.int32), np.zeros(len(labels) + 1, bool)  # -1, after the end, stays
    for r, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            own = paths[a:b]
            if 32 * len(own) < len(labels):
                used = np.sort(own, axis=None)
                used = used[np.append(used[1:] != used[:-1], True) & (used >= 0)]
            else:
                there[own] = True
                used = np.flatnonzero(there[:-1])
                there[used] = False
            number[used] = np.arange(len(used))
            yield r, Transducer.of_paths(labels.take(pa.array(used)), _matrix([number[own[:, i]] for i in range(DEPTH)]), weights[a:b])


def _sampled_paths(documents: DataFrame, total: int) -> list[tuple[bytes, ...]]:
    """Paths of some words of some texts."""
    share = min(1.0, 2 * SAMPLE_TEXTS / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches):
            for k in range(len(texts)):
                for words, lang, follows, names in _words(langs.slice(k, 1), texts.slice(k, 1)):
                    n = int((lang >= 0).sum())
                    rows = []
                    for at in np.unique(np.linspace(0, n - 1, SAMPLE_PATHS).astype(int)).tolist():
                        path = [names[0].as_py().encode(), words[at].as_py()]
                        while len(path) < DEPTH and follows[at]:
                            at += 1
                            path.append(words[at].as_py())
                        rows.append((path, n / SAMPLE_PATHS))
                    paths, weights = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.list_(pa.binary())), pa.array(weights)], ["path", "weight"])
                    break  # of a very long text, its first words

    rows = documents.sample(share, seed=11).limit(SAMPLE_TEXTS).mapInArrow(run, "path array<binary>, weight double").collect()
    return [(tuple(bytes(label) for label in r["path"]), r["weight"]) for r in rows]


def bounds_of(documents: DataFrame, ranges: int, total: int) -> Bounds:
    """Bounds of about equally many occurrences each, by a bounded sample of texts."""
    sample = sorted(_sampled_paths(documents, total)) if ranges > 1 else []
    if not sample:
        return Bounds([])
    reached = np.cumsum([w for _, w in sample])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges)
    return Bounds([sample[i][0] for i in np.minimum(at, len(sample) - 1)])


# --- Spark ------------------------------------------------------------------------


def _read(documents: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return documents.select(lang, F.col("text").cast("string").alias("text"))


def _rows(parts: Iterator[tuple[int, Transducer]]) -> Iterator[pa.RecordBatch]:
    """(range, part) of about HANDED bytes at a time."""
    rows, held = [], 0
    for r, part in parts:
        rows.append((r, part.to_bytes()))
        held += len(rows[-1][1])
        if held >= HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["range", "part"])
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["range", "part"])


def shard_transducers(documents: DataFrame, bounds: Bounds) -> DataFrame:
    """(range, part): the transducers of some tens of MB of texts each, cut by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in counted_shards(batches):
            yield from _rows(_cut(*shard, bounds))
            del shard
            _give_back()

    return documents.mapInArrow(run, "range long, part binary")


def united_ranges(parts: DataFrame, bounds: Bounds, grouped: int) -> DataFrame:
    """(range, part): one transducer per range, of the parts of groups of ``grouped`` ranges."""
    groups = len(bounds.paths) // grouped + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, held = None, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            whole = waiting.pop() if len(waiting) == 1 else _united_paths(waiting)
            waiting.clear()
            first = current * grouped
            yield from _rows((first + r, part) for r, part in _cut(*whole, Bounds(bounds.paths[first : first + grouped - 1])))
            del whole
            _give_back()

        for batch in batches:
            for group, data in zip(batch["range"].to_pylist(), batch["part"]):
                if group != current and waiting:
                    yield from finished()
                    held = 0
                current = group
                part = Transducer.from_bytes(data.as_buffer())
                waiting.append((part.labels, *part.paths()))
                held += part.size
                if held > MERGED and held > 2 * len(waiting[0][1]):  # never many at once
                    waiting = [_united_paths(waiting)]
                    held = len(waiting[0][1])
        if waiting:
            yield from finished()

    parts = parts.repartition(groups, "range").sortWithinPartitions("range")
    return parts.mapInArrow(run, "range long, part binary")


def phrase_counts(transducers: DataFrame, bounds: Bounds, least: int) -> DataFrame:
    """(lang, phrase, f): langs (an empty phrase), and phrases of two and three words with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, data in zip(batch["range"].to_pylist(), batch["part"]):
                counts = Transducer.from_bytes(data.as_buffer())
                open_ends = {p[:d] for p in bounds.paths[max(r - 1, 0) : r + 1] for d in (3, 4) if d <= len(p)}
                for depth in (1, 3, 4):
                    paths, weights = counts.arcs(depth, least if depth > 1 else 0)
                    yield _phrases(counts.labels, paths, weights)
                # another range may have the rest of their occurrences
                few = [(p, w) for p in sorted(open_ends) if 0 < (w := counts.weight_of(p)) < least]
                if few:
                    lang, phrase = pa.array([p[0] for p, _ in few], pa.binary()), pa.array([p[1:] for p, _ in few], pa.list_(pa.binary()))
                    columns = [lang.cast(pa.string()), phrase.cast(pa.list_(pa.string())), pa.array([w for _, w in few], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    rows = transducers.mapInArrow(run, "lang string, phrase array<string>, f long")
    rows = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return rows.where((F.size("phrase") == 0) | (F.col("f") >= least))


def _phrases(labels: pa.Array, paths: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Rows of paths of one depth."""
    depth = paths.shape[1]
    words = labels.take(pa.array(paths[:, 1:].ravel())).cast(pa.string())
    phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1) * (depth - 1), pa.int32()), words)
    lang = labels.take(pa.array(paths[:, 0])).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(weights, pa.int64())], ["lang", "phrase", "f"])


def looked_up(asked: DataFrame, transducers: DataFrame, bounds: Bounds, ranges: int) -> DataFrame:
    """(lang, phrase, f) of the distinct (lang, phrase) asked for, by composition in each range."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            langs = batch["lang"].cast(pa.binary()).to_pylist()
            phrases = batch["phrase"].cast(pa.list_(pa.binary())).to_pylist()
            for i, (lang, phrase) in enumerate(zip(langs, phrases)):
                for r in bounds.ranges((lang, *phrase)):
                    rows.append(r)
                    owner.append(i)
            take = pa.array(owner, pa.int64())
            columns = [pa.array(rows, pa.int64()), pa.nulls(len(rows), pa.binary()), batch["lang"].take(take), batch["phrase"].take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["range", "part", "lang", "phrase"])

    schema = "range long, part binary, lang string, phrase array<string>"
    questions = asked.mapInArrow(dealt, schema)
    answers = transducers.select("range", "part", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("array<string>").alias("phrase"))
    both = answers.union(questions).repartition(ranges, "range").sortWithinPartitions("range", F.col("part").desc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, None
        for batch in batches:
            numbers = batch["range"].to_numpy()
            at = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1)) if len(numbers) else []
            for a, b in zip(at, [*at[1:], len(numbers)]):
                if numbers[a] != current:
                    current, counts = numbers[a], None
                if batch["part"][a].is_valid:
                    counts = Transducer.from_bytes(batch["part"][a].as_buffer())
                    a += 1
                if a < b and counts is not None:
                    yield from _answers(batch["lang"].slice(a, b - a), batch["phrase"].slice(a, b - a), counts)

    return both.mapInArrow(run, "lang string, phrase array<string>, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _answers(langs: pa.Array, phrases: pa.Array, counts: Transducer) -> Iterator[pa.RecordBatch]:
    langs, words = langs.cast(pa.binary()), phrases.flatten().cast(pa.binary())
    labels, number = _sorted_labels(pa.concat_arrays([langs, words]))
    sizes = pc.list_value_length(phrases).to_numpy(zero_copy_only=False)
    paths = np.full((len(langs), DEPTH), -1, np.int32)
    paths[:, 0] = number[: len(langs)]
    take, begins = _spans(np.zeros(len(sizes), np.int64), sizes)
    paths[np.repeat(np.arange(len(sizes)), sizes), take + 1] = number[len(langs) :]
    paths, ones = summed_paths(paths, np.ones(len(paths), np.int64))
    wanted = {tuple(p[p >= 0]) for p in paths}
    for prefix, weight in composed(Transducer.of_paths(labels, paths, ones), counts)[1:]:
        own = np.array([tuple(p) in wanted for p in prefix.tolist()], bool)
        if own.any():
            yield _phrases(labels, prefix[own], weight[own])


def cut_score() -> Column:
    """floor(10 ** 6 a a / (l r)) in 38 digits, which hold it for a below 10 ** 16."""
    a, left, right = (F.col(c).cast("decimal(19,0)") for c in "alr")
    square = (a * a).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def collocations(documents: DataFrame, top: int = 2000, least: int = 10, percent: int = 50, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases by score, a (both falling) and phrase."""
    scratch = Scratch(documents.sparkSession)
    documents = _read(documents)
    size = documents.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(1, -(-(size["bytes"] or 0) // range_bytes))
    bounds = bounds_of(documents, ranges, size["rows"])
    ranges = len(bounds.paths) + 1
    grouped = min(GROUPED, -(-ranges // GROUPS))
    groups = Bounds(bounds.paths[grouped - 1 :: grouped])
    transducers = scratch.keep(united_ranges(shard_transducers(documents, groups), bounds, grouped), "transducers")
    counted = scratch.keep(phrase_counts(transducers, bounds, least), "counted")
    found = counted.where(F.size("phrase") > 1)

    size = F.size("phrase")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), cut)
    first, rest = F.slice("phrase", 1, F.col("k")), F.slice("phrase", F.col("k") + 1, size)
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    parts = cuts.select("lang", F.explode(F.array("first", "rest")).alias("phrase")).distinct()
    known = scratch.keep(looked_up(parts, transducers, bounds, ranges), "known")

    # what holds a phrase of two words
    longer = found.where(size == 3).select("lang", F.col("f").alias("of"), F.explode(F.array(F.slice("phrase", 1, 2), F.slice("phrase", 2, 2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    kept = found.withColumnRenamed("f", "a").join(longer, ["lang", "phrase"], "left")
    kept = scratch.keep(kept.where((F.size("phrase") == 3) | F.col("of").isNull() | (100 * F.col("of") < percent * F.col("a"))).select("lang", "phrase"), "kept")

    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(kept, ["lang", "phrase"], "left_semi").join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", cut_score().alias("score"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    scored = scored.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    totals = counted.where(F.size("phrase") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
