"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark.

Tokens of a text are its words, A-Z in lower case, and one end.  The model:

    p(w | u v) = (c(u v w) - D") / c(u v) + g(u v) * p(w | v)     p(w | v) if u v is unseen
    p(w | v)   = (c(v w) - D) / c(v) + g(v) * p1(w)               p1(w) if v is unseen
    p1(w)      = (c'(w) - D') / C'  + g' / (V + 1)

The highest order counts n-grams as they occur.  Below order 3, c(v w) is the
number of distinct tokens before v w, and only bigrams that begin a text, which
have none, keep their count; c(v) is the sum of the c(v w).  c'(w) is the number
of distinct words before w.  The discounts D depend on the count (1, 2, 3 or
more), and g gives what they take to the next level.

Counting: tasks add up their own words and bigrams, and send sorted blocks of
(key, count) to the shard that holds the key; the shard merges its blocks into
one sorted array.  Words are 64-bit hashes in hash order, so the place of a word
in that order is its number, bigrams are pairs of such numbers, and everything
known of a word is an array by number.  Trigrams are pairs of the place of their
first bigram in the order of all bigrams, and a number.  Of sorted keys the files
hold the lower halves, and where each upper half begins; of counts a byte, and
those that need more apart.

The arrays are files in the shared folder, and workers map them into memory to
score: pages are read as they are looked up and shared by the workers of a
machine; no process holds the model.  A task's file is written under another
name and then renamed, so a repeated task does no harm.  The folder must be a
path on every machine, as a mounted shared file system is.

A null text is an empty one: it has the end alone.  Repeated rows count each.
Rows with a null doc_id are trained on.  Without training rows every token has
probability 1 / (V + 1) = 1.
"""

import functools
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trophos.llm import words as W
from trophos.plans.scratch import Scratch

#: Bigrams that a task gathers before it adds them up, and that a shard should hold about.
GATHER, SHARD = 1 << 21, 1 << 23
_BLOCK = "shard int, n long, keys binary, counts binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


# --- blocks and files -------------------------------------------------------


def _press(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: high bytes of small numbers vanish."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return _ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpress(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, decompressed_size=8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _block(shard: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    steps = np.diff(keys, prepend=np.uint64(0))
    return int(shard), len(keys), _press(steps), _press(counts)


def _blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """A block for each shard; ``shard`` rises with ``keys``."""
    at = np.flatnonzero(np.diff(shard, prepend=-1)) if len(keys) else []
    ends = [*at[1:], len(keys)] if len(keys) else []
    return [_block(shard[a], keys[a:b], counts[a:b]) for a, b in zip(at, ends)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "n", "keys", "counts"])


def _sum_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of their counts."""
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of rows that come in the order of their shard."""
    shard, keys, counts = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard and keys:
                yield shard, *_sum_up(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [], []
            shard = row["shard"]
            keys.append(np.cumsum(_unpress(row["keys"], row["n"]), dtype=np.uint64))
            counts.append(_unpress(row["counts"], row["n"]))
            if len(keys) > 16:  # a shard never holds many unmerged blocks
                a, b = _sum_up(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [a], [b]
    if keys:
        yield shard, *_sum_up(np.concatenate(keys), np.concatenate(counts))


def _by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard")


def local_path(path: str) -> str:
    """The shared folder as a path that workers can map files of."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model needs a shared folder that is mounted on every machine")
    return parts.path


def _write_keys(folder: str, kind: str, shard: int, keys: np.ndarray) -> None:
    """Distinct sorted keys, counted from the first that the shard could have."""
    upper = (keys >> np.uint64(32)).astype(np.int64)
    _write(folder, kind, shard, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    _write(folder, f"{kind}_upper", shard, np.searchsorted(upper, np.arange(upper[-1] + 2)))


def _places(folder: str, kind: str, shard: int, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a file of keys; -1 if it does not have them."""
    lower, begins = _mapped(folder, kind, shard), _mapped(folder, f"{kind}_upper", shard)
    upper, wanted = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    inside = upper < len(begins) - 1
    upper = np.where(inside, upper, 0)
    low, end = np.array(begins[upper]), np.where(inside, begins[upper + 1], begins[upper])
    high = end
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (lower[np.minimum(middle, len(lower) - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return np.where((low < end) & (lower[np.minimum(low, len(lower) - 1)] == wanted), low, -1)


def _write_counts(folder: str, kind: str, shard: int, counts: np.ndarray) -> None:
    large = np.flatnonzero(counts >= 255)
    _write(folder, kind, shard, np.minimum(counts, 255).astype(np.uint8))
    _write(folder, f"{kind}_large", shard, np.stack([large, counts[large].astype(np.int64)]))


def _counts(folder: str, kind: str, shard: int, places: np.ndarray) -> np.ndarray:
    out = _mapped(folder, kind, shard)[places].astype(np.int64)
    if (large := out == 255).any():
        at, counts = _mapped(folder, f"{kind}_large", shard)
        out[large] = counts[np.searchsorted(at, places[large])]
    return out


def _write(folder: str, kind: str, shard: int, values: np.ndarray) -> None:
    target = f"{folder}/{kind}-{shard:06d}.npy"
    os.makedirs(folder, exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}.part"  # a copy of the task may write the same file
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, target)


@functools.lru_cache(maxsize=None)
def _mapped(folder: str, kind: str, shard: int) -> np.ndarray:
    path = f"{folder}/{kind}-{shard:06d}.npy"
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


# --- model ------------------------------------------------------------------


@dataclass
class Model:
    """Sizes and discounts; the arrays are files below ``folder``."""

    folder: str
    word_shards: int
    first: np.ndarray  # number of the first word of each word shard, and the end
    documents: int = 0
    tokens: int = 0  # training tokens, ends included
    order: int = 2
    pair_shards: int = 1
    pair_first: np.ndarray | None = None  # place of the first bigram of each shard by number, and the end
    pairs: int = 0  # distinct bigrams
    triple_shards: int = 1
    triples: int = 0  # distinct trigrams
    triple_discounts: tuple = (0.0, 0.0, 0.0)
    discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    word_rest: float = 1.0  # g'

    @property
    def words(self) -> int:
        return int(self.first[-1])

    @property
    def types(self) -> int:
        """Distinct tokens, the end included."""
        return self.words + (self.documents > 0)

    # the two marks have the numbers after the last word
    @property
    def begin(self) -> int:
        return self.words

    @property
    def end(self) -> int:
        return self.words + 1

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.word_shards) >> np.uint64(32)).astype(np.int64)

    def pair_shard(self, numbers: np.ndarray) -> np.ndarray:
        return numbers.astype(np.int64) * self.pair_shards // (self.words + 2)

    def pair_start(self, shard: int) -> int:
        """The smallest number in a shard by number."""
        return -(-shard * (self.words + 2) // self.pair_shards)

    def _parts(self, shards: np.ndarray) -> Iterator[tuple[int, slice]]:
        at = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, b in zip(at, [*at[1:], len(shards)]):
            yield int(shards[a]), slice(a, b)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of distinct sorted hashes; -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for shard, own in self._parts(self.word_shard(hashes)):
            if self.first[shard] < self.first[shard + 1]:
                known = _mapped(self.folder, "word", shard)
                at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
                out[own] = np.where(known[at] == hashes[own], at + self.first[shard], -1)
        return out

    def word_counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts in training of distinct sorted numbers of words."""
        out = np.zeros(len(numbers), np.int64)
        for shard, own in self._parts(np.searchsorted(self.first, numbers, "right") - 1):
            out[own] = _mapped(self.folder, "count", shard)[numbers[own] - self.first[shard]]
        return out

    def by_number(self, kind: str, numbers: np.ndarray) -> np.ndarray:
        """What the shards by number know of distinct sorted numbers."""
        out = np.zeros(len(numbers))
        for shard, own in self._parts(self.pair_shard(numbers)):
            out[own] = _mapped(self.folder, kind, shard)[numbers[own] - self.pair_start(shard)]
        return out

    def pair_places(self, keys: np.ndarray) -> np.ndarray:
        """Places of distinct sorted bigrams; -1 if unknown."""
        out = np.full(len(keys), -1, np.int64)
        for shard, own in self._parts(self.pair_shard(keys >> np.uint64(32))):
            at = _places(self.folder, "pair", shard, self.in_pair_shard(keys[own], shard))
            out[own] = np.where(at >= 0, at + self.pair_first[shard], -1)
        return out

    def in_pair_shard(self, keys: np.ndarray, shard: int) -> np.ndarray:
        return keys - (np.uint64(self.pair_start(shard)) << np.uint64(32))

    def _pair_parts(self, places: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        for shard, own in self._parts(np.searchsorted(self.pair_first, places, "right") - 1):
            yield shard, own, places[own] - self.pair_first[shard]

    def by_pair(self, kind: str, places: np.ndarray) -> np.ndarray:
        """Counts of the bigrams at distinct sorted places."""
        out = np.zeros(len(places), np.int64)
        for shard, own, at in self._pair_parts(places):
            out[own] = _counts(self.folder, kind, shard, at)
        return out

    def pair_second(self, places: np.ndarray) -> np.ndarray:
        """Second number of the bigrams at distinct sorted places."""
        out = np.zeros(len(places), np.uint64)
        for shard, own, at in self._pair_parts(places):
            out[own] = _mapped(self.folder, "pair", shard)[at]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted bigrams, as their level has them."""
        places = self.pair_places(keys)
        out = np.zeros(len(keys), np.int64)
        out[places >= 0] = self.by_pair("pairs" if self.order == 2 else "adjusted", places[places >= 0])
        return out

    def triple_keys(self, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return places.astype(np.uint64) * np.uint64(self.words + 2) + numbers.astype(np.uint64)

    def triple_shard(self, places: np.ndarray) -> np.ndarray:
        return places.astype(np.int64) * self.triple_shards // self.pairs

    def triple_start(self, shard: int) -> int:
        """The smallest place of a first bigram in a shard of trigrams."""
        return -(-shard * self.pairs // self.triple_shards)

    def by_context(self, kind: str, places: np.ndarray) -> np.ndarray:
        """What the shards of trigrams know of the bigrams at distinct sorted places."""
        out = np.zeros(len(places), np.int64)
        for shard, own in self._parts(self.triple_shard(places)):
            out[own] = _counts(self.folder, kind, shard, places[own] - self.triple_start(shard))
        return out

    def triple_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted trigrams whose first bigram is known."""
        out = np.zeros(len(keys), np.int64)
        base = np.uint64(self.words + 2)
        for shard, own in self._parts(self.triple_shard(keys // base)):
            at = _places(self.folder, "triple", shard, keys[own] - np.uint64(self.triple_start(shard)) * base)
            found = np.zeros(len(at), np.int64)
            found[at >= 0] = _counts(self.folder, "triples", shard, at[at >= 0])
            out[own] = found
        return out

    def lower(self, numbers: np.ndarray) -> np.ndarray:
        """p1 of distinct sorted numbers, -1 for unknown words."""
        before = np.zeros(len(numbers))
        if self.pairs:
            known = numbers >= 0
            before[known] = self.by_number("before", numbers[known])
        return _discounted(before, self.word_discounts) / max(self.pairs, 1) + self.word_rest / (self.types + 1)


def _discounted(counts: np.ndarray, discounts: tuple) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3).astype(int)], 0.0)


def _discounts(n: list[int]) -> tuple:
    """Modified discounts from the numbers of keys with count 1 to 4; where one is missing, half a count."""
    if not all(n):
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(float(min(max(d, 0.01), k + 1 - 0.01)) for k, d in enumerate(found))


def _token_numbers(model: Model, s: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of begin, words and end of each text; the text of each; where the begins are."""
    known, back = np.unique(W.hashes(s), return_inverse=True)
    numbers = model.numbers(known)[back]
    count = np.bincount(s.text, minlength=s.texts) + 2
    text = np.repeat(np.arange(s.texts), count)
    starts = np.cumsum(count) - count
    out = np.empty(len(text), np.int64)
    out[starts], out[starts + count - 1] = model.begin, model.end
    inner = np.ones(len(text), bool)
    inner[starts] = inner[starts + count - 1] = False
    out[inner] = numbers
    return out, text, starts


def train(texts: DataFrame, scratch: Scratch, order: int = 2) -> Model:
    """Model of the column ``text``.  Only sizes of shards come to the driver."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: the model has order 2 or 3")
    spark = texts.sparkSession
    folder = f"{local_path(scratch.path)}/model"
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(folder, shards, np.zeros(shards + 1, np.int64), order=order)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_seen, held, size = 0, [], 0
        for batch in batches:
            texts_seen += len(batch)
            for s in W.slices(batch["text"]):
                held.append(_sum_up(W.hashes(s)))
                size += len(held[-1][0])
                if size > GATHER:
                    held = [_sum_up(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > GATHER // 2:
                        yield _batch(_blocks(model.word_shard(held[0][0]), *held[0]))
                        held, size = [], 0
        if held:
            keys, counts = _sum_up(*map(np.concatenate, zip(*held)))
            yield _batch(_blocks(model.word_shard(keys), keys, counts))
        yield _batch([_block(-1, np.zeros(1, np.uint64), np.array([texts_seen]))])

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            if shard >= 0:
                _write(folder, "word", shard, keys)
                _write(folder, "count", shard, counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
            yield _sizes([(shard, len(keys), int(counts.sum()))])

    source = texts.select("text")
    blocks = _by_shard(source.mapInArrow(count_words, _BLOCK), shards)
    sizes = {r["shard"]: r for r in scratch.keep(blocks.mapInArrow(merge_words, _SIZES)).collect()}
    model.documents = sizes.pop(-1)["total"] if -1 in sizes else 0
    model.first = np.cumsum([0, *(sizes[s]["n"] if s in sizes else 0 for s in range(shards))])
    model.tokens = sum(r["total"] for r in sizes.values()) + model.documents
    if not model.documents:
        return model
    model.pair_shards = max(shards, model.tokens // SHARD + 1)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in W.slices(batch["text"]):
                numbers, text, _ = _token_numbers(model, s)
                follows = text[1:] == text[:-1]
                key = numbers[:-1].astype(np.uint64) << np.uint64(32) | numbers[1:].astype(np.uint64)
                held.append(key[follows])
                size += len(held[-1])
                if size > GATHER:
                    keys, counts = _sum_up(np.concatenate(held))
                    yield _batch(_blocks(model.pair_shard(keys >> np.uint64(32)), keys, counts))
                    held, size = [], 0
        if held:
            keys, counts = _sum_up(np.concatenate(held))
            yield _batch(_blocks(model.pair_shard(keys >> np.uint64(32)), keys, counts))

    def write_contexts(shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        start, stop = model.pair_start(shard), model.pair_start(shard + 1)
        at = (keys >> np.uint64(32)).astype(np.int64) - start
        sums = lambda x: np.bincount(at, weights=x, minlength=stop - start)
        _write(folder, "after", shard, sums(counts))
        for k, own in enumerate((counts == 1, counts == 2, counts > 2)):
            _write(folder, f"kinds{k}", shard, sums(own).astype(np.uint32))

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            _write_keys(folder, "pair", shard, model.in_pair_shard(keys, shard))
            _write_counts(folder, "pairs", shard, counts)
            if order == 2:
                write_contexts(shard, keys, counts)
            after, n = _sum_up(keys & np.uint64(0xFFFFFFFF))
            rows = _blocks(model.pair_shard(after), after, n)
            tally = np.array([len(keys), *((counts == k).sum() for k in range(1, 5))])
            yield _batch([*rows, (-1 - shard, 5, _press(tally), b"")])

    def merge_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            start, stop = model.pair_start(shard), model.pair_start(shard + 1)
            before = np.zeros(stop - start, np.uint32)
            before[keys.astype(np.int64) - start] = counts
            _write(folder, "before", shard, before)
            yield _sizes([(shard, int((counts == k).sum()), k) for k in range(1, 5)])

    blocks = _by_shard(source.mapInArrow(count_pairs, _BLOCK), model.pair_shards)
    merged = scratch.keep(blocks.mapInArrow(merge_pairs, _BLOCK))
    tallies = {-1 - r["shard"]: _unpress(bytes(r["keys"]), 5) for r in merged.where("shard < 0").collect()}
    model.pairs, *n = map(int, np.sum(list(tallies.values()), axis=0))
    model.pair_first = np.cumsum([0, *(int(tallies[s][0]) if s in tallies else 0 for s in range(model.pair_shards))])
    model.discounts = _discounts(n)
    rows = scratch.keep(_by_shard(merged.where("shard >= 0"), model.pair_shards).mapInArrow(merge_before, _SIZES)).collect()
    n = [sum(r["n"] for r in rows if r["total"] == k) for k in range(1, 5)]
    model.word_discounts = _discounts(n)
    kinds = [n[0], n[1], model.types - n[0] - n[1]]  # every token follows some token
    model.word_rest = sum(d * k for d, k in zip(model.word_discounts, kinds)) / model.pairs
    if order == 3:
        _train_triples(source, model, write_contexts)
    return model


def _train_triples(source: DataFrame, model: Model, write_contexts: Callable) -> None:
    """The level of trigrams, and what the level of bigrams counts below it.

    Blocks of shard -1 are numbers of trigrams, in all and with count 1 to 4;
    before the trigrams are merged, those from -2 down are bigrams that begin a text.
    """
    folder, base = model.folder, np.uint64(model.words + 2)
    if model.pairs * (model.words + 2) >= 1 << 64:
        raise ValueError("trigrams do not fit into 64 bits")
    model.triple_shards = max(model.word_shards, model.tokens // (SHARD // 2) + 1)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begins, size = [], [], 0

        def added_up() -> pa.RecordBatch:
            keys, counts = _sum_up(np.concatenate(held))
            pairs, n = _sum_up(np.concatenate(begins))
            rows = _blocks(model.triple_shard(keys // base), keys, counts)
            return _batch([*rows, *_blocks(-2 - model.pair_shard(pairs >> np.uint64(32)), pairs, n)])

        for batch in batches:
            for s in W.slices(batch["text"]):
                numbers, text, starts = _token_numbers(model, s)
                pairs = numbers[:-1].astype(np.uint64) << np.uint64(32) | numbers[1:].astype(np.uint64)
                follows = np.flatnonzero(text[2:] == text[:-2])
                held.append(model.triple_keys(_once(model.pair_places, pairs[follows]), numbers[follows + 2]))
                begins.append(pairs[starts])
                size += len(numbers)
                if size > GATHER:
                    yield added_up()
                    held, begins, size = [], [], 0
        if held:
            yield added_up()

    def merge_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            if shard < 0:
                yield _batch([_block(-2 - shard, keys, counts)])
                continue
            start, stop = model.triple_start(shard), model.triple_start(shard + 1)
            _write_keys(folder, "triple", shard, keys - np.uint64(start) * base)
            _write_counts(folder, "triples", shard, counts)
            places = (keys // base).astype(np.int64)
            for k, own in enumerate((counts == 1, counts == 2, counts > 2)):
                _write_counts(folder, f"triple_kinds{k}", shard, np.bincount(places[own] - start, minlength=stop - start))
            pairs, n = _sum_up(_once(model.pair_second, places) << np.uint64(32) | keys % base)
            tally = np.array([len(keys), *((counts == k).sum() for k in range(1, 5))])
            rows = _blocks(model.pair_shard(pairs >> np.uint64(32)), pairs, n)
            yield _batch([*rows, _block(-1, np.arange(5, dtype=np.uint64), tally)])

    def merge_adjusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            if shard < 0:
                yield _sizes([(shard, int(n), int(k)) for k, n in zip(keys, counts)])
                continue
            if len(keys) != model.pair_first[shard + 1] - model.pair_first[shard]:
                raise ValueError(f"shard {shard}: bigrams without a token before them")
            _write_counts(folder, "adjusted", shard, counts)
            write_contexts(shard, keys, counts)
            yield _sizes([(shard, int((counts == k).sum()), k) for k in range(1, 5)])

    blocks = _by_shard(source.mapInArrow(count_triples, _BLOCK), model.triple_shards)
    adjusted = _by_shard(blocks.mapInArrow(merge_triples, _BLOCK), model.pair_shards)
    rows = adjusted.mapInArrow(merge_adjusted, _SIZES).collect()
    tally = {r["total"]: r["n"] for r in rows if r["shard"] < 0}
    model.triples = tally.get(0, 0)
    model.triple_discounts = _discounts([tally.get(k, 0) for k in range(1, 5)])
    model.discounts = _discounts([sum(r["n"] for r in rows if r["shard"] >= 0 and r["total"] == k) for k in range(1, 5)])


_SIZES = "shard int, n long, total long"


def _sizes(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["shard", "n", "total"])


def _once(function, values: np.ndarray) -> np.ndarray:
    """A function of distinct sorted values, for any values."""
    known, back = np.unique(values, return_inverse=True)
    return function(known)[back]


def _conditional(model: Model, v: np.ndarray, w: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """p(w | v) from p1(w); v is a known word or the begin."""
    contexts, back = np.unique(v, return_inverse=True)
    after = model.by_number("after", contexts)
    rest = sum(d * model.by_number(f"kinds{k}", contexts) for k, d in enumerate(model.discounts)) / after
    seen, counts = w >= 0, np.zeros(len(v), np.int64)
    key = v[seen].astype(np.uint64) << np.uint64(32) | w[seen].astype(np.uint64)
    counts[seen] = _once(model.pair_counts, key)
    return _discounted(counts, model.discounts) / after[back] + rest[back] * lower


def _conditional_on_two(model: Model, places: np.ndarray, w: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """p(w | u v) from p(w | v); ``places`` are those of the known bigrams u v."""
    contexts, back = np.unique(places, return_inverse=True)
    after = model.by_pair("pairs", contexts)  # a token follows every u v
    rest = sum(d * model.by_context(f"triple_kinds{k}", contexts) for k, d in enumerate(model.triple_discounts)) / after
    seen, counts = w >= 0, np.zeros(len(w), np.int64)
    counts[seen] = _once(model.triple_counts, model.triple_keys(places[seen], w[seen]))
    return _discounted(counts, model.triple_discounts) / after[back] + rest[back] * lower


def score_slice(model: Model, s: W.Words) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score and score."""
    numbers, text, starts = _token_numbers(model, s)
    token = np.ones(len(numbers), bool)
    token[starts] = False
    at = np.flatnonzero(token)
    v, w, own = numbers[at - 1], numbers[at], text[at]
    count = np.where(w == model.end, model.documents, 0)
    word = (w >= 0) & (w != model.end)
    count[word] = _once(model.word_counts, w[word])
    base = np.log10((count + 1) / (model.tokens + model.types + 1))
    score = _once(model.lower, w)
    known = v >= 0
    if model.pairs:
        score[known] = _conditional(model, v[known], w[known], score[known])
    if model.triples:
        two = np.flatnonzero(known & (v != model.begin))
        u = numbers[at[two] - 2]
        two, u = two[u >= 0], u[u >= 0]
        places = _once(model.pair_places, u.astype(np.uint64) << np.uint64(32) | v[two].astype(np.uint64))
        two, places = two[places >= 0], places[places >= 0]
        score[two] = _conditional_on_two(model, places, w[two], score[two])
    add = lambda x: np.bincount(own, weights=x, minlength=s.texts)
    return add(np.ones(len(own))), add(count > 0), add(base), add(np.log10(score))


def score_texts(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_slice(model, s) for s in W.slices(batch["text"])]
            tokens, known, base, score = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0)] * 4
            columns = [pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *columns], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(documents: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """Scores of all rows by a model of the rows that are not ``held_out``.

    doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.
    """
    model = train(documents.where(~held_out), Scratch(documents.sparkSession), order)
    scored = score_texts(documents, model)
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
