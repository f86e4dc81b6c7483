"""Phrases against plain counting, and automata against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import CLASHING, ODD
from pyspark.sql import functions as F

from trophos.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000, least=10, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    within[part] = max(within[part], a)
        rows = []
        for p, a in found.items():
            if len(p) == 3 or 100 * within[p] < percent * a:
                cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(frame, **options):
    return sorted(tuple(r) for r in C.collocations(frame, **options).select(*COLUMNS).collect())


@pytest.mark.parametrize("range_bytes", [C.RANGE_BYTES, 20_000])
def test_given_table(spark, documents, range_bytes):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    assert mined(documents, range_bytes=range_bytes) == brute(rows)


def test_hot_words_and_ties(spark, monkeypatch):
    """One word is a third of all; ranges are cut within it; several transducers of bounded words."""
    monkeypatch.setattr(C, "TEXT_WORDS", 700)
    pick = random.Random(2)
    some = [f"w{i}" for i in range(30)]
    text = lambda: "".join(
        ("the " if pick.random() < 0.5 else pick.choice(some) + " ") + ("" if pick.random() < 0.9 else pick.choice(",\n;é "))
        for _ in range(300)
    )
    rows = [(pick.choice(["a", "b", None]), text()) for _ in range(60)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert mined(frame, range_bytes=3_000) == brute(rows)
    assert mined(frame, top=7, least=3, range_bytes=9_000) == brute(rows, top=7, least=3)


def test_odd_rows(spark, odd):
    rows = [(None, t) for _, t in ODD]
    assert mined(odd.drop("lang").withColumn("lang", F.lit(None).cast("string"))) == brute(rows)
    assert mined(odd.limit(0)) == []
    some = [(None, "A b\tC.\x0bB c"), ("und", "a B c,a b"), ("", "a b c  a b c!"), ("é", "É b c; É b c é"), ("x", None), ("x", "...")]
    names = [c for c in CLASHING if c != "lang"]
    frame = spark.createDataFrame(some * 6, "lang string, text string").select("*", *[F.lit(1).alias(c) for c in names])
    assert mined(frame) == brute(some * 6)


def test_scores_beyond_64_bits(spark):
    rows = [(10, 11, 12), (3 * 10**12, 9 * 10**12, 5 * 10**12), (10**15 + 7, 10**15 + 7, 10**15 + 9), (10, 10**18, 10**18)]
    scores = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.cut_score().alias("score"))
    assert [r["score"] for r in scores.collect()] == [10**6 * a * a // (left * right) for a, left, right in rows]


def _random_paths(seed, n, labels):
    pick = np.random.default_rng(seed)
    paths = pick.integers(0, labels, size=(n, C.DEPTH)).astype(np.int32)
    ends = pick.integers(2, C.DEPTH + 1, size=n)
    paths[np.arange(C.DEPTH) >= ends[:, None]] = -1
    return C.summed_paths(paths, pick.integers(1, 3, size=n))


@pytest.mark.parametrize("seed", range(4))
def test_transducers(seed):
    names = pa.array(sorted(f"w{i}".encode() for i in range(9)), pa.binary())
    paths, weights = _random_paths(seed, 400, 9)
    made = C.Transducer.of_paths(names, paths, weights)
    again = C.Transducer.from_bytes(made.to_bytes())
    for one in (made, again):
        got, sums = one.paths()
        assert (got == paths).all() and (sums == weights).all()
    assert sum(map(len, made.label)) < sum(len({tuple(p[: d + 1]) for p in paths if p[d] >= 0}) for d in range(C.DEPTH))
    for depth in range(1, C.DEPTH + 1):
        true = Counter()
        for p, w in zip(paths, weights):
            if p[depth - 1] >= 0:
                true[tuple(p[:depth])] += w
        prefix, sums = made.arcs(depth)
        assert dict(zip(map(tuple, prefix.tolist()), sums.tolist())) == true
    other, more = _random_paths(seed + 50, 300, 9)
    both = C.united([made, C.Transducer.of_paths(names, other, more)])
    union, sums = C.summed_paths(np.concatenate([paths, other]), np.concatenate([weights, more]))
    got, have = both.paths()
    assert (got == union).all() and (have == sums).all()
    asked = C.Transducer.of_paths(names, *_random_paths(seed + 90, 50, 9))
    for depth, (prefix, have) in enumerate(C.composed(asked, made), 1):
        true = dict(zip(map(tuple, made.arcs(depth)[0].tolist()), made.arcs(depth)[1].tolist()))
        wanted = set(map(tuple, asked.arcs(depth)[0].tolist())) & true.keys()
        assert dict(zip(map(tuple, prefix.tolist()), have.tolist())) == {p: true[p] for p in wanted}


def test_bounds_cut_where_python_would():
    names = sorted(f"w{i}".encode() for i in range(9))
    paths, weights = _random_paths(7, 300, 9)
    plain = [tuple(names[i] for i in p if i >= 0) for p in paths]
    assert plain == sorted(plain)
    bounds = C.Bounds([plain[40], plain[41][:2], (b"w3",), (b"w30", b"a"), (b"w5", b"w50", b"x"), (b"z",)])
    parts = dict(C._cut(pa.array(names, pa.binary()), paths, weights, bounds))
    for r in range(len(bounds.paths) + 1):
        low, high = (bounds.paths[r - 1] if r else ()), (bounds.paths[r] if r < len(bounds.paths) else (b"\xff",))
        own = [p for p in plain if low <= p < high]
        got = [tuple(parts[r].labels[i].as_py() for i in p if i >= 0) for p in parts[r].paths()[0]] if r in parts else []
        assert got == own
        assert all(r in bounds.ranges(p[:d]) for p in own for d in range(1, len(p) + 1))


def test_parts_do_not_grow_with_blocks_times_ranges(spark, monkeypatch):
    """Three blocks of text and 126 ranges are one shard, cut at groups of ranges."""
    pick = random.Random(4)
    some = [f"{i:02d}".ljust(20, "x") for i in range(60)]
    rows = [(None, " ".join(pick.choices(some, k=300))) for _ in range(1200)]
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(1)

    def seen(parts, *_):
        raise RuntimeError(f"parts: {parts.count()}")

    monkeypatch.setattr(C, "united_ranges", seen)
    with pytest.raises(RuntimeError, match="^parts: ") as found:
        C.collocations(frame, range_bytes=60_000)
    assert 1 < int(str(found.value).split()[1]) <= 100


def test_paths_beyond_64_bits():
    pick = np.random.default_rng(3)
    paths = np.stack([pick.permutation(70_000) for _ in range(C.DEPTH)], axis=1).astype(np.int32)
    paths, weights = np.concatenate([paths, paths[::3]]), np.ones(70_000 + len(paths[::3]), np.int64)
    assert C._packed(paths) is None and C._packed(paths[:50_000]) is not None
    for some in (paths, paths[:50_000] + [[0, 0, 2**21, 2**21]]):
        plain = sorted(Counter(map(tuple, some.tolist())).items())
        for own in (weights[: len(some)], None):
            found, sums = C.summed_paths(some.astype(np.int32), own)
            assert list(zip(map(tuple, found.tolist()), sums.tolist())) == plain
    few = pick.integers(0, 3, size=(200, 3))
    for large in ([1, 1, 1], [1, 2**60, 1], [2**30, 2**62, 2**30]):
        rows = [tuple(r) for r in few.tolist()]
        assert C._first_equal(*(few[:, i] * large[i] for i in range(3))).tolist() == [rows.index(r) for r in rows]


def test_large_weights_and_single_prefixes():
    names = pa.array([b"a", b"b", b"c"], pa.binary())
    paths = np.array([[0, 0, -1, -1], [0, 0, 1, -1], [0, 0, 1, 2], [0, 2, -1, -1]], np.int32)
    weights = np.array([10**15, 3, 2**40, 1])
    made = C.Transducer.from_bytes(C.Transducer.of_paths(names, paths, weights).to_bytes())
    got, sums = made.paths()
    assert (got == paths).all() and (sums == weights).all()
    wanted = {(b"a",): sum(weights), (b"a", b"a", b"b"): 3 + 2**40, (b"a", b"a", b"b", b"c"): 2**40, (b"a", b"c", b"a"): 0, (b"b",): 0, (b"x",): 0}
    assert {p: made.weight_of(p) for p in wanted} == wanted
    assert made.arcs(2, 2)[1].tolist() == [10**15 + 3 + 2**40]
