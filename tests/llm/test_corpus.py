"""Near duplicates, language model, packing, token counts, mixing and the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import ODD, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from trophos.llm import minhash_dedup as M
from trophos.llm import mixing as X
from trophos.llm import ngram_lm as N
from trophos.llm import packing as K
from trophos.llm import queries
from trophos.llm import token_counts as C
from trophos.llm import words as W
from trophos.llm.bpe import encoder
from trophos.llm.components import components
from trophos.llm.queries import tokenizer
from trophos.plans.scratch import Scratch


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- near duplicates ------------------------------------------------------------


def shingle_set(text, size):
    w = words(text)
    return set(zip(*[w[i:] for i in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(rows, size, percent=80):
    """(doc_id, set size, component) by comparing all pairs; ids must be unique."""
    sets = {doc: shingle_set(text, size) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return sorted((doc, len(own), root(doc)) for doc, own in sets.items())


def found(frame):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def variants(base, n, changes, seed):
    pick, out = random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[pick.randrange(len(w))] = f"new{pick.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_components_against_all_pairs(spark, size):
    base = prose(9, 120).split()
    texts = variants(base, 25, 2, 1) + variants(prose(10, 60).split(), 12, 3, 2) + [" ".join(base)] * 5
    chain = prose(11, 100).split()
    for k in range(8):  # each is like the next, the ends are not alike
        chain = [f"step{k}x{i}" if 4 * k <= i < 4 * k + 4 else x for i, x in enumerate(chain)]
        texts.append(" ".join(chain))
    texts += ["one", "ONE", "two words", "Two  Words\n", "", " ", prose(12, 4), prose(13, 500)]
    random.Random(3).shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    assert found(M.near_duplicates(table(spark, rows), size)) == plain_components(rows, size)


def test_given_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(M.near_duplicates(documents)) == plain_components(rows, 2)


@pytest.mark.parametrize("two", [False, True])
def test_blocks_return_members_and_not_pairs(two):
    """A chain of 300 sets, each linked with the next few, and a ring of near copies, in one block or two."""
    chain = [range(i, i + 60) for i in range(300)]
    copies = [[*range(10_000, 10_100), 20_000 + i] for i in range(300)]
    sets = [np.sort(W.mix(np.array(s, np.uint64))).view(np.int64) for s in [*chain, *copies, range(50_000, 50_009)]]
    ids = np.random.default_rng(1).permutation(len(sets)) * 3
    rows = {
        "id": ids, "label": ids, "n": [len(s) for s in sets], "set": [s.tolist() for s in sets],
        "block": [i % 2 if two else 4 for i in range(len(sets))],
    }
    got = M._across(80)(pa.Table.from_batches(pa.table(rows).to_batches(max_chunksize=100))).to_pydict()
    assert len(got["a"]) <= 2 * len(sets)
    joined = dict(zip(got["a"], got["b"]))
    assert all(b == (min(ids[:300]) if a in set(ids[:300]) else min(ids[300:600])) for a, b in joined.items())
    assert len(joined) == 598 and ids[600] not in joined


@pytest.mark.parametrize("block,elements", [(512, 1 << 19), (2, 1 << 19), (512, 20)])
def test_bucket_of_unlike_texts(spark, monkeypatch, block, elements):
    """Members of one bucket that are linked, but not to its smallest id, in one block and across blocks."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "ELEMENTS", elements)
    monkeypatch.setattr(M, "COLUMNS", 7)
    ranges = {1: (0, 10), 2: (100, 110), 3: (100, 111), 4: (200, 210), 5: (200, 211), 6: (300, 305), 7: (99, 111)}
    sets = {i: np.sort(W.mix(np.arange(*r).astype(np.uint64))) for i, r in ranges.items()}
    sets[8] = np.sort(np.append(sets[6], sets[6][-1] + np.uint64(1)))  # alike in 32 bits
    members = [(7, i, len(s)) for i, s in sets.items()]
    rows = [(i, s.view(np.int64).tolist()) for i, s in sets.items()]
    scratch = Scratch(spark)
    labels = M.link(
        scratch.keep(table(spark, members, "bucket long, id long, n long")),
        scratch.keep(table(spark, rows, "id long, set array<long>")),
        80,
        scratch,
    )
    expected = {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 2, 8: 6}
    assert {r["id"]: r["component"] for r in labels.collect()} == expected


def test_odd_rows_of_near_duplicates(spark, odd, empty):
    rows = M.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["component_id"], r["kept"]))
    assert by_id[1] == [(1, True)] * 2 and (1, False) in by_id[2] and (2, True) in by_id[2]
    assert by_id[4] == [(4, True)] and by_id[5] == [(5, True)] and by_id[None] == [(None, True)] * 2
    assert M.near_duplicates(empty).count() == 0
    kept = M.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and set(ids) == {1, 2, 3, 4, 5, 6, 7, None}
    assert M.drop_near_duplicates(empty).count() == 0


def test_kept_rows_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda text: text + " tail"
    rows = [(5, a), (5, b), (3, near(b)), (None, near(near(b))), (None, c), (8, "x y z " + c + " q"), (8, near(a) + " more"), (9, "")]
    rows += [(7, "one two three four five six"), (7, "one two three four five six")]
    frame = table(spark, rows).repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in M.drop_near_duplicates(frame, 1).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[5], rows[7], rows[8]], key=str)
    near_copies = table(spark, [(5, a), (5, near(a)), (6, near(near(a)))])
    assert [r["doc_id"] for r in M.drop_near_duplicates(near_copies, 1).collect()] == [5]


def test_sketch_fills_all_bins_and_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        errors = []
        for _ in range(30):
            a = W.mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b, own = a.copy(), n // 5
            b[:own] = W.mix(rng.integers(0, 1 << 62, own).astype(np.uint64))
            x, y = M.sketch(a, 350), M.sketch(b, 350)
            assert (x != np.uint64(2**64 - 1)).all()
            errors.append((x == y).mean() - (n - own) / (n + own))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_chains_stars_and_rings(spark):
    pick = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + k) for k in range(1, 60)]
    edges += [(1000 + i, 1000 + (i + 1) % 30) for i in range(30)]
    edges += [(pick.randrange(2000, 2100), pick.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    single = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in components(table(spark, edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: root(x) for x in parent if x not in single}


# --- language model -------------------------------------------------------------


def plain_scores(rows, held):
    texts = [[*words(t), 0] for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    count = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip([1, *t], t))
    total, types = sum(count.values()), len(count)
    after, before, kinds = collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (v, w), n in pairs.items():
        after[v] += n
        before[w] += 1
        kinds[v][min(n, 3) - 1] += 1

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5] * 3, n
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.01), k + 0.99) for k in range(3)], n

    d, _ = discounts(pairs.values())
    e, n = discounts(before.values())
    rest = (e[0] * n[0] + e[1] * n[1] + e[2] * (len(before) - n[0] - n[1])) / len(pairs) if pairs else 1.0
    cut = lambda c, by: max(c - by[min(c, 3) - 1], 0) if c else 0
    p1 = lambda w: cut(before[w], e) / max(len(pairs), 1) + rest / (types + 1)

    def p(v, w):
        if v not in after:
            return p1(w)
        return (cut(pairs[v, w], d) + sum(a * b for a, b in zip(d, kinds[v])) * p1(w)) / after[v]

    if pairs:
        assert sum(map(p1, count)) + rest / (types + 1) == pytest.approx(1)
        v = max(after, key=after.get)
        assert sum(p(v, w) for w in count) + sum(d[k] * kinds[v][k] for k in range(3)) / after[v] * rest / (types + 1) == pytest.approx(1)
    return [
        (
            doc, len(t), sum(count[w] > 0 for w in t), total,
            sum(math.log10((count[w] + 1) / (total + types + 1)) for w in t),
            sum(math.log10(p(v, w)) for v, w in zip([1, *t], t)),
        )
        for (doc, _), t in zip(rows, texts)
    ]


def _compare(frame, rows, held):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted((tuple(r)[:6] for r in frame.collect()), key=key)
    expected = sorted(plain_scores(rows, held), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])


def test_scores_of_given_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    held = [zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in rows]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    frame = N.score_documents(documents, fold)
    _compare(frame, rows, held)
    unseen = frame.where(fold).agg(F.sum("score") > F.sum("base_score")).first()[0]
    assert unseen


def test_scores_of_odd_rows(spark, odd, empty):
    rows = [r for r in ODD if r[0] != 7]
    fold = F.coalesce(F.col("doc_id") == 2, F.lit(False))
    _compare(N.score_documents(odd.where("doc_id is null or doc_id <> 7"), fold), rows, [doc == 2 for doc, _ in rows])
    assert N.score_documents(empty, fold).count() == 0
    assert N.score_documents(odd, F.lit(False)).where("doc_id = 7").first()["n_tokens"] == 30_001
    nothing = N.score_documents(odd, F.lit(True)).collect()  # no training rows
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in nothing} == {(0, 0, 0.0, 0.0)}
    blank = table(spark, [(1, ""), (2, None), (3, "new")])
    _compare(N.score_documents(blank, F.col("doc_id") == 3), [(1, ""), (2, None), (3, "new")], [False, False, True])


def plain_trigram_scores(rows, held):
    """(doc_id, score) by trigrams over bigrams that count the tokens before them."""
    texts = [[1, *words(t), 0] for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    triples = collections.Counter(x for t in train for x in zip(t, t[1:], t[2:]))
    raw = collections.Counter(x for t in train for x in zip(t, t[1:]))
    pairs = collections.Counter((v, w) for _, v, w in triples)
    pairs.update({p: n for p, n in raw.items() if p[0] == 1})
    before = collections.Counter(w for _, w in raw)

    def level(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.01), k + 0.99) for k in range(3)] if all(n) else [0.5] * 3
        total, gone = collections.Counter(), collections.Counter()
        for key, c in counts.items():
            total[key[:-1]] += c
            gone[key[:-1]] += d[min(c, 3) - 1]

        def p(key, lower):
            h = key[:-1]
            own = max(counts[key] - d[min(counts[key], 3) - 1], 0) if counts[key] else 0
            return (own + gone[h] * lower) / total[h] if h in total else lower

        return p

    p3, p2, p1 = level(triples), level(pairs), level(collections.Counter({(w,): n for w, n in before.items()}))
    types = len(before)

    def prob(t, i):
        low = p2((t[i - 1], t[i]), p1((t[i],), 1 / (types + 1)))
        return p3((t[i - 2], t[i - 1], t[i]), low) if i > 1 else low

    if triples:
        for u, v in list({x[:2]: 0 for x in triples})[:5]:
            own = sum(prob([u, v, w], 2) for w in before)
            assert own + prob([u, v, "never seen"], 2) == pytest.approx(1)
    return [(doc, sum(math.log10(prob(t, i)) for i in range(1, len(t)))) for (doc, _), t in zip(rows, texts)]


def _compare_trigrams(frame, rows, held):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["score"]) for r in frame.collect()), key=key)
    expected = sorted(plain_trigram_scores(rows, held), key=key)
    assert [a[0] for a in got] == [b[0] for b in expected]
    assert [a[1] for a in got] == pytest.approx([b[1] for b in expected])


def test_trigram_scores(spark, documents, odd, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    held = [zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in rows]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    monkeypatch.setattr(N, "GATHER", 1 << 12)
    _compare_trigrams(N.score_documents(documents, fold, order=3), rows, held)
    rows = [r for r in ODD if r[0] != 7] + [(9, "so " * 1000), (10, "so so"), (11, "so it so so")]
    more = table(spark, rows)
    _compare_trigrams(N.score_documents(more, F.col("doc_id").eqNullSafe(2), order=3), rows, [doc == 2 for doc, _ in rows])
    blank = [(1, ""), (2, None), (3, "new words")]
    _compare_trigrams(N.score_documents(table(spark, blank), F.col("doc_id") == 3, order=3), blank, [False, False, True])
    nothing = N.score_documents(odd, F.lit(True), order=3).collect()
    assert {(r["train_tokens"], r["score"]) for r in nothing} == {(0, 0.0)}
    assert N.score_documents(empty, F.lit(False), order=3).count() == 0
    with pytest.raises(ValueError):
        N.score_documents(odd, F.lit(False), order=4)


def test_query_scores_by_trigrams(spark, folder, documents):
    frame = queries.op3_lm_score(spark, folder)
    held = {r["doc_id"]: r["held_out"] for r in frame.collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    _compare_trigrams(frame, rows, [held[doc] for doc, _ in rows])


def test_folder_must_be_mounted():
    assert N.local_path("file:///shared/x") == "/shared/x" == N.local_path("/shared/x")
    with pytest.raises(ValueError):
        N.local_path("hdfs://name/x")


# --- tokens and packing -----------------------------------------------------------

PARTS = ["a", "Bc", " ", " ", "  ", "\n", "\t", "é", "\x1c", "'s", "12", "...", "<|endoftext|>", "日本", "🙂", "\r\n", " \n"]


def noise(pick, n):
    return "".join(pick.choice(PARTS) for _ in range(n))


def test_ids_are_those_of_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer()
    plain, own, pick = tokenizers.Tokenizer.from_file(path), encoder(path), random.Random(1)
    for _ in range(3000):
        text = noise(pick, pick.randrange(16))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_edits_are_counted_as_if_encoded_again(monkeypatch):
    monkeypatch.setattr(C, "LEAF", 3)
    tokens, pick = encoder(tokenizer()), random.Random(2)
    for _ in range(800):
        text = noise(pick, pick.randrange(60))
        tree = C.TokenTree(tokens, text)
        for _ in range(6):
            start, removed = pick.randrange(len(text) + 3), pick.choice([0, 1, 2, 5, 30])
            inserted = noise(pick, pick.choice([0, 1, 3, 20]))
            tree.edit(start, removed, inserted)
            start = min(start, len(text))
            text = text[:start] + inserted + text[start + removed :]
            assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), len(tokens.encode(text)) // 4)


def test_only_touched_leaves_are_encoded():
    tree = C.TokenTree(encoder(tokenizer()), prose(1, 10_000))
    assert tree.edit(tree.n_chars // 2, 5, "xyz") < 1000


def test_kept_trees_and_odd_rows(odd, empty):
    path = tokenizer()
    edited = C.with_edits(odd)
    direct = C.recount(edited, path)
    rows = direct.collect()
    tokens = encoder(path)
    assert len(rows) == len(ODD)
    for r, e in zip(sorted(rows, key=lambda r: (r["doc_id"] or 0, r["n_tokens"])), sorted(edited.collect(), key=lambda e: (e["doc_id"] or 0, len(tokens.encode(e["text"] or ""))))):
        text = e["text"] or ""
        assert r["n_tokens"] == len(tokens.encode(text)) // 4
        for x in e["edits"]:
            text = text[: x["start"]] + x["inserted"] + text[x["start"] + x["removed"] :]
        assert (r["edited_chars"], r["edited_tokens"]) == (len(text), len(tokens.encode(text)) // 4)
    once = odd.where("doc_id = 7")
    trees = C.build_trees(once, path).select("doc_id", F.col("leaf_chars").alias("c"), F.col("leaf_tokens").alias("t"))
    kept = C.with_edits(once).join(trees, "doc_id").withColumn("leaf_chars", F.col("c")).withColumn("leaf_tokens", F.col("t"))
    assert C.recount(kept, path).collect() == direct.where("doc_id = 7").collect()
    none = odd.select("doc_id", "text", F.lit(None).alias("edits"), F.lit(None).alias("leaf_chars"), F.lit(None).alias("leaf_tokens"))
    assert all(r["n_tokens"] == r["edited_tokens"] for r in C.recount(none, path).collect())
    assert C.recount(C.with_edits(empty), path).count() == 0 and C.build_trees(empty, path).count() == 0


def test_best_fit_is_that_of_single_pieces():
    pick = random.Random(4)
    for _ in range(200):
        capacity = pick.choice([1, 5, 16, 50])
        counts = {pick.randint(1, capacity): pick.randint(1, 30) for _ in range(pick.randrange(12))}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [(room, i) for i, room in enumerate(rooms) if room >= length]
                if fits:
                    rooms[min(fits)[1]] -= length
                else:
                    rooms.append(capacity - length)
        used, numbers = set(), collections.defaultdict(list)
        for run in K.best_fit(counts, capacity):
            numbers[run.length] += range(run.first, run.first + run.count)
            places = {(run.bin + j, run.offset + q) for j in range(run.count) for q in range(run.length)}
            assert len(places) == run.count * run.length and not places & used
            used |= places
        assert {length: sorted(n) for length, n in numbers.items()} == {length: list(range(n)) for length, n in counts.items()}
        full = collections.Counter(b for b, _ in used)
        assert used == {(b, q) for b, n in full.items() for q in range(n)}
        assert sorted(capacity - n for n in full.values()) == sorted(rooms)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(odd, empty, capacity):
    path, tokens = tokenizer(), encoder(tokenizer())
    rows = K.pack(odd, path, capacity).collect()
    full = [tokens.encode(t or "") + b"\0\0\0\0" for _, t in ODD]
    expected = []
    for (doc, _), ids in zip(ODD, full):
        n, start, piece = len(ids) // 4, 0, 0
        stop = (n - 1) % capacity + 1
        while start < n:
            expected.append((doc or -1, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            start, stop, piece = stop, stop + capacity, piece + 1
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:5]) for r in rows) == sorted(expected)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert K.pack(empty, path).count() == 0


# --- mixing ---------------------------------------------------------------------


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    rows = [(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(n, p))]
    members = table(spark, rows, "doc_id long, n long, p0 double, p1 double, p2 double")
    for weights in ([0.6, 0.3, 0.1], [0.9, 0.1, 0.0]):
        rated = X.fit_rates(members, weights, Scratch(spark))[0].toPandas()
        totals = (rated["rate"] * rated["n"]).to_numpy() @ rated[["p0", "p1", "p2"]].to_numpy()
        goal = np.array(weights) * n.sum()
        assert (rated["rate"] >= 0).all()
        if weights[2]:
            assert totals == pytest.approx(goal, rel=2e-3)
        else:  # a domain to empty, which soft memberships allow in the limit only
            assert np.abs(totals - goal).max() < 0.02 * n.sum()
    kept = X.fit_rates(members, None, Scratch(spark), floor=1.0, total=0)[0].toPandas()
    assert (kept["rate"] >= 1).all()


def test_mixing_of_odd_rows(spark, odd, empty):
    labelled = table(spark, [("w1 w2 alpha", "x"), ("omega w3", "y"), (None, "x"), ("lost", None)], "text string, domain string")
    rows = X.mix(odd, labelled).collect()
    assert len(rows) == len(ODD) and all(r["rate"] >= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 7) == 30_000
    assert X.mix(empty, labelled).count() == 0
    alone = X.mix(odd, labelled.limit(0)).collect()
    assert {(r["domain"], r["rate"]) for r in alone} == {("unknown", 1.0)}


def test_posteriors_by_words(spark):
    texts = [(" ".join(f"{d}{i % 7}" for i in range(k, k + 20)), d) for d in ("x", "y") for k in range(6)]
    labelled = table(spark, texts, "text string, domain string")
    rows = table(spark, [(1, "x1 x2 x3"), (2, "Y1 y2\tY3"), (3, "x1 y1"), (4, "")])
    got = {r["doc_id"]: (r["domain"], r["probability"]) for r in X.mix(rows, labelled).collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and got[1][1] > 0.9
    assert got[3][1] == pytest.approx(0.5, abs=0.05) and got[4][1] == pytest.approx(0.5)


def test_repeats_follow_rates(spark):
    docs = table(spark, [(i, "t") for i in range(4000)] + [(None, None)])
    rates = table(spark, [(i, 2.25 if i % 2 else 0.5) for i in range(4000)] + [(None, 3.0)], "doc_id long, rate double")
    n = collections.Counter(r["doc_id"] for r in X.repeat_by_rate(docs, rates).collect())
    assert n[None] == 3 and all(n[i] in ((2, 3) if i % 2 else (0, 1)) for i in range(4000))
    assert sum(n[i] for i in range(1, 4000, 2)) == pytest.approx(4500, rel=0.03)
    assert sum(n[i] for i in range(0, 4000, 2)) == pytest.approx(1000, rel=0.1)


# --- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark, folder, documents, labels):
    from trophos.llm import quality_rff, toxicity

    key = lambda frame: sorted(tuple(r) for r in frame.collect())
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark)
    toxic = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).collect()}
    kept = scratch.keep(stages["toxicity"](spark, docs, folder))
    assert key(kept) == sorted(tuple(r) for r in docs.collect() if not toxic[r["doc_id"]])
    good = {r["doc_id"]: r["predicted"] for r in quality_rff.score_documents(kept, labels).collect()}
    better = scratch.keep(stages["quality classifier"](spark, kept, folder))
    assert key(better) == sorted(tuple(r) for r in kept.collect() if good[r["doc_id"]])
    rows = [(r["doc_id"], r["text"]) for r in better.collect()]
    first = {c for _, _, c in plain_components(rows, 5)}
    single = scratch.keep(stages["near duplicates"](spark, better, folder))
    assert key(single) == sorted(tuple(r) for r in better.collect() if r["doc_id"] in first)
    mixed = scratch.keep(stages["mixing"](spark, single, folder))
    assert mixed.columns == documents.columns
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in single.collect()}
    assert set(map(tuple, mixed.collect())) == set(map(tuple, single.collect()))
    packed = stages["packing"](spark, mixed, folder).collect()
    tokens = encoder(tokenizer())
    assert sum(r["length"] for r in packed) == sum(len(tokens.encode(r["text"])) // 4 + 1 for r in mixed.collect())


def test_pipeline_runs_on_odd_rows(spark, folder, odd):
    """With a map, which nothing can order, and with columns named as the stages name theirs; ids repeat."""
    own = F.create_map(F.lit("k"), F.col("text"))
    docs = odd.withColumns({"n_chars": F.lit(1).cast("long"), "extra": own, "_copy": F.lit("mine"), "_key": F.lit("mine")})
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = frame
            frame = Scratch(spark).keep(stage(spark, frame, folder))
            if name != "packing":
                assert frame.schema.simpleString() == docs.schema.simpleString()
                seen = lambda f: {(r["doc_id"], r["text"], str(r["extra"]), r["_copy"], r["_key"]) for r in f.collect()}
                assert seen(frame) <= seen(before)


def test_rates_are_the_least_squares_solution(spark):
    """Against many steps of plain projected gradients: soft memberships, targets in reach, and out of it, where the
    steps end some per cent of the tokens before the optimum and the gap says so."""
    pick = np.random.default_rng(4)
    for soft, weights, floor, slack in ((0.9, [1, 1, 1, 1], 0.0, 1e-6), (0.3, [8, 1, 1, 0], 0.0, 3e-3)):
        own = np.eye(4)[pick.integers(4, size=300)]
        p = (1 - soft) * own + soft * pick.dirichlet(np.ones(4), size=300)
        n = pick.integers(5, 400, size=300).astype(float)
        rows = [(i, int(n[i]), *map(float, p[i])) for i in range(300)]
        members = spark.createDataFrame(rows, "doc_id long, n long, p0 double, p1 double, p2 double, p3 double")
        rated, gap = X.fit_rates(members, [float(w) for w in weights], Scratch(spark), floor)
        rates = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
        a, have = n[:, None] * p, (n[:, None] * p).sum(axis=0)
        goal = np.array(weights) / sum(weights) * have.sum()
        exact = np.ones(300)
        for _ in range(20_000):
            exact = np.maximum(floor, exact - p @ ((exact @ a - goal) / have))
        off = lambda r: (((r @ a - goal) ** 2) / have).sum()
        assert rates.min() >= floor and off(rates) <= off(exact) + slack * have.sum()
        np.testing.assert_allclose((rates @ a - goal) / have, gap, atol=0.03)
