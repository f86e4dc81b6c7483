"""The trie of rebuilt conversations against one that is built of whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trophos.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h]) + tuple(own[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = sum(below[c][0] for c in children[node]) or 1
        below[node] = (leaves, own + sum(below[c][1] for c in children[node]))
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(rebuilt[c]) == len(node)))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
            len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def built(rows, **options):
    return sorted((tuple(r) for r in prefix_trie.build(rows, **options).select(*COLUMNS).collect()), key=str)


def made(seed, convs, texts=3, turns=8):
    pick = random.Random(seed)
    ids = [pick.choice((c, c + 90_000)) for c in range(convs)] + [-250, -200, -201]
    return [
        (c, t, pick.choice(("user", "system")), f"text {pick.randrange(texts)}" * pick.randrange(1, 3))
        for c in ids
        for t in range(pick.randrange(1, turns))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_whole_texts(spark, seed):
    rows = made(seed, 230)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert built(frame) == brute(rows)


def test_given_table(spark, folder):
    frame = spark.read.parquet(f"{folder}/conversations.parquet")
    assert built(frame) == brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 3, "a", "é" * 9),
        (0, 4, "a", "b"), (0, 5, "a", "b"), (0, 6, "ab", ""), (None, 1, "user", "no conversation"), (7, 0, "user", "x" * 200_000),
        (7, 1, "user", "x"), (8, 0, None, None), (100, 2, "user", "y"), (100, 2, "user", "y"), (199, 2, "user", "y"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    clashing = ("row", "f0", "depth", "t0", "n", "h", "length", "part", "parent", "_text")
    frame = frame.select("*", *[F.lit("z").alias(c) for c in clashing]).repartition(3)
    assert built(frame) == brute(rows)
    assert built(frame.limit(0)) == []


def test_one_conversation_holds_most_rows(spark):
    rows = [(300, t, "user", f"turn {t % 7}") for t in range(9_000)] + made(3, 40)
    rows += [(301, t, "user", f"turn {t % 7}") for t in range(9_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert built(frame) == brute(rows)


def test_clash_is_not_passed_over(spark):
    rows = made(4, 60)
    with pytest.raises(prefix_trie.FingerprintClash):
        prefix_trie.build(spark.createDataFrame(rows, SCHEMA), prime=3)


def test_many_ids_end_at_one_node(spark):
    rows = [(100 * c, 0, "user", "same") for c in range(0, 3_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert built(frame) == brute(rows)
